"""samewise: record linkage and text preparation as PySpark DataFrame operators."""

__version__ = "0.1.0"
