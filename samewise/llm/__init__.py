"""Operators that prepare text and records for training. Nothing else in the library imports this folder."""
