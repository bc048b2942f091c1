"""Spreadsheets as a Spark data source (``format('xlsx')``), reading and writing with the standard library only."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet as trimmed texts; empty cells are None. The sheet is parsed as a stream."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in root.findall("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = book.find("m:sheets/m:sheet", _NS).get(_REL)
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == first)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out: list[str | None] = []
                for cell in row.findall("m:c", _NS):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t"), cell.find("m:v", _NS)
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                    else:
                        text = (shared[int(value.text)] if kind == "s" else value.text) if value is not None and value.text is not None else ""
                    out[at] = text.strip() or None
                yield out
                row.clear()


class XlsxDataSource(DataSource):
    """Option path; the header row names the columns, all of them texts; ``row_ord`` is added; rows without any text are dropped."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        header = next(rows(self.options["path"]), [])
        return StructType([StructField("row_ord", LongType()), *[StructField(h or f"column_{i + 1}", StringType()) for i, h in enumerate(header)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], len(schema) - 1)


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a zipped sheet can't be split

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, row in enumerate(rows(self.path)):
            if n and any(row):
                yield (n - 1, *(row + [None] * self.width)[: self.width])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write(df: DataFrame, path: str, order: list[str], most: int = 1_048_575) -> int:
    """Write a result of at most ``most`` rows (what a sheet holds) as one sheet, in the given order; larger ones are refused, not cut."""
    from xml.sax.saxutils import escape

    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows don't fit on a sheet")

    def cell(i: int, r: int, value) -> str:
        return "" if value is None else f'<c r="{_name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    types = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
    relation = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'
    book = f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", relation.format("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/_rels/workbook.xml.rels", relation.format("worksheet", "worksheets/sheet1.xml"))
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            lines = [df.columns]
            for r, line in enumerate((x for part in (lines, df.orderBy(*order).toLocalIterator()) for x in part), 1):
                out.write(f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(line))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")
    return n
