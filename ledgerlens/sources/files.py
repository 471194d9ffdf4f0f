"""Readers by file name, workbooks through the standard library, JSON lines, and the page-range split."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.runtime import filesystem

#: Suffixes and their readers.
READERS = {".pdf": "pdf", ".xlsx": "excel", ".xls": "excel"}
ELEMENTS = "filename string, item_seq int, text string, page_no int, is_table boolean"
LOG = "timestamp string, subset_size int, retrieval_accuracy double, attribution_accuracy double, p50_latency_ms double, p95_latency_ms double, errors int, query_ids array<int>"


def reader_of(filename: Column) -> Column:
    out = None
    for suffix, name in READERS.items():
        hit = F.lower(filename).endswith(suffix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unsupported")


def reader_for(path: str) -> str:
    """The reader of one file; a missing file comes before an unknown suffix."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"cannot read {suffix or 'a file without suffix'}; formats: {', '.join(READERS)}")
    return READERS[suffix]


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets_of(data: bytes) -> list[tuple[int, str, list[list[str]]]]:
    """(number, name, rows) of every sheet of an xlsx workbook, computed values as text."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"), 1):
        target = targets[sheet.get(_REL)].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows = []
        for row in root.iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{_NS}c")):
                value, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_NS}t")) if inline is not None else (value.text or "" if value is not None else "")
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                cells[_column(c.get("r")) if c.get("r") else i] = text
            if any(v.strip() for v in cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        out.append((number, sheet.get("name"), rows))
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(filename, sheet_number, sheet_name, content, row_count): the sheets of the workbooks at path that are not empty.

    Row 0 is the header; a broken workbook gives one row with the reason as content and sheet_number 0.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, data in zip(pdf["path"], pdf["content"]):
                name = where.rsplit("/", 1)[-1]
                try:
                    for number, sheet, cells in sheets_of(data):
                        if len(cells) < 2:
                            continue
                        width = max(map(len, cells))
                        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
                        lines.insert(1, "|" + "---|" * width)
                        rows.append((name, number, sheet, f"## Sheet {number}: {sheet}\n" + "\n".join(lines), len(cells) - 1))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((name, 0, None, f"cannot be read: {type(e).__name__}", 0))
            yield pd.DataFrame(rows, columns=["filename", "sheet_number", "sheet_name", "content", "row_count"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(parse, "filename string, sheet_number int, sheet_name string, content string, row_count int")


def workbook_elements(sheets: DataFrame) -> DataFrame:
    """Sheets as parsed elements: each a table on the page of its number."""
    return sheets.filter("sheet_number > 0").select("filename", F.col("sheet_number").alias("item_seq"), F.col("content").alias("text"), F.col("sheet_number").alias("page_no"), F.lit(True).alias("is_table"))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """(line, r): the lines that are not blank, and what they say; r._broken is the line where it cannot be read."""
    at, fs = filesystem(spark, path)
    if not fs.exists(at):
        return None
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.select(F.col("value").alias("line"), parsed.alias("r"))


def read_json_lines(spark: SparkSession, path: str, schema: str = LOG, order: str = "timestamp") -> DataFrame:
    """Rows of JSON lines by time; a missing file has none. Blank lines are no rows; lines that cannot be read are left to broken_json_lines."""
    rows = _json_lines(spark, path, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.col("r._broken").isNull()).select("r.*").drop("_broken")
    return rows.filter(F.col(order).isNotNull()).orderBy(order) if order in rows.columns else rows


def broken_json_lines(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """(line): the lines that read_json_lines leaves out because they are no JSON of this schema."""
    rows = _json_lines(spark, path, schema)
    if rows is None:
        return spark.createDataFrame([], "line string")
    return rows.filter(F.col("r._broken").isNotNull()).select("line")


def write_workbook(path: str | io.BytesIO, sheets: list[tuple[str, list[list]]]) -> None:
    """An xlsx workbook of (name, rows) with texts and numbers: a file of the size a reader opens."""
    from xml.sax.saxutils import escape, quoteattr

    ns = f'xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:].split("}")[0]}"'

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        book = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{book}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
