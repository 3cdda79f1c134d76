"""Workbooks and text documents as DataFrames, from zipped XML, without office libraries.

Files are read by Spark's binaryFile source, so any Hadoop path works and each
file is one row of one task; rows come out of Arrow batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Header spellings of registers.
TITLE_HEADERS = ("TITLE", "DOCUMENT DESCRIPTION", "DOCUMENT TITLE")
NUMBER_HEADERS = ("DOCUMENT NUMBER", "DOCUMENT NO", "DOCUMENT NO.", "DOC NO")
HEADER_ROWS = 10
CELLS = "source_file string, sheet string, row int, cells array<string>"


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cell texts) of every row of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            path = targets[sheet.get(f"{REL}id")].lstrip("/")
            for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value = c.find(f"{MAIN}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    else:
                        text = (value.text or "") if value is not None else ""
                        text = shared[int(text)] if c.get("t") == "s" and text else text
                    cells.append(text)
                yield sheet.get("name"), int(row.get("r") or 0), cells


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of inline strings; for results that fit the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        names = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        for i, rows in zip(n, sheets.values(), strict=True):
            body = "".join(f'<row r="{r}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in row) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(path.rsplit("/", 1)[-1], sheet, number, cells) for sheet, number, cells in sheet_rows(content)]
            columns = [[*c] for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())), strict=True)], ["source_file", "sheet", "row", "cells"])


def workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """CELLS rows of the .xlsx and .xlsm files of a folder, without lock files and abbreviation lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower(name).rlike("\\.xls[xm]$") & ~name.startswith("~$") & ~F.lower(name).startswith("abbreviation")
    return files.filter(wanted).select("path", "content").mapInArrow(_cells, CELLS)


def register_titles(cells: DataFrame) -> DataFrame:
    """(source_file, sheet, row, document_no, title) below each sheet's header, repeated headers left out.

    The header is the first of the top rows with a title column; a sheet without
    one gives no rows, and one without a number column gives blank numbers.
    """
    upper = F.transform("cells", lambda c: F.upper(F.trim(c)))
    place = lambda names: F.array_max(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_position(F.col("u"), n)))
    marked = cells.withColumn("u", upper).withColumns({"t": place(TITLE_HEADERS), "n": place(NUMBER_HEADERS)})
    heads = marked.filter((F.col("t") > 0) & (F.col("row") <= HEADER_ROWS)).groupBy("source_file", "sheet").agg(F.min_by(F.struct("row", "t", "n"), "row").alias("h"))
    # there is a header for each sheet, however small the cells look to the planner: both sides are shuffled, none is broadcast
    body = marked.hint("merge").join(heads.hint("merge"), ["source_file", "sheet"]).filter(F.col("row") > F.col("h.row"))
    cell = lambda at: F.when(at > 0, F.trim(F.coalesce(F.get("cells", at - 1), F.lit("")))).otherwise("")
    titles = body.select("source_file", "sheet", "row", cell(F.col("h.n")).alias("document_no"), cell(F.col("h.t")).alias("title"))
    return titles.filter((F.col("title") != "") & ~F.upper("title").isin(*TITLE_HEADERS))


def guide_schedule(cells: DataFrame) -> DataFrame:
    """(source_file, sheet, row, row_type, activity_id, activity_name, level, start_date, finish_date).

    A row names a level or `Activity` first, then id, name, start and finish;
    anything else is of unknown type. Bracketed start notes leave the name.
    """
    from dossier.functions.dates import parse_date

    get = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    kind = F.when(F.lower(get(0)) == "activity", "activity").when(get(0).rlike("^[0-9]+$"), "wbs").otherwise("unknown")
    name = F.trim(F.regexp_replace(get(2), "\\([^)]*(?:NTP|start)[^)]*\\)", ""))
    return cells.select("source_file", "sheet", "row", kind.alias("row_type"), get(1).alias("activity_id"), name.alias("activity_name"), get(0).try_cast("int").alias("level"), parse_date(get(3)).alias("start_date"), parse_date(get(4)).alias("finish_date"))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{WORD}p")]
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["source_file", "place", "text"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, place, text) of each paragraph of .docx files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_paragraphs, "source_file string, place int, text string")


def taxonomy(paragraphs: DataFrame) -> DataFrame:
    """Distinct terms of paragraphs: list marks dropped, split at commas, semicolons and slashes between words."""
    plain = F.trim(F.regexp_replace("text", "^[\\s•*-]+|^[0-9.]+\\s+", ""))
    return paragraphs.select("source_file", F.explode(F.split(plain, "\\s*[,;]\\s*|\\s+/\\s+")).alias("term")).filter("trim(term) <> ''").distinct()
