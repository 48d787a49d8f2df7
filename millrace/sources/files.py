"""Files as tables: CSV, workbooks, text, images' kinds, templates and reference lists.

Files come through Spark's readers only (binaryFile or text), so any store that Spark knows will do. A file is
parsed in one task; a CSV that should be split over tasks is read with ``csv_lines``.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _trim, collapse, line_to_cells
from ..operators.headers import canonical_headers
from ..session import workers_import

#: File kinds by suffix.
TABULAR, TEXT, OFFICE = ("csv", "xls", "xlsx", "xlsm"), ("txt", "rtf"), ("doc", "docx", "ppt", "pptx")
IMAGES = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "webp")
SHEET = "source string, sheet string, sheet_idx int, row_idx long, cells array<string>"
#: Encodings tried on text, in order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1256", "cp1252")


def files(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """path, name, suffix, length, content of the known files below ``path``; those below ``skip`` are left out, and
    of names that differ in case the first counts."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    found = found.where(F.col("suffix").isin(*TABULAR, *TEXT, *OFFICE, *IMAGES, "pdf"))
    if skip:
        found = found.where(~F.col("path").contains(skip))
    first = found.groupBy(F.lower("path").alias("_l")).agg(F.min("path").alias("path")).drop("_l")
    return found.join(first, "path", "left_semi").select("path", "name", "suffix", "length", "content")


def route(suffix: Column) -> Column:
    return F.when(suffix.isin(*TABULAR), "tabular").when(suffix == "pdf", "pdf").when(suffix.isin(*IMAGES), "images").when(suffix.isin(*TEXT), "text").when(suffix.isin(*OFFICE), "office").otherwise("unsupported")


def sniff(content: Column) -> Column:
    """What the first bytes say a file is: pdf, png, jpeg, gif, bmp, tiff, webp, zip, ole, csv or unknown."""
    head = F.hex(F.substring(content, 1, 12))
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, 5)
    is_csv = ~text.contains("\x00") & F.exists(lines, lambda x: x.rlike("[,;\t|]"))
    kinds = (("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("504B0304", "zip"), ("D0CF11E0", "ole"))
    found = F.when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    for magic, kind in kinds:
        found = found.when(head.startswith(magic), kind)
    return found.when(is_csv, "csv").otherwise("unknown")


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore")


def _csv_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    for i, row in enumerate(csv.reader(io.StringIO(decoded(content), newline=""))):
        yield "Cleaned Data", i, row


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Stored values (not formulas) of every sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for i, row in enumerate(root.iter(f"{_MAIN}row")):
                cells: list[str] = []
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else k
                    value = c.findtext(f"{_MAIN}v") or ""
                    if c.get("t") == "s":
                        value = shared[int(value)] if value else ""
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    cells += [""] * (at - len(cells)) + [value]
                yield sheet.get("name"), int(row.get("r") or i + 1) - 1, cells


def sheets(found: DataFrame) -> DataFrame:
    """Rows of the tabular files of ``files``; a file that cannot be read gives one row with a null sheet and the
    reason as its cell. Old binary workbooks have no reader here."""
    workers_import(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"], strict=True):
                rows, names = [], {}
                try:
                    for sheet, i, cells in _csv_rows(content) if suffix == "csv" else _xlsx_rows(content):
                        rows.append((path, sheet, names.setdefault(sheet, len(names)), i, cells))
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch; it is reported as a row
                    rows = [(path, None, -1, -1, [f"{type(e).__name__}: {e}"])]
                yield pd.DataFrame(rows, columns=["source", "sheet", "sheet_idx", "row_idx", "cells"])

    return found.where(F.col("suffix").isin(*TABULAR)).select("path", "suffix", "content").mapInPandas(run, SHEET)


def _office_lines(content: bytes, suffix: str) -> Iterator[tuple[str, list[str]]]:
    """(kind, cells) of the paragraphs and table rows of a .docx, or of the text of a .pptx's slides, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if suffix == "docx":
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
            for e in ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body"):
                if e.tag == f"{w}p" and said(e).strip():
                    yield "text", [said(e)]
                elif e.tag == f"{w}tbl":
                    yield from (("table", [said(c) for c in r.iter(f"{w}tc")]) for r in e.iter(f"{w}tr"))
        else:
            a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
            for name in slides:
                for p in ElementTree.fromstring(z.read(name)).iter(f"{a}p"):
                    line = "".join(t.text or "" for t in p.iter(f"{a}t"))
                    if line.strip():
                        yield "text", [line]


def office(found: DataFrame) -> DataFrame:
    """Paragraphs and table rows of .docx and .pptx files: source, kind, row_idx, cells; an unreadable file gives one row of kind
    'error'. The old binary formats have no reader here."""
    workers_import(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"], strict=True):
                try:
                    rows = [(path, kind, i, cells) for i, (kind, cells) in enumerate(_office_lines(content, suffix))]
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch; it is reported as a row
                    rows = [(path, "error", -1, [f"{type(e).__name__}: {e}"])]
                yield pd.DataFrame(rows, columns=["source", "kind", "row_idx", "cells"])

    return found.where(F.col("suffix").isin("docx", "pptx")).select("path", "suffix", "content").mapInPandas(run, "source string, kind string, row_idx long, cells array<string>")


def csv_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Rows of CSV files without line breaks in cells, split over tasks: source, value, cells."""
    lines = spark.read.text(path).withColumn("source", F.col("_metadata.file_path"))
    quoted = rf'"(?:[^"]|"")*"|[^{separator}]*'
    found = F.regexp_extract_all(F.concat(F.col("value"), F.lit(separator)), F.lit(rf"({quoted}){separator}"), F.lit(1))
    bare = F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return lines.select("source", "value", bare.alias("cells"))


def texts(found: DataFrame) -> DataFrame:
    """path, text of the text files of ``files``."""
    workers_import(found.sparkSession)

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(decoded)

    return found.where(F.col("suffix").isin(*TEXT)).select("path", decode("content").alias("text"))


def text_rows(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of texts as table rows: key, row_idx, cells; blank lines go."""
    lines = documents.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("row_idx", "line"))
    return lines.where(_trim(F.col("line")) != "").select(key, "row_idx", line_to_cells(F.col("line")).alias("cells"))


def has_text_layer(pages: DataFrame, key: str, least: int = 80) -> DataFrame:
    """pages (key, text) -> key, present: at least so many characters that are not blank."""
    return pages.groupBy(key).agg((F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", ""))) >= least).alias("present"))


def first_key(json: Column, *names: str) -> Column:
    """The first value that is not empty of a JSON object's alternative keys."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{n}"), F.lit("")) for n in names])


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Distinct templates of JSON files, malformed ones left out."""
    schema = "source string, type string, fingerprint string, header_text string, columns array<string>"
    read = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return read.where("fingerprint IS NOT NULL").dropDuplicates()


def match_templates(layouts: DataFrame, known: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """layouts (fingerprint and others) with the first template (by source) of the same fingerprint and an allowed type."""
    first = known.where(F.col("type").isin(*kinds)).groupBy("fingerprint").agg(F.min_by(F.struct("source", "type", "columns"), "source").alias("template"))
    return layouts.join(first, "fingerprint", "left")


def master(rows: DataFrame) -> DataFrame:
    """Reference lists from sheets whose first row is the heading: distinct (field, value), fields by canonical name."""
    heads = rows.where("row_idx = 0").select("source", "sheet_idx", F.posexplode("cells").alias("c", "heading"))
    heads = canonical_headers(heads, "heading", "field").select("source", "sheet_idx", "c", "field")
    body = rows.where("row_idx > 0").select("source", "sheet_idx", F.posexplode("cells").alias("c", "v"))
    return body.join(heads, ["source", "sheet_idx", "c"]).select("field", collapse(F.col("v")).alias("value")).where("value <> ''").distinct()
