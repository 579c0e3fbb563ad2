"""Documents and tables from files, through Spark's own readers.

Office files are zip archives of XML; they are read inside tasks, a file at a time.
PDF and the legacy formats need libraries or programs that aren't here: such files
are reported by ``unsupported``, never passed over in silence.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.tags import format_table
from maskwright.functions.text import decoded, html_to_text, rtf_to_text

PLAIN, MARKUP, RICH, OFFICE = ("txt", "md"), ("html", "htm"), ("rtf",), ("docx", "pptx", "xlsx")
CELLS = "doc_id string, sheet int, row int, col int, value string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), suffix, content, output_ext, output_note of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "content", "modificationTime")
    return rows.join(F.broadcast(format_table(spark)), "suffix", "left")


def unsupported(files: DataFrame) -> DataFrame:
    """Files of an unknown format, or of one that can't be read here."""
    return files.filter(~F.col("suffix").isin(*PLAIN, *MARKUP, *RICH, *OFFICE, "csv")).select("doc_id", "suffix")


def texts(files: DataFrame) -> DataFrame:
    """doc_id, suffix, text, char_count of the readable files that aren't tables."""
    body = decoded(F.col("content"))
    plain = files.filter(F.col("suffix").isin(*PLAIN, *MARKUP, *RICH)).select("doc_id", "suffix", F.when(F.col("suffix").isin(*MARKUP), html_to_text(body)).when(F.col("suffix").isin(*RICH), rtf_to_text(body)).otherwise(body).alias("text"))
    office = files.filter(F.col("suffix").isin("docx", "pptx")).select("doc_id", "suffix", "content").mapInPandas(_office_texts, "doc_id string, suffix string, text string")
    return plain.unionByName(office).withColumn("char_count", F.length("text").cast("long"))


def _paragraphs(xml: bytes, space: str) -> list[str]:
    root = ElementTree.fromstring(xml)
    return ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def office_text(content: bytes, suffix: str) -> str:
    """The text of a DOCX (headers, body, footers, notes) or PPTX (slides, then their notes) by paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        if suffix == "docx":
            order = [r"word/header\d*\.xml", r"word/document\.xml", r"word/footer\d*\.xml", r"word/(?:foot|end)notes\.xml"]
            space = _W
        else:
            order, space = [r"ppt/slides/slide\d+\.xml", r"ppt/notesSlides/notesSlide\d+\.xml"], _A
        parts = [n for pattern in order for n in names if re.fullmatch(pattern, n)]
        return "\n".join(p for n in parts for p in _paragraphs(z.read(n), space) if p)


def _office_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "suffix": b["suffix"], "text": [office_text(c, s) for c, s in zip(b["content"], b["suffix"], strict=True)]})


def csv_rows(text: str) -> list[list[str]]:
    """Rows as they are, ragged ones too."""
    return list(csv.reader(io.StringIO(text, newline="")))


def xlsx_sheets(content: bytes) -> list[tuple[str, dict[tuple[int, int], str]]]:
    """Title and cached cell values of each sheet."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            found: dict[tuple[int, int], str] = {}
            for c in ElementTree.fromstring(z.read(name)).iter(f"{_S}c"):
                letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                v = c.find(f"{_S}v")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    value = shared[int(v.text)] if c.get("t") == "s" else ("True" if v.text == "1" else "False") if c.get("t") == "b" else v.text
                found[(int(number) - 1, col - 1)] = value
            out.append((sheet.get("name"), found))
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, suffix, content in zip(b["doc_id"], b["suffix"], b["content"], strict=True):
            if suffix == "csv":
                try:
                    text = content.decode()
                except UnicodeDecodeError:
                    text = content.decode("latin-1")
                # a blank line is a row of one empty cell, so that row numbers stay those of the file
                rows += [(doc_id, 0, r, c, v) for r, row in enumerate(csv_rows(text)) for c, v in enumerate(row or [""])]
            else:
                rows += [(doc_id, s, r, c, v) for s, (_, found) in enumerate(xlsx_sheets(content)) for (r, c), v in sorted(found.items())]
        yield pd.DataFrame(rows, columns=["doc_id", "sheet", "row", "col", "value"])


def cells(files: DataFrame) -> DataFrame:
    """The cells of CSV and XLSX files."""
    return files.filter(F.col("suffix").isin("csv", "xlsx")).select("doc_id", "suffix", "content").mapInPandas(_cells, CELLS)


def sheets(files: DataFrame) -> DataFrame:
    """doc_id, sheet, title of XLSX files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, i, t) for d, c in zip(b["doc_id"], b["content"], strict=True) for i, (t, _) in enumerate(xlsx_sheets(c))], columns=["doc_id", "sheet", "title"])

    return files.filter("suffix = 'xlsx'").select("doc_id", "content").mapInPandas(run, "doc_id string, sheet int, title string")


def deep_text(content: bytes) -> str:
    """All text of a zip archive's XML parts, tags as line ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.lower().endswith((".xml", ".rels", ".txt", ".vml"))]
    return "\n".join(re.sub(r"<[^>]*>", "\n", p) for p in parts)
