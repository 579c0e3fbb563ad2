"""CSV files of any size, read by ranges.

Spark's text reader deals a file's lines by byte ranges.  Whether a line begins a
record or goes on within quotes depends on all lines before it, so each range says how
it ends for both beginnings, the beginnings follow from range to range, and only then
are the cells read.  Of a record that crosses ranges the pieces meet in a shuffle; all
others are read where they are.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.sources.files import CELLS
from maskwright.sources.scratch import written

#: What is read of a line from within quotes, up to their end, and then from the start of a field or after closed quotes.
_QUOTED = re.compile(r'(?:[^"]|"")*("?)')
_FIELD = re.compile(r'[^,\r"][^,\r]*|"')
#: A carriage return alone ends a line too.
_CUT = re.compile(r"(?<=\r)(?!\n)")


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line (with its line end) ends within quotes, if it begins so or not."""
    at, size = 0, len(line)
    while True:
        if quoted:
            m = _QUOTED.match(line, at)
            if not m[1]:
                return True
            at, quoted = m.end(), False
            # what follows the closing quote up to the comma is plain text
            while at < size and line[at] not in ",\r\n":
                at += 1
        else:
            while at < size and line[at] in ",\r\n":
                at += 1
            if at >= size:
                return False
            m = _FIELD.match(line, at)
            at, quoted = m.end(), m[0] == '"'


def pieces(content: bytes, valid: bool) -> str:
    """A line's bytes as text, as UTF-8 where the whole file is valid."""
    return content.decode("utf-8" if valid else "latin-1")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files below ``path`` as bytes: doc_id, range (its first byte), content; in order within a range."""
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return found.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("content"))


def _by_range(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of one range each, in order, with the range's values of ``columns``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        begin = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[begin]:
                yield keys[begin], batch.slice(begin, k - begin)
                begin = k


def range_ends(rows: DataFrame) -> DataFrame:
    """How each range ends: doc_id, range, valid, out (quoted_0 and quoted_1: if it begins outside or within quotes).

    ``begun_0`` and ``begun_1`` count the records that begin in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            columns = [[x] for x in (*key, *state)]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "range", "valid", "quoted_0", "quoted_1", "begun_0", "begun_1"])

        for own, part in _by_range(batches, ["doc_id", "range"]):
            if own != key:
                if key is not None:
                    yield done()
                key, state = own, [True, False, True, 0, 0]
            for content in part.column("content").to_pylist():
                if state[0]:
                    try:
                        content.decode()
                    except UnicodeDecodeError:
                        state[0] = False
                plain = b'"' not in content
                if plain and b"\r" not in content[:-1]:
                    state[3], state[4] = state[3] + (not state[1]), state[4] + (not state[2])
                    continue
                for text in _CUT.split(content.decode("latin-1") + "\n"):  # only ASCII decides, which both encodings have alike
                    for k in (0, 1):
                        state[3 + k] += not state[1 + k]
                        state[1 + k] = ends_quoted(text, state[1 + k])
        if key is not None:
            yield done()

    return rows.mapInArrow(run, "doc_id string, range long, valid boolean, quoted_0 boolean, quoted_1 boolean, begun_0 long, begun_1 long")


def beginnings(ends: DataFrame) -> DataFrame:
    """Where each range stands: doc_id, range, valid (of the whole file), quoted (at its beginning), before (records begun earlier).

    A row a range, of 128 MB or so by default, is ordered by file.
    """
    order = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # following both beginnings through all ranges before is a fold over a few bytes each
    earlier = F.collect_list(F.struct("quoted_0", "quoted_1", "begun_0", "begun_1")).over(order)
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(earlier, start, lambda s, e: F.struct(F.when(s["quoted"], e["quoted_1"]).otherwise(e["quoted_0"]).alias("quoted"), (s["n"] + F.when(s["quoted"], e["begun_1"]).otherwise(e["begun_0"])).alias("n")))
    valid = F.min("valid").over(Window.partitionBy("doc_id"))
    return ends.select("doc_id", "range", valid.alias("valid"), fold.alias("s")).select("doc_id", "range", "valid", F.col("s.quoted").alias("quoted"), F.col("s.n").alias("before"))


RECORDS = "doc_id string, row long, piece long, open boolean, text string"


def records(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces of records: doc_id, row (in the file), piece (its range's first byte), open, text.

    A record within one range is one piece; what a range has of a record that began
    earlier, or that goes on in the next, is ``open``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quoted, row, held, out = None, False, 0, [], []

        def close(open_: bool) -> None:
            if held:
                out.append((key[0], row, key[1], open_ or held_open, "".join(held)))
                held.clear()

        held_open = False
        for own, part in _by_range(batches, ["doc_id", "range", "valid", "quoted", "before"]):
            if own != key:
                if key is not None:
                    close(quoted)
                key, quoted = own, own[3]
                row, held_open = own[4] - 1, quoted
            for content in part.column("content").to_pylist():
                line = pieces(content, key[2]) + "\n"
                for text in _CUT.split(line) if "\r" in line else [line]:
                    if not quoted:
                        close(False)
                        row, held_open = row + 1, False
                    held.append(text)
                    if '"' in text:
                        quoted = ends_quoted(text, quoted)
            if len(out) >= 1000:
                yield _batch(out)
                out.clear()
        if key is not None:
            close(quoted)
        yield _batch(out)

    return rows.join(F.broadcast(starts), ["doc_id", "range"]).select("doc_id", "range", "valid", "quoted", "before", "content").mapInArrow(run, RECORDS)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "piece", "open", "text"])


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of CSV files: doc_id (the path), sheet, row, col, value; as ``files.cells``, whatever the ranges.

    A blank line is a row of one empty cell.  A file that isn't valid UTF-8 is Latin-1 as
    a whole.  A byte order mark is dropped; quotes that a file never closes are closed by
    a line end.  A file whose lines end with CR alone comes as one range.
    """
    rows = lines(spark, path)
    starts = written(beginnings(written(range_ends(rows), "ranges")), "ranges")
    found = written(records(rows, starts), "records")
    whole = found.filter("not open").select("doc_id", "row", "text")
    crossing = found.filter("open").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    joined = crossing.select("doc_id", "row", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                for values in csv.reader(io.StringIO(text, newline="")):
                    out += [(doc_id, 0, row, c, v) for c, v in enumerate(values or [""])]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "sheet", "row", "col", "value"])

    return whole.unionByName(joined).mapInArrow(run, CELLS)
