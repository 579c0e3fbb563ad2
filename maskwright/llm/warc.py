"""WARC archives: writing them from a page table, and reading them by boundary chains.

A record's end is known only from its own header, and a payload may hold the very
bytes that open a record.  So each reading task emits, for every place where those
bytes stand, the place where a record that began there would end; a record is real
if the chain from the start of its file reaches it, which pointer jumping finds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import attach, scratch_path, table, written

END = "\r\n\r\n"
MAGIC = b"WARC/1.1\r\n"
#: Records of an archive file, so that a task holds one bounded file at a time.
FILE_RECORDS = 1_000
#: Payloads below so many bytes are always written whole.
LEAST_BYTES = 100


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type and refers_to of each page."""
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # only digests and ids travel to find the first of equal payloads
    keys = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    repeated = written(keys.filter("copies > 1"), "equal-payloads")
    size = repeated.agg(F.count("*"), F.sum("copies")).first()
    if size[0] <= 200_000:  # 80 bytes each
        joined = rows.join(F.broadcast(repeated.drop("copies")), "payload_digest", "left")
    else:
        narrow = written(attach(rows.select("page_id", "payload_digest"), repeated, ["payload_digest"], "copies").filter("first_id is not null").select("page_id", "payload_digest", "first_id").distinct(), "revisits")
        joined = rows.join(narrow, ["page_id", "payload_digest"], "left")
    revisit = (F.col("payload_bytes") >= least) & (F.col("page_id") > F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archives(found: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes the rows of ``records`` as WARC 1.1 files below ``path``.

    Every record ends with an empty line twice, which is the line separator of
    Spark's text writer, so files are committed as any table's.  A revisit has no
    payload of its own; its header keeps the length and digest of the full one.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", "%0A")
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC.decode()), _line("WARC-Type", F.col("record_type")),
        F.coalesce(_line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.coalesce(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        _line("WARC-Payload-Length", F.col("payload_bytes").cast("string")), _line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    found.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


CANDIDATES = "file string, at long, next long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean"
_HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def _candidate(data: memoryview, whole: bytes, at: int) -> tuple | None:
    """The record that would begin at ``at``, or None if no header or end fits there."""
    stop = whole.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = {k.lower(): v for k, v in _HEADER.findall(whole, at + len(MAGIC), stop + 2)}
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        return None
    start = stop + 4
    after = start + int(size)
    if whole[after : after + 4] != END.encode():
        return None
    number = {k: int(m[1]) if (m := re.search(rb"(-?\d+)>?$", head.get(k, b""))) else None for k in (b"warc-record-id", b"warc-refers-to", b"warc-payload-length")}
    kind, said = head.get(b"warc-type", b"").decode("utf-8", "replace"), head.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:")
    if kind == "revisit":
        digest, length = said, number[b"warc-payload-length"]
    else:
        digest, length = hashlib.sha256(data[start:after]).hexdigest(), int(size)
    return after + 4, number[b"warc-record-id"], head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), kind, number[b"warc-refers-to"], length, digest, digest == said


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each place in the files where a record may begin, with its successor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CANDIDATES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = data.as_py()
                view, rows, at = memoryview(whole), [], whole.find(MAGIC)
                while at >= 0:
                    if one := _candidate(view, whole, at):
                        rows.append((name, at, *one))
                    at = whole.find(MAGIC, at + 1)
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _files(spark, path).select("path", "content").mapInArrow(run, CANDIDATES)


def reached(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of one file's candidates the chain from its start reaches.

    Pointer jumping: each round the reached ones double along the chain, as every
    candidate learns the place of the record 2^k further on.
    """
    order = np.argsort(at)
    place = at[order]
    found = np.searchsorted(place, after[order])
    end = len(place)  # stands for a place where no candidate is
    hit = (found < end) & (np.append(place, -1)[np.minimum(found, end)] == after[order])
    jump = np.append(np.where(hit, found, end), end)
    real = np.append(place == 0, False)
    while (jump < end).any():
        real[jump[np.flatnonzero(real)]] = True
        jump = jump[jump]
    out = np.zeros(end, bool)
    out[order] = real[:end]
    return out


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that belong to the chain from the start of their file.

    A file is one task's work in reading already, and its candidates are one
    group of short rows.
    """

    def run(rows: pa.Table) -> pa.Table:
        return rows.filter(pa.array(reached(rows.column("at").to_numpy(), rows.column("next").to_numpy())))

    return found.groupBy("file").applyInArrow(run, CANDIDATES)


def broken(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The files whose chain of records ends before the file does: file, length, ends."""
    files = _files(spark, path).select(F.col("path").alias("file"), "length")
    ends = found.groupBy("file").agg(F.max("next").alias("ends"))
    return files.join(ends, "file", "left").select("file", "length", F.coalesce("ends", F.lit(0)).alias("ends")).filter("ends <> length")


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of the archives: file, at, page_id, url, record_type, refers_to, payload_bytes, payload_digest, sound.

    ``sound`` tells whether the digest of the payload read is the header's.  A chain that
    doesn't reach its file's end, as after a wrong length, is an error; unless ``strict``,
    the records up to there come back and ``broken`` names the files.
    """
    found = written(reachable(candidates(spark, path)), "warc-records")
    if strict and (files := broken(spark, path, found).take(3)):
        raise ValueError("records can't be followed to the end of: " + ", ".join(f"{r.file} ({r.ends} of {r.length} bytes)" for r in files))
    return found.drop("next")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes one record per page below ``path`` and reads the archives back.

    Null payloads count as empty; null urls are written as empty; a null id gives a
    record without an id, which reads as null.  Of pages with one payload of at
    least 100 bytes, the rows with the smallest id are responses, also where that
    id repeats.  An empty table gives no rows.  Other columns aren't read.  A payload
    that doesn't have its header's digest is an error.
    """
    write_archives(records(pages), path)
    found = read_archives(pages.sparkSession, path)
    if wrong := found.filter("not sound").count():
        raise ValueError(f"{wrong} payloads differ from their digests")
    return found


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
