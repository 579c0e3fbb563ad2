"""Exact duplicates through a sharded cuckoo-filter index.

The index has shards by digest.  A shard is a cuckoo filter (two candidate
buckets of four 16-bit fingerprints for a digest) over its live digests, and the
stored keys themselves by bucket.  A probe that finds no fingerprint proves that
the digest is new; a hit is verified against the keys stored in that bucket.  A
filter that overflows is built again at twice the size from the stored keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import attach, small_batches, table, written

SPACES = b" \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 200
#: Digests that a shard is meant to hold.
SHARD_KEYS = 50_000
#: Distinct digests that a task holds while it combines equal ones.
HELD = 100_000


class CuckooShard:
    """One shard: a cuckoo filter and the live keys, each with its row counts and best row."""

    def __init__(self, expected: int = 64):
        self.buckets = 1 << max(4, int(expected / SLOTS / 0.85).bit_length())
        self.stored: dict[bytes, list] = {}
        self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros((self.buckets, SLOTS), np.uint16).tolist()
        self.content: list[list[bytes]] = [[] for _ in range(self.buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & (self.buckets - 1))

    def maybe(self, key: bytes) -> bool:
        """False proves that the key isn't live."""
        p, i, j = self._places(key)
        return p in self.table[i] or p in self.table[j]

    def find(self, key: bytes) -> list | None:
        """The value of a live key; a fingerprint's hit is verified by the stored keys."""
        if not self.maybe(key):
            return None
        _, first, _ = self._places(key)
        return self.stored[key] if key in self.content[first] else None

    def _enter(self, key: bytes) -> bool:
        p, i, j = self._places(key)
        for b in (i, j):
            if 0 in self.table[b]:
                self.table[b][self.table[b].index(0)] = p
                return True
        b = i
        for kick in range(KICKS):
            slot = kick % SLOTS
            p, self.table[b][slot] = self.table[b][slot], p
            b = self._other(b, p)
            if 0 in self.table[b]:
                self.table[b][self.table[b].index(0)] = p
                return True
        return False

    def insert(self, key: bytes, value: list) -> None:
        """Enters a key that isn't live."""
        self.stored[key] = value
        if self._enter(key):
            self.content[self._places(key)[1]].append(key)
            return
        placed = False
        while not placed:
            self.buckets *= 2
            self.resizes += 1
            self._clear()
            placed = all(self._enter(k) for k in self.stored)
        for k in self.stored:
            self.content[self._places(k)[1]].append(k)

    def delete(self, key: bytes) -> bool:
        """Takes out a live key with one copy of its fingerprint."""
        if self.find(key) is None:
            return False
        p, i, j = self._places(key)
        b = i if p in self.table[i] else j
        self.table[b][self.table[b].index(p)] = 0
        self.content[i].remove(key)
        del self.stored[key]
        return True


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``code_points`` of the text as it is, ``digest`` of the text without white space.

    Null text counts as empty.  One pass over the texts without a shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            # every byte of UTF-8 but a continuation byte begins a code point
            points = [int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)) for t in texts]
            found = [hashlib.sha256(t.translate(None, SPACES)).digest() for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(points, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "code_points", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, code_points long, digest binary")


def _better(points: int, keep: int | None, live: list) -> bool:
    return (points, keep is not None, -(keep or 0)) > (live[0], live[1] is not None, -(live[1] or 0))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a task as one row, HELD digests at a time, so that a hot digest sends a row a task."""
    found: dict[bytes, list] = {}

    def rows() -> pa.RecordBatch:
        columns = list(zip(*found.values(), strict=True)) or [[], [], []]
        return pa.record_batch([pa.array(list(found), pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=["digest", "code_points", "keep_id", "n"])

    for batch in batches:
        for key, points, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            live = found.setdefault(key, [points, keep, 0])
            live[2] += 1
            if _better(points, keep, live):
                live[0], live[1] = points, keep
        if len(found) >= HELD:
            yield rows()
            found.clear()
    yield rows()


def changes(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of ``digests`` combined within each task: shard, digest, code_points, keep_id, n.

    Copies that different tasks have meet in the index alone.
    """
    part = rows.select("digest", "code_points", "doc_id").mapInArrow(_combined, "digest binary, code_points long, keep_id long, n long")
    return part.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "code_points", "keep_id", "n")


KEYS = "shard int, digest binary, code_points long, keep_id long, n long, resizes int"


def _apply(stored: pa.Table | None, delta: pa.Table) -> pa.Table:
    old = [] if stored is None else list(zip(*(stored.column(c).to_pylist() for c in ("digest", "code_points", "keep_id", "n")), strict=True))
    new = list(zip(*(delta.column(c).to_pylist() for c in ("digest", "code_points", "keep_id", "n")), strict=True))
    shard = CuckooShard(len(old) + len(new))
    for key, points, keep, n in old:
        shard.insert(key, [points, keep, n])
    for key, points, keep, n in sorted(new, key=lambda x: x[3] < 0):  # deletions last
        live = shard.find(key)
        if n < 0:
            if live is not None:
                live[2] += n
                if live[2] <= 0:
                    shard.delete(key)
        elif live is None:
            shard.insert(key, [points, keep, n])
        else:
            live[2] += n
            if _better(points, keep, live):
                live[0], live[1] = points, keep
    no = (delta if delta.num_rows else stored).column("shard")[0].as_py()
    count, values = len(shard.stored), list(zip(*shard.stored.values(), strict=True)) or [[], [], []]
    return pa.table({
        "shard": pa.array([no] * count, pa.int32()), "digest": pa.array(list(shard.stored), pa.binary()),
        "code_points": pa.array(values[0], pa.int64()), "keep_id": pa.array(values[1], pa.int64()),
        "n": pa.array(values[2], pa.int64()), "resizes": pa.array([shard.resizes] * count, pa.int32()),
    })


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """A new index over ``rows`` of ``digests``: the stored keys of every shard."""

    def run(delta: pa.Table) -> pa.Table:
        return _apply(None, delta)

    return changes(rows, shards).groupBy("shard").applyInArrow(run, KEYS)


def update_index(index: DataFrame, inserted: DataFrame | None, deleted: DataFrame | None, shards: int, live: DataFrame | None = None) -> DataFrame:
    """The index after insertion and deletion of rows of ``digests``.

    A digest leaves the index when its last row is deleted; deleting one that isn't
    live changes nothing.  Where the kept row of a digest that stays was deleted, the
    best of ``live`` (the rows of ``digests`` that are left) takes its place; without
    ``live`` the entry stays as it was.
    """
    parts = ([changes(inserted, shards)] if inserted is not None else []) + ([changes(deleted, shards).withColumn("n", -F.col("n"))] if deleted is not None else [])
    delta = parts[0]
    for p in parts[1:]:
        delta = delta.unionByName(p)

    after = index.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(_apply, KEYS)
    if live is None or deleted is None:
        return after
    after = written(after, "cuckoo-index")
    lost = after.join(deleted.select("digest", F.col("doc_id").alias("keep_id")).distinct(), ["digest", "keep_id"], "left_semi").select("digest")
    best = live.join(lost, "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("code_points", (-F.col("doc_id")).alias("neg"))).alias("best"))
    new = after.join(best, "digest", "left")
    return new.withColumn("code_points", F.coalesce("best.code_points", "code_points")).withColumn("keep_id", F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(-F.col("best.neg"))).select(after.columns)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``.  Of equal texts the one with the most code points in the
    original text, then the smallest id, stays.  Null and empty texts are equal and
    all white space too.  Repeated rows of an id each get a row and all count; each of
    them is kept if its id is.  Rows with a null id count in their group but are
    kept only if the group has no other id.  An empty table gives no rows.  Only the
    two named columns are read.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    shards = max(1, -(-rows.count() // SHARD_KEYS))
    index = written(build_index(rows, shards), "cuckoo-index")
    found = attach(rows, index.select("digest", "keep_id", F.col("n").alias("group_size")), ["digest"], "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
