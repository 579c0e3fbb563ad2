"""What several operators of this subpackage share.

Words are always the runs of ``[^\\x20\\x09-\\x0D]+`` of the whole text, with A-Z
lower-cased and nothing else changed.  Inside a task a batch of texts is turned
into one flat array of 64-bit word hashes plus the offsets of each text, so all
later work is done on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.scratch import scratch_path, shared_dir, written  # noqa: F401

#: A batch of texts is worked on in slices of about so many bytes.
SLICE_BYTES = 3 << 20
#: A side of a join may be broadcast up to this number of rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that one task may get, where there are fewer than a thousand times as many.
HOT_ROWS = 5_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as a text may have a hundred thousand characters."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't among ``dropped``; rows with a null id stay."""
    ids = written(dropped.select(id_col).distinct(), "dropped")
    return docs.join(maybe_broadcast(ids, ids.count()), id_col, "left_anti").select(docs.columns)


#: The column that tells rows apart, and the one that marks rows of a repeated id.
ROW, REPEATED = "_row", "_repeated"


def with_row_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the long ``_row``, which tells different rows apart, and boolean ``_repeated``.

    ``_row`` is the id; where an id has different texts, one of them (that of the least
    hash) has it and the others a hash of id and text, so that only rows equal in both
    share it.  A null id stays null.  Ids are counted in a narrow shuffle; only texts
    of repeated ids are read for it.
    """
    same = written(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("_id")), "repeated-ids")
    some = same.count()
    own = F.col(id_col).cast("long")
    if not some:
        return docs.withColumns({ROW: own, REPEATED: F.lit(False)})
    digest = F.xxhash64(id_col, text_col)
    least = docs.join(maybe_broadcast(same, some), F.col(id_col) == F.col("_id"), "left_semi").groupBy(F.col(id_col).alias("_id")).agg(F.min(digest).alias("_least"))
    marked = docs.join(maybe_broadcast(written(least, "repeated-ids"), some), F.col(id_col) == F.col("_id"), "left").withColumn(REPEATED, F.col("_id").isNotNull())
    return marked.withColumn(ROW, F.when(F.col("_least") != digest, digest).otherwise(own)).drop("_id", "_least")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` with one row of ``groups`` per key, safe against hot keys.

    Groups of more than max(hot, total / 1000) rows number at most 1000 and are
    broadcast; rows of the others meet in a shuffle, where no key has more than
    that many rows.  Rows with a null key get nulls and aren't shuffled.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    bound = max(hot, (total or 0) // 1000)
    empty = F.coalesce(*(F.when(F.col(k).isNull(), True) for k in keys), F.lit(False))
    known = rows.filter(~empty)
    parts = [rows.filter(empty)]
    if (most or 0) > bound:
        large = groups.filter(F.col(size) > bound)
        known = known.join(F.broadcast(large.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
        parts.append(known.filter("_hot").drop("_hot").join(F.broadcast(large), keys, "left"))
        known, groups = known.filter("_hot is null").drop("_hot"), groups.filter(F.col(size) <= bound)
    out = known.join(groups, keys, "left")
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def meet(rows: DataFrame, one: DataFrame, keys: list[str], spread: str, hot: int = HOT_ROWS, at_most: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has a row per key, safe against hot keys.

    Where a key has more than max(hot, total / 1000) rows, they are dealt by the
    column ``spread`` to parts of about that size, and the key's row of ``one`` is
    repeated for each part: under 2,000 rows more in all.  A known bound of the number
    of rows (``at_most``) saves counting where no key can be hot.
    """
    if at_most is not None and at_most <= hot:
        return rows.join(one, keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_c"))
    total, most = sizes.agg(F.sum("_c"), F.max("_c")).first()
    bound = max(hot, (total or 0) // 1000)
    if (most or 0) <= bound:
        return rows.join(one, keys)
    large = F.broadcast(sizes.filter(F.col("_c") > bound).select(*keys, F.ceil(F.col("_c") / bound).cast("int").alias("_parts")))
    dealt = rows.join(large, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    spare = one.join(large, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return dealt.join(spare, [*keys, "_part"]).drop("_part")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about SLICE_BYTES of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, int)
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()  # workers live on from one operator to the next


class Words:
    """The words of a slice of texts: ``index`` into ``dictionary``, ``offsets`` by text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        # no cast to large_string: of a slice it keeps offsets that ascii_lower misreads
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        index = flat.indices.to_numpy()
        self.chunks: pa.Array = flat.dictionary
        nothing = pc.index(self.chunks, "").as_py()
        if nothing >= 0:  # before leading and after trailing white space
            keep = index != nothing
            total = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
            index, offsets = index[keep], total[offsets - offsets[0]]
        self.index, self.offsets = index, offsets - offsets[0]

    @cached_property
    def dictionary(self) -> list[str]:
        return self.chunks.to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.dictionary), np.uint64, len(self.dictionary))
        return one[self.index]


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text in order, and their offsets by text.

    A text with fewer words has its whole sequence as its only gram, an empty one none.
    """
    count = np.diff(offsets)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_offsets = np.concatenate([[0], np.cumsum(grams)])
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    value = np.zeros(len(words), np.uint64)
    for k in range(n):
        value = (value + padded[k : k + len(words)]) * _STEP
    short = np.flatnonzero((count > 0) & (count < n))
    for d in short:  # beyond its end stand the words of the next text
        v = np.uint64(count[d])
        with np.errstate(over="ignore"):
            for w in words[offsets[d] : offsets[d + 1]]:
                v = (v + w) * _STEP
        value[offsets[d]] = v
    at = np.repeat(offsets[:-1] - out_offsets[:-1], grams) + np.arange(out_offsets[-1])
    return mix(value[at]), out_offsets


def crc32_fold(column: str | Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; null ids give null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % F.lit(parts)
