"""Ranked lexical search by sort-based accumulation.

The queries go to the tasks in blocks, as a vocabulary with the items that hold each
term.  One pass over the texts counts what the weights need; a second one finds the
terms of each document, lays the arrays of (item, document, impact) of all matched
terms end to end, sorts their packed keys by radix and adds up runs of equal keys.
A heap per item keeps the best of a task, and Spark ranks what the tasks kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import Words, slices, small_batches, table, written

#: Documents of an item's result.
TOP = 20
#: Bytes of query text in a block, which is sent to all tasks; a longer item is a block of its own.
BLOCK_BYTES = 4 << 20
#: Impacts that are sorted at a time, if no single document has more.
IMPACTS = 1 << 21
#: Partial results of an item that are ranked in one step are dealt to so many groups first.
GROUPS = 64
# Weights of a term and of its number and a text's length.
K1_B, K1_REST, SCALE = 25, 75, 1_000_000_000

#: Every byte that belongs to no term as a space, A-Z as a-z.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


class Terms(Words):
    """The terms of a slice of texts: runs of ASCII letters and digits and of all that isn't ASCII."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        texts = pa.concat_arrays([texts])  # offsets from zero
        _, offsets, data = texts.buffers()
        plain = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_TERM_BYTES))
        super().__init__(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, plain]), lower=False)


class Queries:
    """A block of items: their distinct terms, and the items of each term with its number of times."""

    def __init__(self, texts: list[str]):
        found = Terms(pa.array(texts, pa.string()))
        self.items = len(texts)
        self.terms: list[str] = found.dictionary
        item = np.repeat(np.arange(self.items), np.diff(found.offsets))
        key, times = np.unique(found.index.astype(np.int64) * max(1, self.items) + item, return_counts=True)
        term = key // max(1, self.items)
        self.holder, self.times = key % max(1, self.items), times.astype(np.int64)
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))

    @cached_property
    def known(self) -> pa.Array:
        return pa.array(self.terms, pa.string())

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, terms and times of the pairs that match, and the number of all terms of each document."""
        found = Terms(texts)
        size = np.diff(found.offsets)
        at = pc.fill_null(pc.index_in(found.chunks, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = at[found.index] if len(at) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(size)), size)[term >= 0]
        key, times = np.unique(doc * max(1, len(self.terms)) + term[term >= 0], return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), times.astype(np.int64), size


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by their digits of 16 bits, least first."""
    order = np.arange(len(keys))
    top, shift = int(keys.max()) if len(keys) else 0, 0
    while shift == 0 or top >> shift:
        digit = ((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16 bits by radix
        shift += 16
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of impacts of each (item, document), from the arrays of all matched terms end to end."""
    keys = item.astype(np.uint64) * np.uint64(max(1, docs)) + doc.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    total = np.add.reduceat(impact[order], first) if len(first) else np.zeros(0, np.int64)
    keys = keys[first].astype(np.int64)
    return keys // max(1, docs), keys % max(1, docs), total


class Best:
    """Of each item the documents of highest score, then least id, in heaps; null ids stand last."""

    def __init__(self, most: int):
        self.most = most
        self.heaps: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list[int | None]) -> None:
        """Takes what can still enter: rows stand by item, and of each only its best are pushed; ``ids`` by ``doc``."""
        for a, b in zip(*(x.tolist() for x in _runs(item)), strict=True):
            own = score[a:b]
            heap = self.heaps.setdefault(int(item[a]), [])
            least = heap[0][0] if len(heap) == self.most else 1
            if b - a > self.most:
                least = max(least, int(np.partition(own, len(own) - self.most)[len(own) - self.most]))
            for k in np.flatnonzero(own >= least).tolist():
                i = ids[doc[a + k]]
                one = (int(own[k]), -i if i is not None else -(1 << 63), 0 if i is None else 1)
                if len(heap) < self.most:
                    heapq.heappush(heap, one)
                elif one > heap[0]:
                    heapq.heapreplace(heap, one)

    def rows(self) -> pa.RecordBatch:
        out = [(item, -i if known else None, score) for item, heap in self.heaps.items() for score, i, known in heap]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    edge = np.flatnonzero(np.diff(values)) + 1
    first = np.concatenate([[0], edge]) if len(values) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(values)) if len(values) else first


def _statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """The number of documents with a term, of all terms, and of the documents that hold each query term."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        holding, some, total = np.zeros(len(q.terms), np.int64), 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                _, term, _, size = q.counts(batch.column("text"))
                holding += np.bincount(term, minlength=len(q.terms))
                some, total = some + int((size > 0).sum()), total + int(size.sum())
        at = np.flatnonzero(holding)
        key, n = np.concatenate([[-2, -1], at]), np.concatenate([[some, total], holding[at]])
        yield pa.record_batch([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held, some, total = np.zeros(len(queries.terms), np.int64), 0, 0
    for term, n in sums.toLocalIterator():  # a row for each term of the block at most
        if term == -2:
            some = n
        elif term == -1:
            total = n
        else:
            held[term] = n
    return some, total, held


def weights(n: int, held: np.ndarray) -> np.ndarray:
    """The whole weight of terms that so many of ``n`` documents hold."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64)


def _best_of_tasks(docs: DataFrame, queries: Queries, some: int, total: int, held: np.ndarray, top: int) -> DataFrame:
    """The best documents of each item in each task: item, doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast((queries, weights(some, held)))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = shared.value
        best = Best(top)
        span = np.diff(q.starts)
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, term, times, size = q.counts(batch.column("text"))
                length = K1_REST + K1_B * size.astype(np.int64) * some // max(1, total)
                impact = weight[term] * (SCALE * times // (1000 * times + 12 * length[doc]))
                some_left = impact > 0
                doc, term, impact = doc[some_left], term[some_left], impact[some_left]
                ids = batch.column("doc_id").to_pylist()
                for a, b in _parts(doc, span[term]):
                    n = span[term[a:b]]
                    at = np.repeat(q.starts[term[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    base = int(doc[a])
                    item, d, score = accumulated(q.holder[at], np.repeat(doc[a:b] - base, n), np.repeat(impact[a:b], n) * q.times[at], int(doc[b - 1]) - base + 1)
                    best.add(item, d + base, score, ids)
        yield best.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item long, doc_id long, score long")


def _parts(doc: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of whole documents with about IMPACTS impacts together, or one document of more."""
    first, end = _runs(doc)
    if not len(first):
        return
    upto = np.cumsum(size)[end - 1]
    part = (upto - 1) // IMPACTS
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(first)).tolist(), strict=True):
        yield int(first[a]), int(end[b - 1])


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score.

    Every row and whole text of ``docs`` (doc_id, text) is ranked for every row of
    ``items`` (item_id, text).  Rows of items that are equal in both columns are one
    query; other rows of a repeated item_id are ranked each, as is a null item_id.
    Repeated documents are ranked each; equal scores stand by id, null ids last.  Null,
    empty and termless texts match nothing, and an empty table gives no rows.  Items go
    to the tasks in blocks of about BLOCK_BYTES, each with its own passes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    queries = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().filter("text is not null"), "queries")
    blocks = max(1, -(-(queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(own.toArrow().to_pylist(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"]))  # a block, of bounded size
        block = Queries([r["text"] for r in rows])
        found = _best_of_tasks(texts, block, *_statistics(texts, block), top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        one = _ranked(found, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as bounded as its block
        out = one if out is None else out.unionByName(one)
    return out


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of the tasks' best, in two steps, so that no task gets all rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = Window.partitionBy("item", "part").orderBy(*order)
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS("text")} AS l FROM documents),
c AS (SELECT count(*) FILTER (len(l) > 0)::BIGINT AS n_docs, coalesce(sum(len(l)), 0)::BIGINT AS n_terms FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS("text")}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT r, doc_id, len(l)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, l, unnest(l) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(times * w * (({SCALE}::BIGINT * tf) // (1000 * tf + 12 * ({K1_REST} + ({K1_B} * n * n_docs) // n_terms))))::BIGINT AS score FROM t JOIN w USING (term) JOIN i USING (term), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
