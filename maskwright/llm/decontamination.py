"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One pass over the corpus finds every place where an n-gram of a test item stands;
each is a seed.  An item whose words can't reach the least score in a document is
passed over by an upper bound; passages around the seeds of the others are aligned
with their items word by word, so edited and paraphrased copies score too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import BROADCAST_ROWS, Words, ngrams, slices, small_batches, table

#: Words of a seed.
SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: The share of an item's highest possible score from which a document counts as a copy.
LEAST_SCORE = 0.5


class Index:
    """The items that go to the tasks: their words, and where each of their n-grams stands."""

    def __init__(self, rows: list[tuple[int, str]], words: int):
        found = Words(pa.array([r[1] for r in rows], pa.string()))
        self.ids, self.words, self.hashes, self.offsets = [r[0] for r in rows], words, found.hashes(), found.offsets
        self.sizes = np.diff(found.offsets)
        grams, self.gram_offsets = ngrams(self.hashes, found.offsets, words)
        self.grams = grams
        item = np.repeat(np.arange(len(rows)), np.diff(self.gram_offsets))
        self.known, inverse = np.unique(grams, return_inverse=True)
        pairs = np.unique(np.stack([inverse, item], 1), axis=0) if len(grams) else np.zeros((0, 2), np.int64)
        self.holders = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))

    def item(self, k: int) -> np.ndarray:
        return self.hashes[self.offsets[k] : self.offsets[k + 1]]

    def candidates(self, hit: np.ndarray, text: np.ndarray, least: float) -> np.ndarray:
        """The items that have one of the known n-grams ``hit`` and enough words of the text for the least score."""
        items = np.unique(np.concatenate([self.holders[self.starts[g] : self.starts[g + 1]] for g in hit]))
        own = np.unique(text)
        return np.array([k for k in items if bound(self.item(k), own) >= least], np.int64)

    def places(self, k: int, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where item ``k`` would begin in the text by each of its n-grams that stands there."""
        mine = self.grams[self.gram_offsets[k] : self.gram_offsets[k + 1]]
        order = np.argsort(mine, kind="stable")
        left, right = np.searchsorted(mine[order], grams, "left"), np.searchsorted(mine[order], grams, "right")
        count = right - left
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        return np.repeat(places, count) - order[at]


def bound(item: np.ndarray, own: np.ndarray) -> float:
    """A share that no alignment of the item with words among ``own`` (ascending) exceeds.

    Within an alignment a word of the item matches or costs a mismatch or a gap.
    """
    if not len(own):
        return 0.0
    present = own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item
    total = np.concatenate([[0], np.cumsum(np.where(present, MATCH, max(MISMATCH, GAP)))])
    return int((total - np.minimum.accumulate(total)).max()) / (MATCH * len(item))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int]:
    """Smith-Waterman with linear gaps: the share of the item's best score, matched words, and the span in the passage.

    A row of the table at a time; what a gap in the passage carries to the right
    is a running maximum.
    """
    n = len(passage)
    step = np.arange(n + 1) * -GAP
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, end, begin = 0, 0, 0
    for w in item:
        same = passage == w
        diagonal = row[:-1] + np.where(same, MATCH, MISMATCH)
        up = row[1:] + GAP
        value = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        origin = np.concatenate([[0], np.where(diagonal >= up, start[:-1], start[1:])])
        origin[value == 0] = np.flatnonzero(value == 0)
        lifted = value + step
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, start = top - step, origin[source]
        at = int(row.argmax())
        if row[at] > best:
            best, end, begin = int(row[at]), at, int(start[at])
    return best / (MATCH * len(item)) if len(item) else 0.0, best, begin, end


ALIGNED = "doc_id long, item_id long, score double, begin long, end long, item_words long, seeds long"


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, words: int = SEED_WORDS) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, begin, end, item_words, seeds.

    ``score`` is the alignment's share of the highest score that the item can have;
    ``begin`` and ``end`` are word offsets of the best passage, ``seeds`` the places
    where an n-gram of the item stands.  Words are as everywhere in this subpackage.
    A copy in which no ``words`` words in a row are left isn't looked for.  An item of
    fewer words than a seed is found in documents of the same words alone.  Null or
    empty texts and items, and rows with null ids, match nothing; rows that repeat an
    id are one document where their texts are equal; items that repeat an id are looked
    for each, and the best one counts; of passages that tie the first does.  Empty tables give no rows.  Other columns aren't read.

    The items are sent to the tasks while their words number at most
    BROADCAST_ROWS; a larger set is worked off in as many parts by item.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null").distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    parts = max(1, -(-total // BROADCAST_ROWS))
    out = None
    for part in range(parts):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part
        one = _contaminated(docs, items.filter(mine), least, words)
        out = one if out is None else out.unionByName(one)
    return out


def _contaminated(docs: DataFrame, items: DataFrame, least: float, words: int) -> DataFrame:
    rows = [(r[0], r[1]) for r in items.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").collect()]  # at most about BROADCAST_ROWS words
    shared = docs.sparkSession.sparkContext.broadcast(Index(rows, words))
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def found_in(index: Index, text: np.ndarray, grams: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
        hit = np.unique(np.searchsorted(index.known, grams))
        for k in index.candidates(hit, text, least):
            item, size = index.item(k), int(index.sizes[k])
            begins = index.places(k, grams, places)
            half = max(1, size // 2)
            best = None
            for a, b in _stretches(np.unique(begins // half).tolist(), half, size, len(text)):
                if b - a < len(text) and bound(item, np.unique(text[a:b])) < least:
                    continue
                score, _, begin, end = align(item, text[a:b])
                if best is None or score > best[0]:
                    best = (score, a + begin, a + end)
            if best and best[0] >= least:
                yield index.ids[k], *best, size, len(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Words(batch.column("text"))
                hashes, out = found.hashes(), []
                grams, offsets = ngrams(hashes, found.offsets, index.words)
                if len(index.known) and len(grams):
                    hits = np.flatnonzero(index.known[np.minimum(np.searchsorted(index.known, grams), len(index.known) - 1)] == grams)
                else:
                    hits = np.zeros(0, np.int64)
                row = np.searchsorted(offsets, hits, "right") - 1
                ids = batch.column("doc_id")
                for i in np.unique(row).tolist():
                    mine = hits[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
                    text = hashes[found.offsets[i] : found.offsets[i + 1]]
                    out += [(ids[i].as_py(), *r) for r in found_in(index, text, grams[mine], mine - offsets[i])]
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = docs.mapInArrow(run, ALIGNED)
    best = F.max(F.struct("score", (-F.col("begin")).alias("before"), "end", "item_words", "seeds"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", (-F.col("b.before")).alias("begin"), "b.end", "b.item_words", "b.seeds")


def _stretches(halves: list[int], half: int, item_words: int, words: int) -> list[tuple[int, int]]:
    """Word ranges that hold an item beginning in any of the given half-item steps, near ones as one."""
    out: list[list[int]] = []
    for h in halves:
        a, b = max(0, h * half - item_words), min(words, h * half + half + 2 * item_words)
        if out and a <= out[-1][1] and b - out[-1][0] <= 16 * item_words:
            out[-1][1] = b
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
