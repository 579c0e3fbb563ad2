"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is binned and has a lookup table of one value per bin; pairs
of features have two-way tables.  Boosting goes round the features in turn and adds
a shallow tree over the bins of one table at a time, so the model stays a sum of
tables, and a score is a sum of lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.classifier import labelled_sample
from maskwright.llm.common import Words, crc32_fold, slices, small_batches, table

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 8_000
BINS, PAIR_BINS = 48, 12
CYCLES, PAIR_CYCLES, PAIRS = 60, 40, 6
RATE, LEAF_WEIGHT = 0.2, 4.0

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "stops", "shouts", "spaces", "not_ascii",
    "distinct_words", "adjacent_repeats", "top_word", "repeated_lines", "line_words", "single_words", "symbol_ends",
)

SYMBOL_ENDS = set("#$%&*!@^~|")
_KINDS = ["upper", "lower", "digits", "symbols", "stops", "shouts", "spaces", "not_ascii", "other", "continued"]
_KIND = np.full(256, _KINDS.index("other"), np.uint8)
for _name, _bytes in {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "symbols": b"#$%&*|@^~<>=+_\\{}[]", "stops": b".,;:?",
    "shouts": b"!", "spaces": b" \t\n\x0b\x0c\r", "not_ascii": range(0xC0, 256), "continued": range(0x80, 0xC0),
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; empty and null texts have zeros."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    raw = [t.encode() for t in texts.to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, n)
    kinds = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(n), size)
    count = np.bincount(owner * len(_KINDS) + kinds, minlength=n * len(_KINDS)).reshape(n, -1).astype(np.float64)
    of = dict(zip(_KINDS, count.T, strict=True))
    chars = np.maximum(1, size - of["continued"])

    words = Words(texts)
    per = np.diff(words.offsets)
    total = np.maximum(1, per)
    who = np.repeat(np.arange(n), per)
    kind, times = np.unique(who * max(1, len(words.dictionary)) + words.index, return_counts=True)
    row = kind // max(1, len(words.dictionary))
    distinct, once = np.bincount(row, minlength=n), np.bincount(row, times == 1, n)
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    same = np.zeros(len(words.index), bool)
    same[1:] = (words.index[1:] == words.index[:-1]) & (who[1:] == who[:-1])
    ends = np.fromiter((w[-1:] in SYMBOL_ENDS for w in words.dictionary), bool, len(words.dictionary))[words.index]
    lines = [[x for x in t.split(b"\n") if x] for t in raw]
    line_count = np.array([max(1, len(x)) for x in lines])
    repeats = np.array([len(x) - len(set(x)) for x in lines])
    letters = np.maximum(1, of["upper"] + of["lower"] + of["not_ascii"])
    return np.column_stack([
        np.log1p(per), chars / total, of["upper"] / letters, of["digits"] / chars, of["symbols"] / chars, of["stops"] / chars, of["shouts"] / chars, of["spaces"] / chars,
        of["not_ascii"] / chars, distinct / total, np.bincount(who, same, n) / total, top / total, repeats / line_count, per / line_count, once / total, np.bincount(who, ends, n) / total,
    ])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (f, g), t in self.pairs.items():
            out += t[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    found = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    # a cut just above the lowest value too, as many texts have none of a thing
    return np.unique(np.append(found, np.nextafter(x.min(), np.inf)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + LEAF_WEIGHT) + gr**2 / (hr + LEAF_WEIGHT)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The step of each bin by a shallow tree over the bins."""
    if depth and len(g) > 1:
        _, at = _cut(g, h)
        return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + LEAF_WEIGHT))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A two-way step: cut one feature, then the other within each side; and its gain."""
    best: tuple[np.ndarray, float] = (np.zeros(g.shape), 0.0)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _cut(a.sum(1), b.sum(1))
        step, gain = np.zeros(a.shape), 0.0
        for rows in (slice(0, at), slice(at, None)):
            one, two = a[rows].sum(0), b[rows].sum(0)
            more, cut = _cut(one, two)
            gain += more
            for cols in (slice(0, cut), slice(cut, None)):
                step[rows, cols] = -one[cols].sum() / (two[cols].sum() + LEAF_WEIGHT)
        if gain > best[1]:
            best = (step.T if turned else step, gain)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the single tables, then of the pairs with the largest gain on what is left."""
    wide = x.shape[1]
    rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or min(y.sum(), len(y) - y.sum()) == 0:
        return Model(base, [np.zeros(0)] * wide, [np.zeros(0)] * wide, [np.zeros(1)] * wide, {})
    edges, pair_edges = [_edges(x[:, f], BINS) for f in range(wide)], [_edges(x[:, f], PAIR_BINS) for f in range(wide)]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    score = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(CYCLES):
        for f in range(wide):
            g, h = slope()
            step = RATE * _tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])), 2)
            tables[f] += step
            score += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(pair_edges)]

    def two_way(f: int, k: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        shape = (len(pair_edges[f]) + 1, len(pair_edges[k]) + 1)
        cell = coarse[f] * shape[1] + coarse[k]
        g, h = slope()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), shape

    gains = sorted(((_pair_tree(*two_way(f, k)[:2])[1], (f, k)) for f, k in combinations(range(wide), 2)), reverse=True)
    pairs = {p: np.zeros(two_way(*p)[2]) for _, p in gains[:PAIRS]}
    for _ in range(PAIR_CYCLES):
        for (f, k), t in pairs.items():
            g, h, _shape = two_way(f, k)
            step = RATE * _pair_tree(g, h)[0]
            t += step
            score += step[coarse[f], coarse[k]]
    return Model(base, edges, pair_edges, tables, pairs)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, most: int = TRAIN_ROWS) -> Model:
    """A model from at most about ``most`` labelled rows outside the held-out fold.

    Null texts count as empty, and rows with a null id or label teach nothing; a repeated
    id of ``docs`` teaches each of its texts, and of its labels the largest counts.
    Without rows, or with one label alone, every text gets the same score.  Of equally
    good cuts the first is taken.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(features(b.column("text")).tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, label, parts, held_out, most)
    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    return train(np.array(rows.column("x").to_pylist()).reshape(-1, len(FEATURES)), rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row from its whole text; null texts count as empty.

    Repeated rows are scored each, a null id stays null, ties need no order, and an empty
    table gives no rows.  No other column is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.scores(features(b.column("text"))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc32_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
