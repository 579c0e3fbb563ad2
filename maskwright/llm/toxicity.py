"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed into an embedding table; filters of several widths slide over the
whole text, the largest response of each is kept, and a logistic layer scores them.
The decision threshold is calibrated by language on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.classifier import labelled_sample
from maskwright.llm.common import Words, crc32_fold, mix, slices, small_batches, table

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 6_000
BUCKETS = 1 << 17
DIMS = 6
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 6
#: Texts that a word needs before half of its log-odds count.
SUPPORT = 30
#: Step of the embeddings, and ridge of the output layer.
RATE = 0.1
RIDGE = 3.0
#: Every so many labelled rows one is kept for calibration; what a lost clean text weighs there.
CALIBRATION = 5
CLEAN_WEIGHT = 4.0
STRIPPED = ".,;:!?#$%&*()[]\"'"


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5

    def responses(self, buckets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each text, and where its window begins (-1: nowhere)."""
        n, texts = len(buckets), len(offsets) - 1
        count = np.diff(offsets)
        pooled = np.full((texts, len(WIDTHS) * FILTERS), -1.0, np.float32)
        where = np.full(pooled.shape, -1, np.int64)
        if n == 0:
            return pooled, where
        words = np.concatenate([self.embedding[buckets], np.zeros((max(WIDTHS), DIMS), np.float32)])
        owner = np.repeat(np.arange(texts), count)
        left = offsets[1:][owner] - np.arange(n)
        full = np.flatnonzero(count)
        for k, width in enumerate(WIDTHS):
            value = sum(words[j : j + n] @ self.filters[k][j] for j in range(width)) + self.bias[k]
            value[left < width] = -1.0  # the window would leave the text
            value = np.tanh(value, out=value)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(value, offsets[:-1][full], axis=0)
            pooled[full, cols] = best
            if texts == 1:
                where[full, cols] = value.argmax(0)
        return pooled, where

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(pooled @ self.out + self.shift)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.default)


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of all words, without punctuation around them, and offsets by text."""
    words = Words(texts)
    words.dictionary = [w.strip(STRIPPED) or w for w in words.dictionary]
    return (mix(words.hashes()) % np.uint64(BUCKETS)).astype(np.int32), words.offsets


def train(buckets: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Fits the model on whole texts.

    Embeddings begin with the smoothed log-odds of a bucket's texts in their first
    dimension, so that max pooling has something to hold on to; then everything is
    trained by gradient steps on the pooled windows.  With one class only, the
    model is constant.
    """
    rng = np.random.default_rng(seed)
    count = np.diff(offsets)
    owner = np.repeat(np.arange(len(labels)), count)
    seen = np.unique(owner * BUCKETS + buckets)  # a word counts once a text
    of, row = seen % BUCKETS, seen // BUCKETS
    pos = np.bincount(of, labels[row], BUCKETS)
    neg = np.bincount(of, 1 - labels[row], BUCKETS)
    base = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = np.log((pos + 0.5) / (base[0] + 1)) - np.log((neg + 0.5) / (base[1] + 1))
    # a bucket that few texts have says little
    support = pos + neg
    odds *= support / (support + SUPPORT)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIMS)).astype(np.float32)
    embedding[:, 0] = odds / 2
    filters = [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 1.0 / len(f)
    model = Model(embedding, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), float(np.log(base[0] / base[1])))
    if min(labels.sum(), len(labels) - labels.sum()) == 0:
        model.out[:] = 0
        model.shift = 9.0 if labels.sum() else -9.0
        return model
    for epoch in range(EPOCHS):
        # where every filter responds most, for all texts; then the window's words are trained
        pooled, windows = _windows(model, buckets, offsets)
        _logistic(model, pooled, labels)
        if epoch == EPOCHS - 1:
            break
        error = (model.scores(pooled) - labels)[:, None] * model.out[None, :] * (1 - pooled**2)
        error[windows < 0] = 0
        rate = RATE / len(labels) ** 0.5
        for k, width in enumerate(WIDTHS):
            for j in range(width):
                at = np.minimum(windows[:, k * FILTERS : (k + 1) * FILTERS] + j, len(buckets) - 1)
                e = error[:, k * FILTERS : (k + 1) * FILTERS]
                ids = buckets[at.ravel()]
                step = (e[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIMS)
                grad_f = np.einsum("tfd,tf->df", model.embedding[ids].reshape(*at.shape, DIMS), e)
                np.subtract.at(model.embedding, ids, (rate * step).astype(np.float32))
                model.filters[k][j] -= (0.05 * grad_f / (np.abs(grad_f).max() + 1e-9)).astype(np.float32)
            grad_b = error[:, k * FILTERS : (k + 1) * FILTERS].sum(0)
            model.bias[k] -= (0.02 * grad_b / (np.abs(grad_b).max() + 1e-9)).astype(np.float32)
    return model


def _windows(model: Model, buckets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pooled = np.full((len(offsets) - 1, len(WIDTHS) * FILTERS), -1.0, np.float32)
    where = np.full(pooled.shape, -1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            p, w = model.responses(buckets[a:b], np.array([0, b - a]))
            pooled[i], where[i] = p[0], w[0] + a
    return pooled, where


def _logistic(model: Model, x: np.ndarray, y: np.ndarray, rounds: int = 25) -> None:
    """The output layer by Newton's method with a small ridge, each class with half the weight."""
    design = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, design.T @ (weight * (p - y)) + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.out, model.shift = w[:-1].astype(np.float32), float(w[-1])


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold at which caught toxic texts less CLEAN_WEIGHT times lost clean ones (shares of
    each class) are most, the middle of equally good ones."""
    cuts = np.unique(np.concatenate([np.quantile(score, np.linspace(0, 1, 401)), [0.5]]))
    hit = np.array([(score[label == 1] >= c).mean() - CLEAN_WEIGHT * (score[label == 0] >= c).mean() for c in cuts])
    good = cuts[hit >= hit.max() - 1e-9]
    return float((good[0] + good[-1]) / 2)


def calibrate(model: Model, buckets: np.ndarray, offsets: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Sets the thresholds from rows that the model wasn't trained on."""
    if min(labels.sum(), len(labels) - labels.sum()) == 0:
        return
    score = model.scores(model.responses(buckets, offsets)[0])
    model.default = _threshold(score, labels)
    for lang in sorted({x for x in langs if x}):
        own = np.array([x == lang for x in langs])
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= 20:
            model.thresholds[lang] = _threshold(score[own], labels[own])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0, most: int = TRAIN_ROWS) -> Model:
    """A model from at most about ``most`` labelled rows outside the held-out fold.

    Null texts count as empty, and rows with a null id or label teach nothing; a repeated
    id of ``docs`` teaches each of its texts, and of its labels the largest counts.
    Without rows, or with one label alone, every text gets the same score.  Of thresholds
    that do equally well the middle is taken.
    """
    rows = labelled_sample(docs, labels, label, parts, held_out, most).toArrow().sort_by("doc_id")
    langs = rows.column("lang").to_pylist()
    if not rows.num_rows:
        return train(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    apart = np.arange(rows.num_rows) % CALIBRATION == 0

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = rows.filter(pa.array(mask))
        found = [word_buckets(b.column("text")) for whole in own.combine_chunks().to_batches() for b in slices(whole, "text")]
        offsets, end = [np.zeros(1, np.int64)], 0
        for _, o in found:
            offsets.append(o[1:] + end)
            end += o[-1]
        return np.concatenate([np.zeros(0, np.int32), *(b for b, _ in found)]), np.concatenate(offsets), own.column("label").to_numpy().astype(np.int64)

    model = train(*part(~apart))
    calibrate(model, *part(apart), [x for x, a in zip(langs, apart, strict=True) if a])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, threshold, flagged of every row, from its whole text.

    ``score`` depends on the text alone; ``threshold`` is that of the row's language
    (the common one where it is null or unknown) and ``flagged`` compares the two.
    Null texts count as empty and get the score of a text without words.  Repeated rows
    are scored each, a null id stays null, a score at the threshold is flagged, and an
    empty table gives no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                pooled, _ = m.responses(*word_buckets(batch.column("text")))
                s = m.scores(pooled).astype(np.float64)
                t = np.array([m.threshold(x) for x in batch.column("lang").to_pylist()])
                yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array(t, pa.float64()), pa.array(s >= t, pa.bool_())], names=["doc_id", "score", "threshold", "flagged"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, "doc_id long, score double, threshold double, flagged boolean")


def remove_flagged(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't flagged at their language's threshold.

    As ``score`` judges them: each row by its own text, so repeated rows go or stay together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                s = m.scores(m.responses(*word_buckets(batch.column("text")))[0])
                langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * len(s)
                yield batch.filter(pa.array([x < m.threshold(y) for x, y in zip(s, langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc32_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")
