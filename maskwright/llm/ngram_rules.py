"""Quality rules: counts of a text that anyone can check, and how much it reads like trusted text.

The second is a log-likelihood ratio.  Words and pairs of neighbouring words are hashed
into a fixed number of buckets; one multinomial over the buckets is estimated from all
texts, one from the trusted ones, and a text's score is the mean of the logarithms of
their ratio over all its n-grams.  Every document is held against one threshold, which
trusted texts that the estimate hasn't seen decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import BROADCAST_ROWS, Words, crc32_fold, mix, ngrams, slices, small_batches, table, written

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: n-grams of the raw corpus' shape that are added to the trusted counts.
PRIOR = float(BUCKETS)
#: Every so many trusted documents one isn't counted, but decides about the threshold.
CALIBRATION = 5
#: The threshold is this many of their deviations below the middle of these documents' scores.
DEVIATIONS = 6.0
#: n-grams of ratio 1 that each text gets besides its own, as few n-grams say little.
LIGHT = 30
#: Words of a window that counts as repeated, words that a text needs, and the share of repeated words it may have.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
#: Scores are counted in steps of this size for the threshold.
STEP = 1 / 256


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; null ones have zeros."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    n = len(texts)
    words = Words(texts, lower=False)
    per = np.diff(words.offsets)
    owner = np.repeat(np.arange(n), per)
    chars = pc.utf8_length(words.chunks).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.bincount(owner, chars[words.index] if len(chars) else None, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[: n + 1].astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_IS_SYMBOL[np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)])])
    return {"n_words": per.astype(np.int64), "word_chars": letters, "n_symbols": marks[at[1:]] - marks[at[:-1]], "n_dup_lines": _repeated_lines(texts), "n_repeat_words": _repeated_words(words)}


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    some = pc.not_equal(pc.ascii_trim_whitespace(lines.dictionary), "").to_numpy(zero_copy_only=False).astype(bool)
    index, offsets = lines.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = some[index] if len(some) else np.zeros(0, bool)
    key = owner[keep] * max(1, len(some)) + index[keep]
    first = np.unique(key) // max(1, len(some))
    return np.bincount(owner[keep], minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def _repeated_words(words: Words) -> np.ndarray:
    """Words in windows of WINDOW words that stand at least twice in their text."""
    per = np.diff(words.offsets)
    grams, offsets = ngrams(words.hashes(), words.offsets, WINDOW)
    owner = np.repeat(np.arange(len(per)), np.diff(offsets))
    begin = words.offsets[owner] + np.arange(len(grams)) - offsets[owner]
    whole = per[owner] >= WINDOW  # a shorter text's only gram isn't a window
    grams, owner, begin = grams[whole], owner[whole], begin[whole]
    order = np.lexsort((grams, owner))
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words.index) + 1, np.int64)
    np.add.at(edges, begin[twice], 1)
    np.add.at(edges, begin[twice] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return inside[words.offsets[1:]] - inside[words.offsets[:-1]]


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and pairs of words of each text, and offsets by text."""
    words = Words(texts)
    hashes = words.hashes()
    pairs, pair_offsets = ngrams(hashes, words.offsets, 2)
    per, more = np.diff(words.offsets), np.diff(pair_offsets)
    offsets = np.concatenate([[0], np.cumsum(per + more)])
    out = np.empty(offsets[-1], np.uint64)
    out[np.repeat(offsets[:-1] - words.offsets[:-1], per) + np.arange(len(hashes))] = mix(hashes)
    out[np.repeat(offsets[:-1] + per - pair_offsets[:-1], more) + np.arange(len(pairs))] = pairs
    return (out % np.uint64(BUCKETS)).astype(np.int64), offsets


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The mean log ratio over a text's n-grams and LIGHT neutral ones; 0 without any."""
        bucket, offsets = buckets(texts)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[bucket])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / (np.diff(offsets) + LIGHT)


def log_ratio(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """The logarithm of trusted by raw probability of each bucket, both smoothed; 0 without trusted texts."""
    base = (raw + trusted + 1) / (raw + trusted + 1).sum()
    return np.log((trusted + PRIOR * base) / (trusted.sum() + PRIOR)) - np.log(base)


def fit(docs: DataFrame, trusted: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text), of which those in ``trusted`` (doc_id) are trusted.

    All texts are counted whole, by task and then by bucket; only a number of counts that
    doesn't grow with the data reaches the driver.  Of trusted ids those with a crc32 of 0
    modulo CALIBRATION count as raw text, and the middle and deviation of their scores set
    the threshold.  Without trusted rows every score is 0, as the threshold is.  Null ids
    are never trusted; a repeated id marks all its rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = written(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "trusted")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    held = crc32_fold("doc_id", CALIBRATION) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.join(known.withColumn("_known", F.lit(True)), "doc_id", "left").select("text", F.coalesce(F.col("_known") & ~held, F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * BUCKETS, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                bucket, offsets = buckets(b.column("text"))
                kind = np.repeat(b.column("trusted").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
                found += np.bincount(kind * BUCKETS + bucket, minlength=2 * BUCKETS)
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["bucket", "n"])

    sums = np.zeros(2 * BUCKETS, np.int64)
    for bucket, n in marked.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():  # 2 * BUCKETS rows at most
        sums[bucket] = n
    model = Model(log_ratio(sums[:BUCKETS].astype(float), sums[BUCKETS:].astype(float)))
    if sums[BUCKETS:].any():
        model.threshold = _threshold(rows.join(known, "doc_id", "left_semi").filter(held), model)
    return model


def _threshold(rows: DataFrame, model: Model) -> float:
    """DEVIATIONS of the scores of ``rows`` below their middle, both from counts of all of them in steps."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                n = counts(b.column("text"))
                fine = np.flatnonzero(~failed(n["n_words"], n["n_repeat_words"]))
                step = np.round(shared.value.scores(b.column("text"))[fine] / STEP).astype(np.int64)
                yield pa.record_batch([pa.array(step)], names=["step"])

    found = rows.select("text").mapInArrow(run, "step long").groupBy("step").count().toArrow().sort_by("step")  # as many rows as there are steps
    step, n = found.column("step").to_numpy(), found.column("count").to_numpy()
    if not len(n):
        return 0.0
    upto = np.cumsum(n)
    at = lambda share: STEP * step[np.searchsorted(upto, share * upto[-1])]
    middle = at(0.5)
    # the deviation of what lies below the middle, by the share that lies within one of it
    return float(middle - DEVIATIONS * max(STEP, middle - at(0.16)))


def failed(n_words: np.ndarray | Column, n_repeat_words: np.ndarray | Column) -> np.ndarray | Column:
    """Whether a text has too few words or too many repeated ones."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every row, from its whole text.

    A row is kept if the counts don't fail it and its score reaches the model's threshold.
    Null texts count as empty; they, like empty and white ones, have no words and fail.
    Repeated rows and rows with a null id are judged each; no other column is read, and an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                n = counts(b.column("text"))
                score = shared.value.scores(b.column("text"))
                bad = failed(n["n_words"], n["n_repeat_words"])
                columns = [b.column("doc_id"), *(pa.array(n[c], pa.int64()) for c in names), pa.array(bad), pa.array(score), pa.array(~bad & (score >= shared.value.threshold))]
                yield pa.record_batch(columns, names=["doc_id", *names, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as of good quality are the trusted ones."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels").filter("quality = 1")))
