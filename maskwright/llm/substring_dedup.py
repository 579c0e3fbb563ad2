"""Repeated passages by MinHash banding of paragraphs.

Two kinds of paragraph are looked at.  A line of at least LINE_WORDS words is one:
lines that collide in a band are verified by exact Jaccard and clustered by
components.  Within the running text, paragraphs are cut where the content says so
(at the smallest hash of its surroundings), so a passage that many documents share
is cut alike in the midst of different lines; equal ones collide by their whole
shingle set, and neighbours that all repeat are joined into one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import REPEATED, ROW, Words, maybe_broadcast, mix, ngrams, signed, slices, small_batches, table, with_row_ids, written
from maskwright.llm.minhash import band_keys, cluster, least_linked, minima, packed

#: Words of a line that counts as a paragraph, and of a repeated passage.
LINE_WORDS, PASSAGE_WORDS = 20, 20
#: Words of a shingle, and the similarity of lines in percent.
SHINGLE, PERCENT = 5, 80
#: Bands and minima of a band for lines (a pair at 0.8 is missed once in 3,500), and all minima kept.
LINE_BANDS, LINE_ROWS, LINE_MINIMA = 8, 2, 64
#: Star-wise rounds over the lines of large buckets.
TURNS = 2
#: A cut is the least of so many word pairs on either side.
REACH = 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def block_starts(words: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Where the paragraphs of the word sequences in ``words`` begin; each begins one.

    Whether there is a cut depends on ``reach`` words before and ``reach`` + 1 after
    a place alone.
    """
    if not len(words):
        return np.zeros(0, np.int64)
    count = np.diff(offsets)
    at = np.arange(len(words)) + np.repeat(np.arange(1, len(count) + 1) * reach, count)  # with a gap between sequences
    padded = np.full(at[-1] + 1 + reach, _TOP)
    padded[at[:-1]] = mix(words[:-1] + mix(words[1:]))
    begins = offsets[:-1][count > 0]
    padded[at[offsets[1:][count > 0] - 1]] = _TOP  # the last word has no pair
    pair = padded[at]
    cut = pair != _TOP
    for k in range(1, reach + 1):
        # of equal ones, as in a repeated word, the first is the least
        cut &= (padded[at - k] > pair) & (padded[at + k] >= pair)
    cut[begins] = True
    return np.flatnonzero(cut)


def cuts(words: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Where the paragraphs of one word sequence begin, and its end."""
    return np.append(block_starts(words, np.array([0, len(words)]), reach), len(words)).astype(np.int64)


def block_keys(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of the words of each block: the difference of two sums of powers, brought to one place."""
    power = np.full(len(words), _BASE)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power))])
    back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words), _INVERSE))])
    return mix((total[end] - total[begin]) * back[begin] + mix((end - begin).astype(np.uint64)))


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts in one array, and the offsets by text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def line_grams(hashes: np.ndarray, offsets: np.ndarray, some: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The sorted distinct shingle hashes of the lines numbered ``some``, and 128-bit keys of these sets."""
    count = np.diff(offsets)[some]
    ends = np.concatenate([[0], np.cumsum(count)])
    own = hashes[np.repeat(offsets[some] - ends[:-1], count) + np.arange(ends[-1])]
    grams, at = ngrams(own, ends, SHINGLE)
    sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return sets, [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]


def _halves(keys: list[int]) -> list[pa.Array]:
    return [pa.array([(k >> 64) - (1 << 63) for k in keys], pa.int64()), pa.array([(k & (1 << 64) - 1) - (1 << 63) for k in keys], pa.int64())]


def _line_id() -> Column:
    """One id for a line of a document; rows that repeat a doc_id may have other lines."""
    return F.xxhash64("doc_id", "line", "high", "low")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


PARAGRAPHS = "doc_id long, line long, begin int, size int, key long, n long, high long, low long, signature array<long>, bands array<long>"


def paragraphs(docs: DataFrame, least: int = LINE_WORDS) -> DataFrame:
    """Both kinds of paragraphs of every document, from one pass over the texts.

    A content-cut one has its first word (``begin``), its ``size`` in words and their
    ``key``; a line of at least ``least`` words its number ``line``, its ``size``, and
    the number, key of 128 bits, signature and bands of its shingles.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names, smallest = _names(PARAGRAPHS), least_linked(PERCENT)

    def batch_of(**columns: pa.Array) -> pa.RecordBatch:
        rows = len(columns["doc_id"])
        return pa.record_batch([columns[c].cast(k) if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id")
                texts, lines = lines_of(batch.column("text"))
                found = Words(texts)
                hashes, offsets = found.hashes(), found.offsets[lines]
                begin = block_starts(hashes, offsets)
                end = np.append(begin[1:], len(hashes))[: len(begin)]
                doc = np.searchsorted(offsets, begin, side="right") - 1
                yield batch_of(doc_id=ids.take(pa.array(doc)), begin=pa.array(begin - offsets[doc]), size=pa.array(end - begin), key=pa.array(signed(block_keys(hashes, begin, end))))
                count = np.diff(found.offsets)
                some = np.flatnonzero(count >= least)
                sets, keys = line_grams(hashes, found.offsets, some)
                low = [minima(x, LINE_MINIMA) if len(x) >= smallest else None for x in sets]
                doc = np.searchsorted(lines, some, side="right") - 1
                high, rest = _halves(keys)
                yield batch_of(
                    doc_id=ids.take(pa.array(doc)), line=pa.array(some - lines[doc]), size=pa.array(count[some]), n=pa.array([len(x) for x in sets], pa.int64()), high=high, low=rest,
                    signature=pa.array([None if m is None else signed(packed(m)) for m in low], pa.list_(pa.int64())), bands=pa.array([None if m is None else signed(band_keys(m, LINE_BANDS, LINE_ROWS)) for m in low], pa.list_(pa.int64())),
                )

    return docs.select("doc_id", "text").mapInArrow(run, PARAGRAPHS)


def blocks(docs: DataFrame) -> DataFrame:
    """The content-cut paragraphs of every document by word offsets, with a key of their words."""
    return paragraphs(docs).filter("key is not null").select("doc_id", "begin", "size", "key")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id`` and ``grams`` of the lines listed in ``wanted`` (doc_id, line)."""
    numbers = wanted.groupBy("doc_id").agg(F.collect_set("line").alias("numbers"))  # the lines of one document at most
    schema = "doc_id long, line long, high long, low long, grams array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, lines = lines_of(batch.column("text"))
                lists = batch.column("numbers")
                line = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                there = line < np.diff(lines)[doc]  # not so in another row of the same id
                line, doc = line[there], doc[there]
                found = Words(texts.take(pa.array(lines[doc] + line)))
                sets, keys = line_grams(found.hashes(), found.offsets, np.arange(len(line)))
                yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), pa.array(line), *_halves(keys), pa.array([signed(x) for x in sets], pa.list_(pa.int64()))], names=_names(schema))

    sets = docs.select("doc_id", "text").join(numbers, "doc_id").mapInArrow(run, schema)
    return sets.select(_line_id().alias("id"), "grams").groupBy("id").agg(F.first("grams").alias("grams"))


PASSAGES = "doc_id long, at long, words long, class_id long, kept boolean"


def passages_of(doc_id: int, begin: np.ndarray, end: np.ndarray, class_id: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """PASSAGES of one document from its repeated blocks.

    Blocks that touch or overlap are one stretch, which counts from ``least`` words;
    its rows change where the decision does.  A word of a block of which this is the
    ``first`` place is kept, whatever else it belongs to; it has a row if ``least``
    words in a row are.
    """
    size = int(end.max())
    state, owner = np.zeros(size + 1, np.int8), np.zeros(size + 1, np.int64)
    for k in np.argsort(-class_id, kind="stable"):  # of each word the smallest document comes last
        state[begin[k] : end[k]], owner[begin[k] : end[k]] = 1, class_id[k]
    for k in np.flatnonzero(first):
        state[begin[k] : end[k]], owner[begin[k] : end[k]] = 2, doc_id
    at = np.flatnonzero(np.diff(state, prepend=0))  # state ends with 0
    bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), state[at[:-1]].tolist(), strict=True))
    stretch: list[tuple[int, int, int]] = []
    for one in [*bounds, (size, size, 0)]:
        if one[2]:
            stretch.append(one)
            continue
        if stretch and stretch[-1][1] - stretch[0][0] >= least:
            yield from ((doc_id, a, b - a, int(owner[a:b].min()), kind == 2) for a, b, kind in stretch if kind == 1 or b - a >= least)
        stretch = []


def repeated_passages(docs: DataFrame, least: int = PASSAGE_WORDS, found: DataFrame | None = None) -> DataFrame:
    """Runs of neighbouring blocks that stand elsewhere too: doc_id, at, words, class_id, kept.

    ``found``, where given, has the ``blocks`` of ``docs``.
    """
    found = written(blocks(docs), "blocks") if found is None else found
    repeats = found.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last"), F.count("*").alias("c")).filter("c > 1")
    repeats = repeats.select("key", "class_id", (F.col("class_id") != F.col("last")).alias("shared"))
    own = found.join(repeats, "key").groupBy("doc_id").agg(F.collect_set(F.struct("begin", "size", "class_id", "key", "shared")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            begin, size, class_id, key, shared = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            begin, out = begin.astype(np.int64), []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), [0, *ends[:-1]], ends, strict=True):
                order = a + np.lexsort((begin[a:b], key[a:b]))
                new = np.append(True, np.diff(key[order]) != 0)  # the first place in this document
                again = np.append(~new[1:], False) | ~new
                some = order[shared[order].astype(bool) | again]  # others come from repeated rows alone
                first = new[shared[order].astype(bool) | again] & (class_id[some] == doc_id)
                if len(some):
                    out += passages_of(doc_id, begin[some], begin[some] + size[some], class_id[some], first, least)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(PASSAGES))

    return own.mapInArrow(run, PASSAGES)


def repeated_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The lines in ``found`` that are near another one: doc_id, at, words, class_id, kept."""
    lines = found.filter("line is not null").withColumn("line_id", _line_id())
    sketched = lines.select(F.col("line_id").alias("doc_id"), "n", "high", "low", "signature", "bands")
    sets_of = lambda ids: line_sets(docs, lines.join(ids.withColumnRenamed("id", "line_id"), "line_id", "left_semi"))
    classes = cluster(sketched, sets_of, PERCENT, LINE_MINIMA, TURNS).select(F.col("doc_id").alias("line_id"), F.coalesce("component", "doc_id").alias("component_id")).distinct()
    classes = written(classes, "line-classes")
    sizes = classes.groupBy("component_id").count().filter("count > 1").select("component_id")
    where = written(lines.select("doc_id", "line", "size", "line_id").distinct().join(classes.join(sizes, "component_id"), "line_id"), "repeated-lines")
    first = where.groupBy("component_id").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    kept = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.line") == F.col("line"))
    return where.join(first, "component_id").select("doc_id", F.col("line").alias("at"), F.col("size").cast("long").alias("words"), F.col("first.doc_id").alias("class_id"), kept.alias("kept"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per repeated paragraph: doc_id, unit, at, words, class_id, kept, row_key.

    ``unit`` is ``line`` (``at``: its number in the text, from 0) or ``passage``
    (``at``: its first word).  ``class_id`` is the smallest document of its class, of
    a passage the smallest that has any of its parts.  Rows with ``kept`` false can be
    removed: earlier documents, or earlier places of the same, have and keep all their
    parts.  A stretch of PASSAGE_WORDS repeated words has a row for each part that is not
    kept, maybe a shorter one, and for each kept part of as many words.  What repeats within one
    document alone is reported too: its first place is kept.  Null and empty texts have no paragraphs; rows
    with a null id take no part.  Rows of one id with different texts are documents of
    their own: ``row_key``, by which ``class_id`` names them too, is the id for one of
    them and a hash of id and text for the others; rows equal in both are one document.
    An empty table gives no rows.  Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = with_row_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null"))
    docs = rows.select(F.col(ROW).alias("doc_id"), "text")
    named = lambda df, unit: df.select("doc_id", F.lit(unit).alias("unit"), "at", "words", "class_id", "kept")
    found = written(paragraphs(docs), "paragraphs")
    passages = repeated_passages(docs, found=found.filter("key is not null").select("doc_id", "begin", "size", "key"))
    out = named(repeated_lines(docs, found), "line").unionByName(named(passages, "passage")).withColumnRenamed("doc_id", "row_key")
    # only rows of a repeated id have another key than their id
    other = written(rows.filter(F.col(REPEATED) & (F.col(ROW) != F.col("doc_id"))).select(F.col(ROW).alias("row_key"), "doc_id").distinct(), "row-keys")
    out = out.join(maybe_broadcast(other, other.count()), "row_key", "left")
    return out.select(F.coalesce("doc_id", "row_key").alias("doc_id"), "unit", "at", "words", "class_id", "kept", "row_key")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
