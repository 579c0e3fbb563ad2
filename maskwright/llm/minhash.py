"""Near-duplicate documents by b-bit MinHash.

Each text becomes the set of its word shingles (as 64-bit hashes).  Equal sets are
one node.  Of 256 minima a node keeps the low four bits, packed into sixteen
longs, and 32 band keys of four whole minima.  Nodes that share a band key are candidates;
the packed signatures, by bit counts corrected for chance agreement, discard the
clearly different ones; the rest are confirmed on the full sets.

Each node of a bucket is first compared with one of them: the one that meets most
others in its buckets, so the original of a group of copies.  Where a bucket still
holds several components, its nodes are compared with the best linked one; and the
nodes of different components are: all in a small bucket, and in a larger one those
whose *differences* to the best linked one share a rare gram (see ``by_difference``),
which loses no pair at the threshold.  So no bucket is cut short, and none is paired
off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import Words, attach, maybe_broadcast, meet, mix, ngrams, signed, slices, small_batches, table, written
from maskwright.llm.components import connected_components

MINIMA, BITS = 256, 4
BANDS, ROWS = 32, 4
#: Buckets of up to so many nodes compare all of them.
SMALL_BUCKET = 16
#: Nodes of a gram that a star-wise round compares the others with.
STAR_ENDS = 3
#: Standard deviations below the threshold at which an estimate discards a pair.
SPREAD = 5

_rng = np.random.default_rng(20240601)
_A = _rng.integers(0, 1 << 31, MINIMA).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 31, MINIMA).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = mix(np.arange(1, MINIMA + 1).astype(np.uint64))
_NIBBLE = (np.arange(16) * BITS).astype(np.uint64)


def gram_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = Words(texts)
    grams, offsets = ngrams(found.hashes(), found.offsets, words)
    return [np.unique(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def minima(grams: np.ndarray, count: int = MINIMA) -> np.ndarray:
    a, b = _A[:count], _B[:count]
    high, low = (grams >> np.uint64(32)).astype(np.uint32)[:, None], grams.astype(np.uint32)[:, None]
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 1024):
        np.minimum(out, (high[at : at + 1024] * a + low[at : at + 1024] * b).min(0), out=out)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the (finalised) minima, sixteen a long."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, 16)
    return np.bitwise_or.reduce(bits << _NIBBLE, axis=1)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` whole minima."""
    m = least[: bands * rows].astype(np.uint64).reshape(bands, rows)
    key = _BAND[:bands]
    for k in range(rows):
        key = mix(key ^ m[:, k])
    return key


SKETCH = "doc_id long, n long, high long, low long, signature array<long>, bands array<long>"


def sketches(docs: DataFrame, words: int, least: int, bands: int = BANDS, rows: int = ROWS, count: int = MINIMA) -> DataFrame:
    """A row per document: set size, a 128-bit key of the set, and from ``least`` shingles on its signature and bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = gram_sets(batch.column("text"), words)
                keys = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
                low = [minima(s, count) if len(s) >= least else None for s in sets]
                yield pa.record_batch([
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if k is None else (k >> 64) - (1 << 63) for k in keys], pa.int64()), pa.array([None if k is None else (k & (1 << 64) - 1) - (1 << 63) for k in keys], pa.int64()),
                    pa.array([None if m is None else signed(packed(m)) for m in low], pa.list_(pa.int64())), pa.array([None if m is None else signed(band_keys(m, bands, rows)) for m in low], pa.list_(pa.int64())),
                ], names=["doc_id", "n", "high", "low", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id`` and ``grams`` (the whole set) of the documents listed in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [signed(s) for s in gram_sets(batch.column("text"), words)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "grams"])

    wanted = maybe_broadcast(ids.select(F.col("id").alias("doc_id")), ids.count())
    return docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(run, "id long, grams array<long>").groupBy("id").agg(F.first("grams").alias("grams"))


def differing(a: str, b: str, count: int = MINIMA) -> Column:
    """The number of minima whose kept bits differ, from two signature columns."""
    total = F.lit(0)
    for k in range(count * BITS // 64):
        z = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        total = total + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return total


class Linker:
    """Estimates and confirms candidate pairs of nodes."""

    def __init__(self, nodes: DataFrame, percent: int, count: int):
        self.percent, self.count = percent, count
        self.nodes = nodes.select(F.col("node").alias("id"), "n", "signature")
        chance = 1 / (1 << BITS)
        agree = percent / 100 * (1 - chance) + chance
        self.most = int(count * (1 - agree + SPREAD * sqrt(agree * (1 - agree) / count)))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a < b, distinct) whose sizes and estimated similarity don't rule them out."""
        pairs = written(pairs.select("a", "b"), "pairs")
        some = pairs.count()
        side = lambda x: self.nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
        found = meet(meet(pairs, side("a"), ["a"], "b", at_most=some), side("b"), ["b"], "a", at_most=some)
        sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        return found.filter(sizes & (differing("s_a", "s_b", self.count) <= self.most)).select("a", "b")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        side = lambda x: sets.select(F.col("id").alias(x), F.col("grams").alias(f"g_{x}"))
        some = pairs.count()
        found = meet(meet(pairs, side("a"), ["a"], "b", at_most=some), side("b"), ["b"], "a", at_most=some)
        both = F.size(F.array_intersect("g_a", "g_b"))
        return found.select("a", "b", both.alias("both"), (F.size("g_a") + F.size("g_b") - both).alias("either")).filter(f"100 * both >= {self.percent} * either").select("a", "b")


def by_difference(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components, by ``prefixes`` and ``prefix_pairs``."""
    return prefix_pairs(prefixes(pairs, sets, percent), percent)


def prefixes(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What to look at to find the pairs of different components that can reach the threshold, by what sets them apart from a middle.

    ``pairs`` has middle, id and component; nodes of one middle are compared.  With
    D(x) the grams by which x differs from m (added and missing ones), x and y are as
    similar as the threshold t asks where |D(x)| + |D(y)| - 2 |D(x) & D(y)| is at most
    c (|x| + |y|), c = (1 - t) / (1 + t).  As one of the two at least isn't linked with
    m, their differences must share ``need`` grams, one at least.  So they share one
    among the first |D| - need + 1 of each, rarest first, where ``need`` is the least
    that any partner asks for: ``loose`` for any, ``tight`` for one not linked with m.
    Copies that were edited each in its own way share hardly any rare gram, however
    many there are.
    """
    up, down = 100 + percent, 100 - percent
    side = lambda x, g: sets.select(F.col("id").alias(x), F.col("grams").alias(g))
    own = meet(pairs.join(side("id", "own"), "id"), side("middle", "base"), ["middle"], "id")
    missing = F.transform(F.array_except("base", "own"), lambda g: F.bitwise_not(g))
    apart = own.select("middle", "id", "component", F.size("own").alias("n"), F.size("base").alias("m"), F.concat(F.array_except("own", "base"), missing).alias("apart"))
    apart = apart.withColumn("d", F.size("apart")).withColumn("linked", F.expr(f"{up} * d <= {down} * (n + m)"))
    tight = F.expr(f"({up}L * d + {down}L * (m - n)) div {2 * up} + 1")
    loose = F.when(F.col("linked"), tight).otherwise(F.greatest(F.lit(1), F.expr(f"cast(ceil(({up}L * d - {down}L * (n + m)) / 200D) as int)")))
    apart = written(apart.withColumn("loose", loose.cast("int")).withColumn("tight", F.greatest(tight.cast("int"), "loose")), "differences")
    grams = apart.select("middle", "id", F.explode("apart").alias("gram"))
    counted = written(grams.groupBy("middle", "gram").agg(F.count("*").alias("f"), F.min("id").alias("id")), "counted")
    # grams of one set alone fill most prefixes; only sets whose prefix goes on beyond them need the others
    alone = counted.filter("f = 1").groupBy("middle", "id").agg(F.count("*").alias("alone"))
    further = apart.join(alone, ["middle", "id"], "left").filter("d - loose + 1 > coalesce(alone, 0)").select("middle", "id", F.explode("apart").alias("gram"))
    frequent = counted.filter("f > 1").select("middle", "gram", "f")
    ranked = attach(further, frequent, ["middle", "gram"], "f").filter("f > 1").groupBy("middle", "id").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("shared"))
    # those of one set alone come before all others and match none
    placed = apart.drop("apart").join(ranked, ["middle", "id"]).select("*", F.posexplode("shared").alias("k", "one"))
    placed = placed.withColumn("at", F.col("d") - F.size("shared") + F.col("k") + 1).withColumn("gram", F.col("one.gram")).filter("at <= d - loose + 1")
    return written(placed.select("middle", "gram", "id", "component", "n", "d", "at", "linked", "tight"), "prefixes")


def prefix_pairs(kept: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) of different components that share a gram of their prefixes and can reach the threshold."""
    up, down = 100 + percent, 100 - percent
    ends = lambda rows, x: rows.select("middle", "gram", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "d", "at")))
    # grams that can still be shared from these places on must be enough
    need = F.col("d_a") + F.col("d_b") - 2 * (1 + F.least(F.col("d_a") - F.col("at_a"), F.col("d_b") - F.col("at_b")))
    reach = (need * up <= (F.col("n_a") + F.col("n_b")) * down) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    on = (F.col("l.middle") == F.col("r.middle")) & (F.col("l.gram") == F.col("r.gram")) & (F.col("component_a") != F.col("component_b")) & reach
    far, close = kept.filter("not linked"), kept.filter("linked")
    short = far.filter("at <= d - tight + 1")
    both = ends(short, "a").alias("l").join(ends(short, "b").alias("r"), on & (F.col("id_a") < F.col("id_b")))
    one = ends(far, "a").alias("l").join(ends(close, "b").alias("r"), on)
    ids = [F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")]
    return both.select(ids).unionByName(one.select(ids))


def _stars(kept: DataFrame, component: DataFrame, turn: int) -> DataFrame:
    """Each node with STAR_ENDS nodes of every gram in its prefix, others each ``turn``, where they are in different components."""
    now = written(_now(kept, component).select("middle", "gram", "id", "component"), "now")
    ends = [F.max(F.struct(F.xxhash64("id", F.lit(turn * STAR_ENDS + k)).alias("hash"), "id", "component")) for k in range(STAR_ENDS)]
    chosen = now.groupBy("middle", "gram").agg(F.array(*ends).alias("ends"), F.count("*").alias("c"))
    each = meet(now, chosen.filter("c > 1").drop("c"), ["middle", "gram"], "id").select("id", "component", F.explode(F.array_distinct("ends")).alias("end"))
    return each.filter(F.col("component") != F.col("end.component")).select(F.least("id", "end.id").alias("a"), F.greatest("id", "end.id").alias("b"))


def _now(rows: DataFrame, component: DataFrame) -> DataFrame:
    """``rows`` with their ids' components as they are now."""
    return rows.drop("component").join(component.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _across(open_: DataFrame) -> DataFrame:
    """All pairs of a bucket's nodes that are in different components."""
    other = open_.select("key", F.col("id").alias("id_b"), F.col("component").alias("component_b"))
    on = (F.col("l.key") == F.col("r.key")) & (F.col("id") < F.col("id_b")) & (F.col("component") != F.col("component_b"))
    return open_.alias("l").join(other.alias("r"), on).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _with_middle(open_: DataFrame, links: DataFrame) -> DataFrame:
    """Each node of a bucket with a middle: the best linked one of its nodes' buckets.

    It may be outside the bucket; so nearly all buckets of a group have one middle.
    """
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    best = open_.join(degree, "id", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("id").alias("hash"), "id", "component")).alias("m"))
    own = meet(open_.select("key", "id"), best, ["key"], "id").groupBy("id").agg(F.max("m").alias("m"))
    best = open_.select("key", "id").join(own, "id").groupBy("key").agg(F.max("m").alias("m")).select("key", F.col("m.id").alias("middle"), F.col("m.component").alias("its"))
    return meet(open_.select("key", "id", "component", "c"), best, ["key"], "id")


def _spokes(rows: DataFrame) -> DataFrame:
    """The pairs of nodes and middles that are in different components."""
    return rows.filter("component <> its").select(F.least("id", "middle").alias("a"), F.greatest("id", "middle").alias("b"))


def joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` (id, component) with further links: what they join is contracted first."""
    ends = links.select("a", "b").join(component.toDF("a", "x"), "a", "left").join(component.toDF("b", "y"), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")), "ends")
    merged = connected_components(ends, "x", "y").toDF("component", "into")
    new = ends.select("a", "x").union(ends.select("b", "y")).filter("a = x").select(F.col("a").alias("id"), F.col("x").alias("component")).distinct()
    every = component.unionByName(new.join(component.select("id"), "id", "left_anti"))
    return written(every.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component")), "component")


def cluster(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, count: int = MINIMA, turns: int = 0) -> DataFrame:
    """``rows`` (a table of SKETCH rows; doc_id is any id) without signature and bands, and with the component of each set.

    ``sets_of`` gives ``id`` and ``grams`` for a table of ``id``.  Sets are linked where
    100 * |both| >= percent * |either|; a component's id is its smallest doc_id.  Rows
    with a null id or an empty set get a null component; rows of one set are one node.
    With ``turns`` what large buckets leave is compared star-wise too, so many times,
    before pairs are made: where short sets differ by the same few grams, most are joined
    by then.  The components are the same.
    """
    same = rows.filter("n > 0 and doc_id is not null").groupBy("high", "low")
    groups = written(same.agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "nodes")

    keys = groups.filter("bands is not null").select("node", F.explode("bands").alias("key"))
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    buckets = written(attach(keys, sizes, ["key"], "c").filter("c > 1"), "buckets")
    met = buckets.groupBy("node").agg(F.sum("c").alias("met"))
    middle = F.max(F.struct("met", F.xxhash64("node"), "node"))["node"]
    stars = attach(buckets, written(buckets.join(met, "node").groupBy("key").agg(middle.alias("middle"), F.count("*").alias("of")), "middles"), ["key"], "of")
    linker = Linker(groups, percent, count)
    spokes = stars.filter("node <> middle").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).distinct()
    tried = written(linker.likely(spokes), "likely")
    ids = tried.select(F.col("a").alias("id")).union(tried.select("b")).union(buckets.filter("c > 2").select("node")).distinct()
    sets = written(sets_of(written(ids, "candidates")), "sets")
    links = written(linker.links(tried, sets), "confirmed")
    component = written(connected_components(links), "component")
    members = buckets.filter("c > 2").select("key", F.col("node").alias("id"), "c")

    def placed(nodes: DataFrame, key: str) -> DataFrame:
        return nodes.join(component.withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key))

    # buckets that still hold several components
    now = written(placed(members, "id"), "placed")
    split = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    open_ = written(meet(now, split, ["key"], "id"), "open")
    if open_.take(1):
        around = written(_with_middle(open_, links), "around")
        large = around.filter((F.col("c") > SMALL_BUCKET) & (F.col("id") != F.col("middle"))).select("middle", "id", "component").distinct()
        if turns:
            kept = prefixes(large, sets, percent)
            rounds = [lambda: _spokes(around).unionByName(_across(open_.filter(F.col("c") <= SMALL_BUCKET)))]
            rounds += [lambda turn=turn: _stars(kept, component, turn) for turn in range(turns)]
            for pairs_of in [*rounds, lambda: prefix_pairs(_now(kept, component), percent)]:
                fresh = written(linker.likely(pairs_of().distinct().join(tried, ["a", "b"], "left_anti")), "likely")
                tried = written(tried.unionByName(fresh), "tried")
                component = joined(component, written(linker.links(fresh, sets), "confirmed"))
        else:
            pairs = _spokes(around).unionByName(_across(open_.filter(F.col("c") <= SMALL_BUCKET))).unionByName(by_difference(large, sets, percent))
            fresh = written(linker.likely(pairs.distinct().join(tried, ["a", "b"], "left_anti")), "likely")
            component = joined(component, written(linker.links(fresh, sets), "confirmed"))
    found = written(placed(groups.select("high", "low", "node", "copies"), "node").select("high", "low", "copies", "component"), "components")
    return attach(rows.drop("signature", "bands"), found, ["high", "low"], "copies")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_rows: int = ROWS, count: int = MINIMA) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |both| >= percent * |either| of their distinct
    shingles of ``words`` words; a text of fewer words has its whole sequence as its
    only shingle.  A component's id is its smallest doc_id; that document is kept.
    Texts without words, and null ones, have no shingles and no links.  Rows with a
    null id take no part: they come back with a null component, kept.  Rows that
    repeat an id are one node, where their texts are equal; all come back.  Ties in
    similarity need no order.  An empty table gives no rows.  Other columns aren't read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(sketches(docs, words, least_linked(percent), bands, band_rows, count), "sketches")
    out = cluster(rows, lambda ids: full_sets(docs, ids, words), percent, count)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def least_linked(percent: int) -> int:
    """Sets of fewer shingles are linked with equal ones only."""
    return -(-percent // (100 - percent))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=3, percent=85)


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
