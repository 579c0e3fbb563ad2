"""The registry: one row per document and distinct value, with its placeholder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import is_valid_id, placeholder
from maskwright.sources.scratch import written

#: Candidates tried for an id; one in 140 is malformed, so this many never are.
ATTEMPTS = 12


def first_wins(hits: DataFrame) -> DataFrame:
    """doc_id, original, tag, types, seq, linked_to of each value; the first source's tag counts."""
    if "linked_to" not in hits.columns:
        hits = hits.withColumn("linked_to", F.lit(None).cast("string"))
    order = F.struct("source", "seq", "tag", "linked_to")
    found = hits.filter("value <> ''").groupBy("doc_id", "value").agg(F.min(order).alias("first"), F.array_sort(F.collect_set("tag")).alias("types"), F.min(F.when(F.col("linked_to").isNotNull(), F.struct("source", "seq", "linked_to"))).alias("link"))
    at = F.col("first.source").cast("long") * (1 << 58) + F.col("first.seq")
    return found.select("doc_id", F.col("value").alias("original"), F.col("first.tag").alias("tag"), "types", at.alias("seq"), F.col("link.linked_to").alias("linked_to"))


def candidates(secret: str) -> Column:
    """The well-formed ids that a row's ``original`` in its ``doc_id`` may get, in the order they are tried."""
    attempt = lambda i: F.upper(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(secret), F.col("doc_id").cast("string"), i.cast("string"), F.col("original")), 256), 1, 12))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), attempt), is_valid_id)


def with_ids(registry: DataFrame, secret: str, reserved: DataFrame | None = None) -> DataFrame:
    """Adds hex_id and placeholder.

    An id is the start of a keyed hash of document, value and attempt: the first
    attempt that is well formed and not reserved (``reserved`` has hex_id).  Should two
    values get one id, the later takes its next attempt, round by round, so no id is
    issued twice.  ``secret`` must be random per run but in tests: names and numbers
    are guessable.
    """
    rows = registry.withColumn("tries", candidates(secret))
    if reserved is not None:
        each = rows.select("doc_id", "original", F.posexplode("tries").alias("k", "hex_id")).join(reserved.select("hex_id").distinct(), "hex_id", "left_anti")
        free = each.groupBy("doc_id", "original").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "hex_id"))), lambda x: x["hex_id"]).alias("tries"))
        rows = rows.drop("tries").join(free, ["doc_id", "original"], "left")
    rows = rows.withColumn("turn", F.lit(0))
    for _ in range(ATTEMPTS):
        rows = written(rows.withColumn("hex_id", F.try_element_at("tries", F.col("turn") + 1)), "ids")
        clash = rows.groupBy("hex_id").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "original")).alias("owner")).filter("c > 1 and hex_id is not null")
        if not clash.take(1):
            break
        late = rows.join(clash, "hex_id").filter(F.struct("doc_id", "original") != F.col("owner")).select("doc_id", "original", F.lit(1).alias("late"))
        rows = rows.join(late, ["doc_id", "original"], "left").withColumn("turn", F.col("turn") + F.coalesce("late", F.lit(0))).drop("late")
    if short := rows.filter("hex_id is null").count():
        raise ValueError(f"{short} values have no free id among {ATTEMPTS} attempts")
    return rows.drop("tries", "turn").withColumn("placeholder", placeholder(F.col("tag"), F.col("hex_id")))


def resolve_links(registry: DataFrame) -> DataFrame:
    """``linked_to`` as the id of the linked value: given as an id, else as a text; unknown ones are null."""
    known = registry.select("doc_id", F.col("hex_id").alias("link_key"), F.col("hex_id").alias("id_hit")).distinct()
    named = registry.select("doc_id", F.col("original").alias("linked_to"), F.col("hex_id").alias("text_hit"))
    rows = registry.withColumn("link_key", F.upper(F.regexp_extract("linked_to", r"([0-9A-Fa-f]{12})\]?\z", 1)))
    rows = rows.join(known, ["doc_id", "link_key"], "left").join(named, ["doc_id", "linked_to"], "left")
    link = F.coalesce("id_hit", "text_hit")
    return rows.withColumn("linked_to", F.when(link != F.col("hex_id"), link)).select(registry.columns)


def deselect(registry: DataFrame, values: DataFrame | None = None, tags: Iterable[str] = ()) -> DataFrame:
    """Without some values (doc_id, original) and whole tags; links to what goes are dropped."""
    kept = registry
    if values is not None:
        kept = kept.join(values.select("doc_id", "original").distinct(), ["doc_id", "original"], "left_anti")
    if tags := list(tags):
        kept = kept.filter(~F.col("tag").isin(tags))
    if "hex_id" in kept.columns and "linked_to" in kept.columns:
        there = kept.select("doc_id", F.col("hex_id").alias("linked_to"), F.lit(True).alias("there")).distinct()
        kept = kept.join(there, ["doc_id", "linked_to"], "left").withColumn("linked_to", F.when(F.col("there"), F.col("linked_to"))).drop("there").select(registry.columns)
    return kept


def counts_per_tag(registry: DataFrame) -> DataFrame:
    return registry.groupBy("tag").agg(F.count("*").alias("n"))


def totals(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count_distinct("hex_id").alias("entities"), F.count("*").alias("replacements"))


def longest_first(registry: DataFrame) -> DataFrame:
    """Rows numbered within a document, the longest original first, then in order seen."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length("original")), "seq")
    return registry.withColumn("n", F.row_number().over(order))


def recent(registry: DataFrame, most: int = 40) -> DataFrame:
    """The last entries of each document, for a prompt."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    return registry.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def reserved_ids(ledger: DataFrame | None, keys: DataFrame | None) -> DataFrame:
    """hex_id of every id in the ledger (value, a line each) or anywhere in a key: its placeholders, entities and sheet titles."""
    out = None
    if ledger is not None:
        out = ledger.select(F.upper(F.trim("value")).alias("hex_id"))
    if keys is not None:
        each = lambda texts, pattern: keys.select(F.explode(texts).alias("p")).select(F.explode(F.regexp_extract_all("p", F.lit(pattern), F.lit(1))).alias("hex_id"))
        sources = [("replacement_map", F.map_values, r"_([0-9A-F]{12})\]"), ("entity_registry", F.map_keys, r"^([0-9A-F]{12})$"), ("sheet_titles", F.map_keys, r"_([0-9A-F]{12})(?![0-9A-F])")]
        for name, of, pattern in sources:
            if name in keys.columns:
                ids = each(of(name), pattern)
                out = ids if out is None else out.unionByName(ids)
    return out.filter(is_valid_id(F.col("hex_id"))).distinct()
