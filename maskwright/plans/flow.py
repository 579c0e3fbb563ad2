"""The whole way of a document: detect, register, replace, verify."""

from __future__ import annotations

import secrets
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.tags import TAGS
from maskwright.operators import detect, registry
from maskwright.operators.matcher import chosen_spans, scrub
from maskwright.operators.verify import verify
from maskwright.sources.scratch import written


class Result(NamedTuple):
    outputs: DataFrame
    registry: DataFrame
    verified: DataFrame


def register(docs: DataFrame, tags: Iterable[str] = TAGS, terms: DataFrame | None = None, cells: DataFrame | None = None, model_hits: DataFrame | None = None, certain: DataFrame | None = None, ascii_words: bool = False) -> DataFrame:
    """The registry of all detectors by precedence, stretches of overlap included, without ids.

    Hits are written once, so each detector runs once and a model is asked once a chunk.
    """
    parts = [detect.detect_patterns(docs, tags, ascii_words)]
    if model_hits is not None:
        parts.append(model_hits)
    if terms is not None:
        parts.append(detect.detect_terms(docs, terms))
    if certain is not None:
        parts.append(certain)
    # what follows reads the hits more than once, and a detector must run once
    found = written(detect.union_hits(parts), "hits")
    if cells is not None:
        roster = F.col("source") == detect.SOURCES.index("roster")
        known = registry.first_wins(found.filter(~roster)).select("doc_id", F.col("original").alias("value"), "tag")
        found = detect.union_hits([found, written(detect.detect_consensus(cells, known), "hits")])
    values = registry.first_wins(found).select("doc_id", F.col("original").alias("value"), "tag")
    return registry.first_wins(detect.union_hits([found, detect.overlap_unions(values, docs)]))


def anonymise(docs: DataFrame, secret: str | None = None, reserved: DataFrame | None = None, deselected: DataFrame | None = None, deselected_tags: Iterable[str] = (), **found) -> Result:
    """Scrubbed documents with their registry and the check of each.

    Without a given secret the ids are new on every run.  Write through
    ``sources.sinks``, which lets verified outputs pass only.
    """
    rows = registry.with_ids(register(docs, **found), secret or secrets.token_hex(16), reserved)
    rows = registry.deselect(registry.resolve_links(rows), deselected, deselected_tags)
    outputs = scrub(docs, rows)
    return Result(outputs, rows, verify(outputs, rows))


def preview(docs: DataFrame, rows: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, the first characters of a text with its values replaced, and the number of values."""
    shown = docs.withColumn("text", F.substring("text", 1, most))
    return scrub(shown, rows).select("doc_id", "text", F.col("replaced").alias("spans"))


def preview_spans(docs: DataFrame, rows: DataFrame, most: int = 10_000) -> DataFrame:
    """The places in the first characters of each text that would be replaced: doc_id, start, end, original, placeholder."""
    found = chosen_spans(docs.select("doc_id", F.substring("text", 1, most).alias("text")), rows)
    return found.join(rows.select("doc_id", "original", "placeholder").dropDuplicates(["doc_id", "original"]), ["doc_id", "original"]).select("doc_id", "start", "end", "original", "placeholder")


def preview_counts(docs: DataFrame, rows: DataFrame, amounts: DataFrame | None = None, missing: int | None = 0) -> DataFrame:
    """What a preview says of each document: doc_id, char_count, truncated, counts by tag, entities, replacements, kept_amounts.

    ``amounts`` (doc_id, value) are the plain amounts that detectors left alone.  ``missing`` is
    the char_count of a missing text; None, as in SQL, leaves it and truncated null.
    """
    per = rows.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.collect_set("hex_id").alias("ids"))
    counts = per.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("counts"), F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("long").alias("entities"), F.sum("n").alias("replacements"),
    )
    size = F.coalesce(F.length("text"), F.lit(missing)).cast("long")
    out = docs.select("doc_id", size.alias("char_count"), (size > 10_000).alias("truncated")).join(counts, "doc_id", "left")
    kept = amounts.groupBy("doc_id").agg(F.count_distinct("value").alias("kept_amounts")) if amounts is not None else docs.select("doc_id", F.lit(0).cast("long").alias("kept_amounts")).limit(0)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.join(kept, "doc_id", "left").select("doc_id", "char_count", "truncated", F.coalesce("counts", F.expr("cast(map() as map<string,bigint>)")).alias("counts"), zero("entities"), zero("replacements"), zero("kept_amounts"))
