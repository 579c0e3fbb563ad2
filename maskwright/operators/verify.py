"""The residue check that every output must pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.detect import residue
from maskwright.operators.matcher import Matcher, document_occurrences, placeholders, with_own_map


def surviving(outputs: DataFrame, registry: DataFrame) -> DataFrame:
    """Originals that still stand in their document's output: doc_id, tag, matches."""
    rows = with_own_map(outputs.select("doc_id", "text"), registry.dropDuplicates(["doc_id", "original"]))
    kind = outputs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "own")), strict=True):
                own = {k: v for k, v in own or () if k}
                if text and own:
                    out += [(doc_id, own[v].strip("[]").rpartition("_")[0]) for _, _, v in Matcher(own, placeholders(own.values())).find(text)]
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.record_batch([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.string())], names=["doc_id", "tag"])

    found = rows.filter("own is not null").select("doc_id", "text", "own").mapInArrow(run, f"doc_id {kind}, tag string")
    return found.groupBy("doc_id", "tag").agg(F.count("*").alias("matches"))


def verify(outputs: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, passed, map_match_types, regex_match_types, total_matches of each output.

    Only originals that survive fail an output; shapes that look private are named as
    a warning.
    """
    left = surviving(outputs, registry).groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("map_match_types"), F.sum("matches").alias("total_matches"))
    none = F.array().cast("array<string>")
    return (
        outputs.select("doc_id").distinct().join(left, "doc_id", "left").join(residue(outputs), "doc_id", "left")
        .select("doc_id", F.col("total_matches").isNull().alias("passed"), F.coalesce("map_match_types", none).alias("map_match_types"), F.coalesce("labels", none).alias("regex_match_types"), F.coalesce("total_matches", F.lit(0)).alias("total_matches"))
    )


def passed_only(outputs: DataFrame, result: DataFrame) -> DataFrame:
    """The outputs that passed; the gate that every sink goes through."""
    return outputs.join(result.filter("passed").select("doc_id"), "doc_id", "left_semi")


def residual_names(outputs: DataFrame, names: DataFrame) -> DataFrame:
    """Names (doc_id, name) that still stand as whole words: doc_id, name, matches.

    A text travels once, with all its names, which one automaton finds.
    """
    found = document_occurrences(outputs, names.select("doc_id", F.col("name").alias("value"), F.lit("PERSON").alias("tag")).filter("value <> ''"), whole=True)
    return found.groupBy("doc_id", F.col("value").alias("name")).agg(F.count("*").cast("int").alias("matches"))
