"""Detection on a stream of documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.tags import TAGS
from maskwright.operators.detect import detect_patterns


def first_seen(stream: DataFrame, tags: Iterable[str] = TAGS, delay: str = "1 hour") -> DataFrame:
    """Each value of a stream (doc_id, text, ts) once per tag within the watermark.

    State is bounded by ``delay``; a value that comes again later is reported again.
    """
    marked = stream.withWatermark("ts", delay)
    # the time goes along in the id, as detectors pass only that on
    packed = marked.select(F.struct("doc_id", "ts").alias("doc_id"), "text")
    found = detect_patterns(packed, tags).select("doc_id.doc_id", F.col("doc_id.ts").alias("ts"), "value", "tag")
    return found.dropDuplicatesWithinWatermark(["value", "tag"])


def counts_by_window(stream: DataFrame, tags: Iterable[str] = TAGS, delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Values found per tag and event-time window."""
    packed = stream.withWatermark("ts", delay).select(F.struct("doc_id", "ts").alias("doc_id"), "text")
    found = detect_patterns(packed, tags).select(F.col("doc_id.ts").alias("ts"), "tag")
    return found.groupBy(F.window("ts", window), "tag").agg(F.count("*").alias("n"))
