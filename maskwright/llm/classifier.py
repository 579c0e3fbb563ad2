"""What the two trained classifiers share: their labelled sample and its split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import crc32_fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """Up to about ``most`` labelled rows outside the held-out fold: doc_id, lang, text, label.

    The bound is kept by the hash of the id, so the sample is the same on every run;
    only narrow rows are joined before it.  Rows with a null id or label are left out.
    """
    fold = crc32_fold("doc_id", parts)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold != held_out)).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * most / total)))
    chosen = F.broadcast(known.limit(2 * most))  # bounded by the parameter
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
