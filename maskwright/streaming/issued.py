"""Ids issued to the values of a stream, none of them twice, against a growing ledger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskwright.functions.text import placeholder
from maskwright.operators.registry import candidates, with_ids
from maskwright.sources.scratch import written

LEDGER = "hex_id string, doc_id string, original string, tag string, run string, batch long"
#: Candidates of a batch up to which they are sent to the ledger's scan instead of shuffling the ledger.
BROADCAST_IDS = 1_000_000


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every id that was ever issued, with its value."""
    try:
        return spark.read.schema(LEDGER).option("basePath", path).parquet(path)
    except AnalysisException as e:  # nothing was issued yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def issue_batch(values: DataFrame, batch: int, path: str, secret: str, run: str = "run") -> DataFrame:
    """Ids of the distinct values (doc_id, original, tag) of a batch, entered in the ledger at ``path`` before they are returned.

    Gives doc_id, original, tag, hex_id, placeholder.  A value that its document had
    before keeps its id and tag; any other gets the first candidate that nobody has, in
    this batch or in the ledger.  A batch that runs again replaces its own part of the
    ledger with the same ids, as candidates are keyed hashes and its own part doesn't
    count as taken.  One stream writes to a ledger at a time.
    """
    spark = values.sparkSession
    own = (F.col("run") == run) & (F.col("batch") == batch)
    before = ledger(spark, path).filter(~own)
    rows = values.select(F.col("doc_id").cast("string").alias("doc_id"), "original", "tag").filter("original <> ''")
    rows = written(rows.groupBy("doc_id", "original").agg(F.min("tag").alias("tag")), "values")
    wanted = written(rows.select("doc_id", "original", F.explode(candidates(secret)).alias("hex_id")), "candidates")
    few = wanted.count() <= BROADCAST_IDS
    ids, names = wanted.select("hex_id").distinct(), rows.select("doc_id", "original")
    if few:
        ids, names = F.broadcast(ids), F.broadcast(names)
    known = written(before.join(names, ["doc_id", "original"], "left_semi").groupBy("doc_id", "original").agg(F.min(F.struct("run", "batch", "hex_id", "tag")).alias("k")).select("doc_id", "original", "k.hex_id", "k.tag"), "known")
    taken = written(before.join(ids, "hex_id", "left_semi").select("hex_id"), "taken")
    new = rows.join(known.select("doc_id", "original"), ["doc_id", "original"], "left_anti")
    issued = with_ids(new, secret, taken)
    issued.select("hex_id", "doc_id", "original", "tag").sortWithinPartitions("hex_id").write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")
    old = known.withColumn("placeholder", placeholder(F.col("tag"), F.col("hex_id")))
    columns = ["doc_id", "original", "tag", "hex_id", "placeholder"]
    return issued.select(*columns).unionByName(old.select(*columns))


def issue_stream(values: DataFrame, path: str, output: str, secret: str, checkpoint: str, run: str = "run") -> DataStreamWriter:
    """A stream of values, each batch's ids written below ``output`` once they are in the ledger at ``path``."""

    def one(rows: DataFrame, batch: int) -> None:
        issue_batch(rows, batch, path, secret, run).write.mode("overwrite").parquet(f"{output}/run={run}/batch={batch}")

    return values.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
