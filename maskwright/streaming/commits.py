"""Commits of a stream, sent once each, with their outcomes kept in a ledger.

The ledger is two tables in one folder.  ``intents`` has every request before it is
sent, ``outcomes`` what came of it; each batch of the stream writes its own part of
both, so a batch that runs again finds what it did before.  A request is open from its
intent until an outcome other than ``unknown`` is there, and a document has one open
request at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskwright.functions.text import canonical_hash
from maskwright.sources.scratch import written

INTENTS = "idempotency_key string, doc_id string, scope string, request string, batch long"
OUTCOMES = "idempotency_key string, doc_id string, outcome string, answer string, batch long"
UNKNOWN, FROZEN = "unknown", "frozen"


def _part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    except AnalysisException as e:  # nothing was written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def intents(spark: SparkSession, path: str) -> DataFrame:
    """Every request that was sent or was about to be: idempotency_key, doc_id, scope, request, batch."""
    return _part(spark, path, "intents", INTENTS)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """What came of requests, ``frozen`` for those that weren't sent: idempotency_key, doc_id, outcome, answer, batch."""
    return _part(spark, path, "outcomes", OUTCOMES)


def settled(spark: SparkSession, path: str) -> DataFrame:
    """The first real outcome of each request."""
    real = outcomes(spark, path).filter(~F.col("outcome").isin(UNKNOWN, FROZEN))
    first = real.groupBy("idempotency_key").agg(F.min(F.struct("batch", "doc_id", "outcome", "answer")).alias("o"))
    return first.select("idempotency_key", "o.doc_id", "o.outcome", "o.answer")


def open_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests whose outcome nobody knows: idempotency_key, doc_id, scope, request."""
    first = intents(spark, path).groupBy("idempotency_key").agg(F.min(F.struct("batch", "doc_id", "scope", "request")).alias("i"))
    return first.select("idempotency_key", "i.doc_id", "i.scope", "i.request").join(settled(spark, path).select("idempotency_key"), "idempotency_key", "left_anti")


def _write(df: DataFrame, path: str, name: str, batch: int) -> None:
    """This batch's part of a table; a batch that runs again replaces what it left unfinished."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def commit_batch(requests: DataFrame, batch: int, path: str, send: Callable[[DataFrame], DataFrame], scope: str = "") -> None:
    """Sends the requests of one batch and enters their outcomes in the ledger at ``path``.

    ``requests`` has doc_id (as text) and the columns of a request; ``seq``, if there,
    orders those of a document and isn't part of the request.  ``send`` gets
    idempotency_key, doc_id and request (JSON) and returns idempotency_key, outcome and
    answer; a missing outcome is ``unknown``.

    A request with a real outcome isn't sent again.  While a document has an open
    request, that one alone is sent again, unchanged, and under its first ``scope`` only;
    any other is entered as ``frozen``.  Of several new requests of a document in one
    batch the first goes.  A batch that runs again sends only what it meant to send and
    has no real outcome of, so one that was finished sends nothing.
    """
    spark = requests.sparkSession
    body = [c for c in requests.columns if c != "seq"]
    seq = F.col("seq").cast("long") if "seq" in requests.columns else F.lit(0).cast("long")
    key = canonical_hash(*(F.col(c) for c in sorted(body)))
    keyed = requests.select(key.alias("idempotency_key"), F.col("doc_id").cast("string").alias("doc_id"), F.to_json(F.struct(*sorted(body))).alias("request"), seq.alias("seq"))
    keyed = written(keyed.groupBy("idempotency_key").agg(F.min("doc_id").alias("doc_id"), F.min("request").alias("request"), F.min("seq").alias("seq")), "requests")
    mine = intents(spark, path).filter(F.col("batch") == batch)
    known, waiting = settled(spark, path), open_requests(spark, path)
    if mine.take(1):  # it ran before: nothing new is decided
        plan = written(waiting.join(mine.select("idempotency_key"), "idempotency_key", "left_semi").filter(F.col("scope") == scope), "again")
        held = outcomes(spark, path).filter((F.col("batch") == batch) & (F.col("outcome") == FROZEN)).select("idempotency_key", "doc_id", "outcome", "answer")
        before = outcomes(spark, path).filter((F.col("batch") == batch) & (F.col("outcome") != FROZEN)).select("idempotency_key", "doc_id", "outcome", "answer")
        if not plan.take(1) and not mine.join(before, "idempotency_key", "left_anti").take(1):
            return
        kept = written(held.unionByName(before.join(plan.select("idempotency_key"), "idempotency_key", "left_anti")), "kept")
    else:
        left = keyed.join(known.select("idempotency_key"), "idempotency_key", "left_anti")
        left = left.join(waiting.select("idempotency_key", F.col("scope").alias("first_scope")), "idempotency_key", "left")
        left = left.join(waiting.select("doc_id", F.lit(True).alias("waits")).distinct(), "doc_id", "left")
        again = F.col("first_scope").isNotNull()
        goes = F.when(again, F.col("first_scope") == scope).otherwise(F.col("waits").isNull())
        own = F.row_number().over(Window.partitionBy("doc_id", "goes").orderBy("seq", "idempotency_key"))
        left = written(left.withColumn("goes", goes).withColumn("goes", F.col("goes") & (again | F.col("doc_id").isNull() | (own == 1))), "decided")
        plan = left.filter("goes").select("idempotency_key", "doc_id", F.lit(scope).alias("scope"), "request")
        kept = left.filter("not goes").select("idempotency_key", "doc_id", F.lit(FROZEN).alias("outcome"), F.lit(None).cast("string").alias("answer"))
        _write(plan, path, "intents", batch)
    came = send(plan.select("idempotency_key", "doc_id", "request"))
    came = written(came.select("idempotency_key", "outcome", F.col("answer").cast("string").alias("answer") if "answer" in came.columns else F.lit(None).cast("string").alias("answer")), "outcomes")
    sent = plan.join(came, "idempotency_key", "left").select("idempotency_key", "doc_id", F.coalesce("outcome", F.lit(UNKNOWN)).alias("outcome"), "answer")
    _write(sent.unionByName(kept), path, "outcomes", batch)


def commit_stream(requests: DataFrame, path: str, send: Callable[[DataFrame], DataFrame], checkpoint: str, scope: str = "") -> DataStreamWriter:
    """A stream of requests, each batch committed by ``commit_batch``; the caller sets the trigger and starts it."""
    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: commit_batch(rows, batch, path, send, scope))
