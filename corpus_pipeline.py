"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
The last returns the packed pieces, the others the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontamination, exact_dedup, minhash, packing, toxicity
from maskwright.llm.common import REPEATED, ROW, table, with_row_ids, without, written


def _kept(docs: DataFrame, dropped_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows that ``dropped_of`` names by ``doc_id``, decided row by row even where an id repeats."""
    rows = with_row_ids(docs)
    dropped = dropped_of(rows.select(F.col(ROW).alias("doc_id"), "text"))
    return without(rows, dropped.select(F.col("doc_id").alias(ROW)), ROW)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject at its language's threshold.

    Every row is judged alone, by its own text: repeated rows and null ids like others,
    null and empty texts as empty ones.  Without usable labels nothing is learnt and all
    rows get the same score.  An empty table stays empty; all columns are returned.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.remove_flagged(docs, model)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that exact dedup keeps (the most code points, then the smallest id).

    Null, empty and white texts are equal.  Rows of one id but different texts are
    decided each; of rows equal in id and text one stays.  Rows with a null id stay.  An
    empty table stays empty; all columns are returned.
    """
    rows = _kept(docs, lambda rows: exact_dedup.exact_dedup(rows).filter("not kept"))
    # rows that share id and text share all decisions so far
    return rows.filter(~F.col(REPEATED)).unionByName(rows.filter(REPEATED).dropDuplicates([ROW])).select(docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five words, 0.8): the smallest id.

    Texts without words, null ones too, are near nothing and stay.  Rows of one id but
    different texts are decided each; rows equal in both share their fate.  Rows with a
    null id stay.  An empty table stays empty; all columns are returned.
    """
    return _kept(docs, lambda rows: minhash.near_components(rows, words=5, percent=80).filter("not kept")).select(docs.columns)


def remove_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Rows of one id but different texts are decided each; rows equal in both share their
    fate.  Null and empty texts and rows with a null id stay.  An empty table or
    benchmark drops nothing; all columns are returned.
    """
    return _kept(docs, lambda rows: decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows that are left, repeated ids and null ones too, packed into sequences of 4096 tokens.

    Null and empty texts are an end id alone.  An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark_copies),
    ("packing", pack),
]

#: Trained, hashed and packed stages have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
