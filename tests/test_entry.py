import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from maskwright.plans import queries as core
from maskwright.plans import table_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["tag", "n"]


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = connection.sql(core.ORACLE_SQL[name]).df()
    got = core.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns)


def test_core_imports_alone():
    for name in ("operators.detect", "operators.roster", "sources.files", "streaming.detect", "plans.flow"):
        assert importlib.import_module(f"maskwright.{name}")


NEAR_OTHER_SCRIPTS = ["15.201.41.87 Stühle", "é12 Oak Hill Rd", "5 Lake Way #ü", "9 Elm Ave Apt 4é", "ñ555-123-4567", "4111 1111 1111 1111ß", "123-45-6789é", "٣1.2.3.44", "a@b.org 12 Oak St"]


@pytest.mark.parametrize("name", """detect_address detect_phone detect_ip detect_id detect_financial registry_first_wins counts_per_tag registry_totals assign_ids longest_first
    recent_entries deselect_tags rollup_by_lang issued_ids reserved_ids preview_counts residue_labels""".split())
def test_words_end_at_letters_beyond_ascii_as_in_sql(spark, tmp_path, name):
    texts = [(k, x, "de") for k, x in enumerate(NEAR_OTHER_SCRIPTS)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.sql(core.ORACLE_SQL[name]).df()
    got = core.QUERIES[name](spark, str(tmp_path)).toPandas()
    columns = sorted(want.columns)
    assert len(want) and rows(got, columns) == rows(want, columns)


def test_preview_counts_of_a_document_without_text_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "a@b.org 12 Oak St")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = core.QUERIES["preview_counts"](spark, str(tmp_path))
    want = connection.sql(f"select {', '.join(got.columns)} from ({core.ORACLE_SQL['preview_counts']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and (1, None, None, 0, 0, 0) in want


def test_issued_ids_of_negative_documents_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(-3, "a@b.org"), (-2, "12 Oak St"), (1, "1.2.3.44")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = core.QUERIES["issued_ids"](spark, str(tmp_path))
    want = connection.sql(f"select {', '.join(got.columns)} from ({core.ORACLE_SQL['issued_ids']})").fetchall()
    assert len(want) == 3 and sorted(map(tuple, got.collect())) == sorted(want)
