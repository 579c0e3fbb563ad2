"""Writing outputs, keys and the ledger.  Nothing unverified is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import is_valid_id
from maskwright.operators.verify import passed_only


def write_texts(outputs: DataFrame, result: DataFrame, path: str) -> None:
    """The verified outputs (doc_id, text) as a table."""
    passed_only(outputs, result).write.mode("append").parquet(path)


def csv_lines(cells: DataFrame) -> DataFrame:
    """The rows of tables as CSV: doc_id, sheet, row, line; quoted where needed, ragged rows kept."""
    quoted = F.when(F.col("value").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce("value", F.lit("")))
    rows = cells.groupBy("doc_id", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", quoted.alias("v")))).alias("c"))
    return rows.select("doc_id", "sheet", "row", F.array_join(F.transform("c", lambda x: x["v"]), ",").alias("line"))


def write_cells(cells: DataFrame, result: DataFrame, path: str) -> None:
    """The rows of verified tables as CSV lines by document."""
    csv_lines(passed_only(cells, result)).sortWithinPartitions("doc_id", "sheet", "row").write.mode("append").parquet(path)


def write_csv(cells: DataFrame, result: DataFrame, path: str) -> None:
    """Verified tables as CSV files, one for each sheet, in ``doc_id=.../sheet=...`` below ``path``; any reader of CSV opens them.

    A sheet is written by one task, in order, a row at a time.
    """
    lines = csv_lines(passed_only(cells, result)).repartition("doc_id", "sheet").sortWithinPartitions("doc_id", "sheet", "row")
    lines.select("doc_id", "sheet", "line").write.mode("append").partitionBy("doc_id", "sheet").text(path)


def write_keys(keys: DataFrame, path: str) -> None:
    keys.write.mode("append").json(path)


def record_issued(registry: DataFrame, path: str) -> None:
    """Appends the valid ids; called after the keys are written, so an id in use is never lost."""
    ids = registry.select("hex_id").filter(is_valid_id(F.col("hex_id"))).distinct()
    ids.sortWithinPartitions("hex_id").write.mode("append").text(path)


def output_name(name, session_id):
    """The name of a restored file: a former ``_anon_<session>`` goes, ``_restored`` comes."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"_anon_[0-9a-f]{8}(?: \(\d+\))?$", "")
    return F.concat(stem, F.lit("_restored"), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def free_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """``names`` (doc_id, name) with ``free``, the name to write to: none is in ``taken`` (name), and none comes twice.

    The first document of a name that isn't taken keeps it; others get the next number
    that is free, as ``list_1.csv``.
    """
    split = lambda part: F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", part)
    numbered = r"^(.+)_([1-9][0-9]{0,8})(\.[^.]*)?$"
    own = names.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("doc_id")))
    rows = own.join(taken.select("name", F.lit(True).alias("gone")).distinct(), "name", "left").withColumn("kept", (F.col("k") == 1) & F.col("gone").isNull())
    used = taken.select("name").unionByName(rows.filter("kept").select("name")).filter(F.col("name").rlike(numbered))
    part = lambda g: F.regexp_extract("name", numbered, g)
    used = used.groupBy(part(1).alias("stem"), part(3).alias("suffix")).agg(F.array_sort(F.collect_set(part(2).cast("int"))).alias("used"))
    rows = rows.withColumns({"stem": split(1), "suffix": split(2), "m": F.col("k") - F.when(F.col("gone").isNull(), 1).otherwise(0)}).join(used, ["stem", "suffix"], "left")
    number = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("m"), lambda i, u: F.when(u <= i, i + 1).otherwise(i))
    free = F.when(F.col("kept"), F.col("name")).otherwise(F.concat("stem", F.lit("_"), number.cast("string"), "suffix"))
    return rows.select(*names.columns, free.alias("free"))
