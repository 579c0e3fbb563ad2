"""Tables in long form: one row per cell (doc_id, sheet, row, col, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.matcher import Matcher, placeholders, splice, with_own_map

#: Rows of a table that its values travel with.
BLOCK_ROWS = 2_000
KEY = ["doc_id", "sheet", "row", "col"]


def to_cells(table: DataFrame, doc_id: Column, columns: list[str], order: str) -> DataFrame:
    """A relational table as one sheet with a header row, all values as strings; rows by ``order``."""
    numbered = table.withColumn("_row", F.row_number().over(Window.partitionBy(doc_id).orderBy(order)))
    body = numbered.select(doc_id.alias("doc_id"), F.lit(0).alias("sheet"), F.col("_row").alias("row"), F.posexplode(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))).alias("col", "value"))
    head = table.select(doc_id.alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("sheet"), F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, columns))).alias("col", "value"))
    return head.unionByName(body)


def sheet_width(cells: DataFrame) -> DataFrame:
    return cells.groupBy("doc_id", "sheet").agg((F.max("col") + 1).alias("width"))


def sheet_text(cells: DataFrame, separator: str = ",") -> DataFrame:
    """doc_id and text: cells joined by ``separator``, rows by a line end."""
    rows = cells.groupBy("doc_id", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("c"))
    lines = rows.select("doc_id", F.struct("sheet", "row", F.array_join(F.transform("c", lambda x: x["value"]), separator).alias("line")).alias("l"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def apply_overrides(cells: DataFrame, overrides: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Cells rewritten where they still hold what was expected; ``skipped`` marks the others.

    ``overrides`` has the key, expected and new.  ``forbidden`` (the key) are cells that
    can't be rewritten, as a formula's or a merged one; they are skipped too.
    """
    rows = cells.join(overrides.select(*KEY, "expected", "new"), KEY, "left")
    value = F.coalesce("value", F.lit(""))
    hit = F.col("new").isNotNull() & (value == F.col("expected"))
    if forbidden is not None:
        rows = rows.join(forbidden.select(*KEY, F.lit(True).alias("fixed")).distinct(), KEY, "left")
        hit = hit & F.col("fixed").isNull()
    return rows.select(*KEY, F.when(hit, F.col("new")).otherwise(value).alias("value"), hit.alias("overridden"), (F.col("new").isNotNull() & ~hit).alias("skipped"))


def written_cells(done: DataFrame, overrides: DataFrame) -> DataFrame:
    """The overrides that ``apply_overrides`` carried out, as a key records them: the key, written, original."""
    hit = done.filter("overridden").select(*KEY)
    return overrides.join(hit, KEY, "left_semi").select(*KEY, F.col("new").alias("written"), F.col("expected").alias("original"))


def scrub_cells(cells: DataFrame, registry: DataFrame, overrides: DataFrame | None = None, protected: tuple[str, ...] = ()) -> DataFrame:
    """Cells with overrides applied first and every registered value replaced in the others."""
    if overrides is None:
        rows = cells.select(*KEY, F.coalesce("value", F.lit("")).alias("value"), F.lit(False).alias("overridden"), F.lit(False).alias("skipped"))
    else:
        rows = apply_overrides(cells, overrides)
    left = rows.filter("not overridden")
    texts = _scrubbed(left.select(*KEY, "value"), registry, set(protected)).withColumnRenamed("value", "_new")
    done = left.join(texts, KEY, "left").withColumn("value", F.coalesce("_new", "value")).drop("_new") if overrides is not None else texts.select(*KEY, F.col("_new").alias("value"), F.lit(False).alias("overridden"), F.lit(False).alias("skipped"))
    return done.unionByName(rows.filter("overridden"))


def _scrubbed(cells: DataFrame, registry: DataFrame, protected: set[str]) -> DataFrame:
    """Cells with their document's values replaced.

    A table can have as many values as cells, so they travel with a block of BLOCK_ROWS
    rows, not with each cell, and their automaton is built once a block.
    """
    block = (F.col("row") / BLOCK_ROWS).cast("int").alias("_block")
    blocks = cells.groupBy("doc_id", "sheet", block).agg(F.collect_list(F.struct("row", "col", "value")).alias("cells"))
    rows = with_own_map(blocks, registry.dropDuplicates(["doc_id", "original"]))
    plain = rows.filter("own is null").select("doc_id", "sheet", F.inline("cells"))
    out = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in (*KEY, "value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {a: b for a, b in batch.column("own")[k].as_py() if a}
                matcher = Matcher(own, placeholders(own.values()) | protected)
                inner = batch.column("cells").slice(k, 1).flatten()
                row, col, value = inner.flatten()
                new = [splice(x, ((a, b, own[v]) for a, b, v in matcher.find(x))) if x else x for x in value.to_pylist()]
                same = pa.array([k] * len(new), pa.int64())
                yield pa.record_batch([batch.column("doc_id").take(same), batch.column("sheet").take(same), row, col, pa.array(new, pa.string())], names=[*KEY, "value"])

    return rows.filter("own is not null").select("doc_id", "sheet", "cells", "own").mapInArrow(run, out).unionByName(plain)


def append_column(cells: DataFrame, specs: DataFrame, values: DataFrame) -> DataFrame:
    """Cells with a new column: specs (doc_id, sheet, col, header_row, header), values (doc_id, sheet, row, value).

    Only the header's row and those with a value are padded up to the column.
    """
    heads = specs.select("doc_id", "sheet", F.col("header_row").alias("row"), "col", F.col("header").alias("value"))
    new = heads.unionByName(values.join(specs.select("doc_id", "sheet", "col"), ["doc_id", "sheet"]).select("doc_id", "sheet", "row", "col", "value"))
    width = cells.groupBy("doc_id", "sheet", "row").agg((F.max("col") + 1).alias("width"))
    holes = new.join(width, ["doc_id", "sheet", "row"], "left").withColumn("width", F.coalesce("width", F.lit(0))).filter("width < col")
    pads = holes.select("doc_id", "sheet", "row", F.explode(F.expr("sequence(width, col - 1)")).alias("col"), F.lit("").alias("value"))
    return cells.select(*KEY, "value").unionByName(pads).unionByName(new)


def intact_columns(cells: DataFrame, specs: DataFrame, token: str = r"^\[[IF](?:[0-9A-F]{16}|[0-9A-F]{8})\]$") -> DataFrame:
    """The appended columns that are still exactly so: the header in place, the rest empty or a token."""
    found = cells.join(specs, ["doc_id", "sheet", "col"])
    value = F.coalesce("value", F.lit(""))
    good = F.when(F.col("row") == F.col("header_row"), value == F.col("header")).otherwise((value == "") | value.rlike(token))
    ok = found.groupBy("doc_id", "sheet", "col").agg(F.bool_and(good).alias("ok"), F.bool_or(F.col("row") == F.col("header_row")).alias("headed"))
    return specs.join(ok.filter("ok and headed").select("doc_id", "sheet", "col"), ["doc_id", "sheet", "col"], "left_semi")


def remove_columns(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """Cells without the appended columns that are intact, padding of their rows included."""
    gone = intact_columns(cells, specs).select("doc_id", "sheet", "col")
    return cells.join(gone, ["doc_id", "sheet", "col"], "left_anti")


def best_layout(cells: DataFrame, layouts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The key whose written cells stand at most of their places: doc_id, session_id, hits.

    ``layouts`` has session_id, sheet, row, col, written, original; ``names`` (doc_id,
    session_id) breaks ties by file name.  Keys that tie and would restore
    differently give none.
    """
    hit = cells.join(layouts, ["sheet", "row", "col"]).filter("value = written")
    order = F.array_sort(F.collect_list(F.struct("sheet", "row", "col", "original")))
    score = hit.groupBy("doc_id", "session_id").agg(F.count("*").alias("hits"), order.alias("content"))
    top = score.withColumn("best", F.max("hits").over(Window.partitionBy("doc_id"))).filter("hits = best")
    named = F.lit(False)
    if names is not None:
        top = top.join(names.select("doc_id", "session_id", F.lit(True).alias("named")).distinct(), ["doc_id", "session_id"], "left")
        named = F.coalesce("named", F.lit(False))
    per = Window.partitionBy("doc_id")
    top = top.withColumns({"n": F.row_number().over(per.orderBy(F.desc(named), "session_id")), "same": F.min(F.hash("content")).over(per) == F.max(F.hash("content")).over(per), "has_name": F.max(named).over(per)})
    return top.filter("n = 1 and (same or has_name)").select("doc_id", "session_id", "hits")
