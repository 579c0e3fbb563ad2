"""New titles for sheets whose titles hold private values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.cells import scrub_cells
from maskwright.operators.registry import with_ids
from maskwright.sources.scratch import written

# What a title can't hold, and its length.
UNFIT, LONGEST = r"[\[\]:*?/\\']", 31
_BRACKETS = r"\[([A-Z]+_[0-9A-F]{12})\]"


def sheet_titles(titles: DataFrame, registry: DataFrame, secret: str, reserved: DataFrame | None = None) -> DataFrame:
    """The sheets (doc_id, sheet, title) whose title changes: doc_id, sheet, original, written.

    A title's values are replaced by their placeholders without brackets, and characters
    that no title can have by ``_``.  What would be empty, too long, or, whatever its
    case, the title of another sheet becomes ``SHEET_`` and an id of its own.  Sheets are
    renamed in order: a title is free once its sheet was renamed, and of several sheets
    that would get the same one the first does.  A workbook's titles are searched in
    blocks, as cells are, and compared by a join on equal titles and a window; each step
    is done once and written, no matter how many titles there are.
    """
    # as cells of one column; the title itself goes along in the column's place
    cells = titles.filter("title is not null").select("doc_id", F.lit(0).alias("sheet"), F.col("sheet").alias("row"), F.col("title").alias("col"), F.col("title").alias("value"))
    rows = scrub_cells(cells, registry).select("doc_id", F.col("row").alias("sheet"), F.col("col").alias("original"), F.col("value").alias("text"))
    fit = F.trim(F.regexp_replace(F.regexp_replace("text", _BRACKETS, "$1"), UNFIT, "_"))
    new = written(rows.select("doc_id", "sheet", "original", (F.col("text") != F.col("original")).alias("changed"), fit.alias("fit"), F.lower(fit).alias("key")), "titles")
    # the title of a sheet that keeps it, or that isn't renamed before
    there = new.groupBy("doc_id", F.lower("original").alias("key")).agg(F.bool_or(~F.col("changed")).alias("stays"), F.max("sheet").alias("last"))
    blocked = F.coalesce(F.col("stays") | (F.col("last") >= F.col("sheet")), F.lit(False))
    able = (F.col("fit") != "") & (F.length("fit") <= LONGEST) & ~blocked
    first = F.row_number().over(Window.partitionBy("doc_id", "key", "able").orderBy("sheet"))
    judged = new.filter("changed").join(there, ["doc_id", "key"], "left").withColumn("able", able).withColumn("kept", F.col("able") & (first == 1))
    judged = written(judged.select("doc_id", "sheet", "original", "fit", "kept"), "titles")
    seed = F.concat_ws("\x1f", F.col("sheet").cast("string"), "title")
    own = judged.filter("not kept").select("doc_id", "sheet", F.col("original").alias("title"), F.lit("SHEET").alias("tag")).withColumn("original", seed)
    named = with_ids(own, secret, reserved).select("doc_id", "sheet", F.col("title").alias("original"), F.concat(F.lit("SHEET_"), "hex_id").alias("written"))
    return named.unionByName(judged.filter("kept").select("doc_id", "sheet", "original", F.col("fit").alias("written")))
