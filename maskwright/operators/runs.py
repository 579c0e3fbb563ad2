"""Replacing in texts that are stored in pieces.

Office formats cut a paragraph into runs wherever its style changes, so a value can
begin in one run and end in another.  Values are looked for in the joined paragraph
and mapped back to the runs that hold them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from maskwright.operators.matcher import Matcher, placeholders, with_own_map

KEYS = ["doc_id", "paragraph"]
#: Values up to which a paragraph is searched for each of them before it is sent to Python.
FEW_VALUES = 8


def paragraphs(runs: DataFrame) -> DataFrame:
    """doc_id, paragraph, and, in order, its runs' numbers ``run`` and texts ``pieces``."""
    each = runs.select(*KEYS, F.col("run").cast("int").alias("run"), F.coalesce("text", F.lit("")).alias("text"))
    rows = each.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("run", "text"))).alias("r"))
    return rows.select(*KEYS, F.col("r.run").alias("run"), F.col("r.text").alias("pieces"))


def _clear_of(spans: list[tuple[int, int, str]], shut: Iterable[dict]) -> list[tuple[int, int, str]]:
    """The spans (by start, none overlaps) that touch no forbidden place."""
    starts, ends = [], []
    for a, b in sorted((s["start"], s["end"]) for s in shut if s["start"] < s["end"]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    before = lambda end: bisect_left(starts, end) - 1  # noqa: E731  the last place that begins before it
    return [s for s in spans if before(s[1]) < 0 or ends[before(s[1])] <= s[0]]


def replaced(pieces: list[str], own: dict[str, str], shut: Iterable[dict] = ()) -> list[str] | None:
    """The pieces of one text with its values replaced, each in the piece where it begins; None if there are none."""
    text = "".join(pieces)
    spans = _clear_of(Matcher(own, placeholders(own.values())).find(text), shut)
    if not spans:
        return None
    out, at, k = [], 0, 0
    for piece in pieces:
        end, parts = at + len(piece), []
        while k < len(spans) and spans[k][0] < end:
            start, stop, value = spans[k]
            parts += [text[at:start], own[value] if start >= at else ""]
            at = max(at, min(stop, end))
            if stop > end:
                break
            k += 1
        out.append("".join([*parts, text[at:end]]))
        at = end
    return out


@F.arrow_udf(ArrayType(StringType()))
def _replaced(pieces: pa.Array, own: pa.Array, shut: pa.Array) -> pa.Array:
    out = []
    for texts, values, places in zip(pieces.to_pylist(), own.to_pylist(), shut.to_pylist(), strict=True):
        values = {k: v for k, v in values or () if k} if texts else {}
        out.append(replaced(texts, values, places or ()) if values else None)
    return pa.array(out, pa.list_(pa.string()))


def _may_hold(text: Column, own: Column) -> Column:
    """Whether a value can stand in a text; surely not if none of a few is in it."""
    return own.isNotNull() & ((F.size(own) > FEW_VALUES) | F.exists(F.map_keys(own), lambda v: F.contains(text, v)))


def scrub_paragraphs(paragraphs: DataFrame, registry: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """``paragraphs`` (doc_id, paragraph, pieces: the texts of its runs, and any more columns) with ``new``, the pieces with their document's values replaced.

    The placeholder goes to the piece in which a value begins; the rest of the value is
    taken from the pieces it goes on in, which may become empty.
    A place that touches a ``forbidden`` one (doc_id, paragraph, start, end; half open) is
    left alone: text that is structure, as the name of a field or what isn't a literal of
    a formula.  Only paragraphs that can hold a value leave the JVM, and the work on one
    grows with its text.  Paragraphs dealt out by doc_id aren't shuffled again.
    """
    rows = paragraphs
    if forbidden is None:
        rows = rows.withColumn("shut", F.lit(None).cast("array<struct<start:int,end:int>>"))
    else:
        shut = forbidden.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("shut"))
        rows = rows.join(shut, KEYS, "left")
    rows = with_own_map(rows, registry.dropDuplicates(["doc_id", "original"]))
    rows = rows.withColumn("sent", _may_hold(F.array_join("pieces", ""), F.col("own")))
    new = _replaced(*(F.when(F.col("sent"), F.col(c)) for c in ("pieces", "own", "shut")))
    return rows.withColumn("new", F.coalesce(new, "pieces")).select(*paragraphs.columns, "new")


def scrub_runs(runs: DataFrame, registry: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """``scrub_paragraphs`` of runs that are rows (doc_id, paragraph, run, text): doc_id, paragraph, run, text, changed.

    Null texts become empty.  Runs are gathered once; a task holds one paragraph.
    """
    done = scrub_paragraphs(paragraphs(runs), registry, forbidden)
    each = done.select(*KEYS, F.inline(F.arrays_zip("run", "pieces", "new")))
    return each.select(*KEYS, "run", F.col("new").alias("text"), (F.col("new") != F.col("pieces")).alias("changed"))
