"""Answers of a model, as text, read as lists of items."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = "array<struct<text:string,type:string,linked_to:string>>"
# Fixed value: a fenced block.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
# Characters of the shortest text that is halved, and how far each half goes beyond the cut.
LEAST_SPLIT, SPLIT_OVERLAP = 400, 80


def _list(text: Column) -> Column:
    """The array that a JSON text is, or the only array among the values of the object it is; as a variant, else null."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    inner = F.filter(F.map_values(F.when(kind.startswith("OBJECT"), value.cast("map<string,variant>"))), lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    return F.when(kind.startswith("ARRAY"), value).when(F.size(inner) == 1, F.get(inner, F.lit(0)))


def first_brackets(text: Column) -> Column:
    """From the first ``[`` to the bracket that closes it; null without one."""
    parts = F.regexp_extract_all(F.regexp_substr(text, F.lit(r"(?s)\[.*")), F.lit(r"[\[\]]|[^\[\]]+"), F.lit(0))
    begin = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"), F.lit(False).alias("shut"))

    def step(at: Column, part: Column) -> Column:
        now = at["open"] + F.when(part == "[", 1).when(part == "]", -1).otherwise(0)
        return F.when(at["shut"], at).otherwise(F.struct(now.alias("open"), (at["n"] + 1).alias("n"), (now == 0).alias("shut")))

    end = F.aggregate(parts, begin, step)
    return F.when(end["shut"], F.array_join(F.slice(parts, 1, end["n"]), ""))


def answer_items(raw: Column) -> Column:
    """The items of an answer: text, type, linked_to; null where no list can be read.

    The list is the whole answer, or what stands in a fence, or what the first bracket
    opens; an object around it is allowed in the first two.  An empty list has no
    items, while a null, empty or cut answer is unreadable and never passes as empty.
    Items that aren't objects have nulls.
    """
    text = F.trim(raw)
    bare = F.try_parse_json(first_brackets(text))
    found = F.coalesce(_list(text), _list(F.nullif(F.regexp_extract(text, FENCE, 1), F.lit(""))), F.when(F.schema_of_variant(bare).startswith("ARRAY"), bare))
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    return F.transform(found.cast("array<variant>"), lambda v: F.struct(*(field(v, n) for n in ("text", "type", "linked_to")))).cast(ITEMS)


def halves(text: str) -> tuple[str, str] | None:
    """Two overlapping halves of a text whose answer had no room; None for a short one.

    All line ends and spaces are candidates.  The cut is the last line end within the
    middle half of the text, else the last space of its first half, else its middle.
    """
    size = len(text)
    if size < LEAST_SPLIT:
        return None
    breaks = [(m[0], m.start()) for m in re.finditer("[\n ]", text)]
    lines = [at for sign, at in breaks if sign == "\n" and size // 4 < at < size // 2 + size // 4]
    spaces = [at for sign, at in breaks if sign == " " and 0 < at < size // 2]
    cut = max(lines or spaces or [size // 2])
    return text[: cut + SPLIT_OVERLAP], text[max(0, cut - SPLIT_OVERLAP) :]
