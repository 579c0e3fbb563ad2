"""Detectors: each gives rows of doc_id, value, tag and an order of precedence."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.answers import ITEMS, answer_items, halves
from maskwright.functions.tags import NUMERIC_TAGS, TAGS, allowed_tags
from maskwright.functions.text import is_plain_amount, is_version, luhn, strip, without_placeholders

# The shapes of each tag, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_STREET = (
    "St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Ln|Lane|Rd|Road|Ct|Court|Way|"
    "Pl|Place|Cir|Circle|Pkwy|Parkway|Ter|Terrace|Trl|Trail|Loop|Hwy|Highway"
)
SHAPES = {
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "ID": r"\b\d{3}-\d{2}-\d{4}\b",
    "FINANCIAL": r"\b(?:\d{4}[- ]){3}\d{4}\b|\b\d{15,16}\b",
    "PHONE": r"(?:\+?1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b",
    "IP": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "ADDRESS": rf"\b\d{{1,6}}[ \t]+(?:[A-Z][A-Za-z']*[ \t]+){{0,4}}(?:{_STREET})\b\.?"
    r"(?:,?[ \t]*(?:Apt|Apartment|Suite|Ste|Unit|#)\.?[ \t]*[\w-]+)?"
    r"(?:,[ \t]*[A-Z][A-Za-z]+(?:[ \t][A-Z][A-Za-z]+)*,?[ \t]+[A-Z]{2}(?:[ \t]+\d{5}(?:-\d{4})?)?)?",
}
#: What must not stand right before a match.
BEFORE = {"PHONE": r"(?<![\w-])"}
# Looser shapes that a finished text is searched for.
RESIDUE = {
    "EMAIL": SHAPES["EMAIL"],
    "PHONE": SHAPES["PHONE"],
    "SSN": SHAPES["ID"],
    "IP": SHAPES["IP"],
    "CREDIT_CARD": r"\b(?:\d{4}[\s\-]){3}\d{4}\b|\b\d{15,16}\b",
}

#: Sources by precedence: the first that registers a value decides its tag.
SOURCES = ["model", "terms", "consensus", "patterns", "roster", "unions"]


def _hits(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("doc_id", "value", "tag", F.lit(SOURCES.index(source)).alias("source"), F.col("seq").cast("long").alias("seq"))


#: What a text must hold for a shape to be looked for at all.
RESIDUE_NEEDS = {"EMAIL": "@", "PHONE": r"\d{3}[-. ]\d{4}", "SSN": r"-\d{2}-", "IP": r"\d\.\d", "CREDIT_CARD": r"\d{4}"}
NEEDS = {"EMAIL": "@", "PHONE": r"\d{3}[-. ]\d{4}", "ID": r"-\d{2}-", "IP": r"\d\.\d", "FINANCIAL": r"\d{4}", "ADDRESS": rf"\d[ \t]"}


#: ``\\b`` between ASCII characters; Java 17's own one knows all scripts, with and without ``(?U)``.
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _pattern(shape: str, ascii_words: bool) -> str:
    """A shape for Java: digits, word characters and their edges of any script, or, as RE2 has them, of ASCII only."""
    if not ascii_words:
        return "(?U)" + shape
    return shape.replace(r"\b", _EDGE).replace(r"[\s", r"[ \t\n\f\r")


def _matches(tag: str, order: int = 0, ascii_words: bool = False) -> Column:
    """An array of value, tag, place and seq of one tag's shape in ``text``."""
    pattern = F.lit(_pattern(BEFORE.get(tag, "") + f"(?:{SHAPES[tag]})", ascii_words))
    raw = F.when(F.col("text").rlike(_pattern(NEEDS[tag], ascii_words)), F.regexp_extract_all("text", pattern, 0))
    value = lambda x: F.regexp_replace(strip(x), r"[.,]+\z", "")
    found = F.transform(raw, lambda x, i: F.struct(value(x).alias("value"), F.lit(tag).alias("tag"), i.alias("place"), (i.cast("long") + F.lit(order << 40)).alias("seq")))
    keep = lambda x: x["value"] != ""
    if tag == "FINANCIAL":
        keep = lambda x: luhn(x["value"])
    if tag == "IP":
        keep = lambda x: (x["value"] != "") & ~is_version(x["value"])
    return F.filter(found, keep)


def pattern_matches(docs: DataFrame, tag: str, ascii_words: bool = False) -> DataFrame:
    """Every match of one tag's shape, repeats included: doc_id, value, tag, place.

    A street name within a longer word is none: ``87 St`` isn't found in ``87 Stühle``.
    With ``ascii_words`` it is, as letters beyond ASCII then end a word.
    """
    return docs.select("doc_id", F.inline(_matches(tag, ascii_words=ascii_words))).drop("seq")


def _busy_lines(text: Column) -> Column:
    """The lines of a text with a digit or an ``@``, without which no shape matches; none goes beyond its line."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"(?U)[@\d]")), "\n")


def detect_patterns(docs: DataFrame, tags: Iterable[str] = TAGS, ascii_words: bool = False) -> DataFrame:
    """Matches of all allowed shapes, from one pass over the texts; only the selected ones are evaluated.

    ``ascii_words`` as for ``pattern_matches``.
    """
    order = [t for t in SHAPES if t in set(allowed_tags(tags))]
    if not order:
        return _hits(docs.select("doc_id", F.lit("").alias("value"), F.lit("").alias("tag"), F.lit(0).alias("seq")).limit(0), "patterns")
    found = [F.coalesce(_matches(tag, i, ascii_words), F.array()) for i, tag in enumerate(order)]
    return _hits(docs.select("doc_id", _busy_lines(F.col("text")).alias("text")).select("doc_id", F.inline(F.concat(*found))), "patterns")


def parse_terms(lines: DataFrame) -> DataFrame:
    """Custom terms from lines ``TAG: value`` or plain values (PERSON): value, tag, seq."""
    line = strip(F.col("line"))
    head = F.upper(F.regexp_extract(line, r"^([A-Za-z]+)\s*:\s*(.+)\z", 1))
    known = head.isin(TAGS)
    value = F.when(known, strip(F.regexp_extract(line, r"^([A-Za-z]+)\s*:\s*(.+)\z", 2))).otherwise(line)
    rows = lines.select(value.alias("value"), F.when(known, head).otherwise("PERSON").alias("tag"), "seq").filter("value <> ''")
    first = Window.partitionBy("value").orderBy("seq")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def detect_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that stand in a document, within other words and terms too."""
    from maskwright.operators.matcher import contained

    return _hits(contained(docs, terms), "terms")


def detect_consensus(cells: DataFrame, detected: DataFrame) -> DataFrame:
    """Values to add because most of their column has one tag.

    ``cells`` has doc_id, sheet, row, col, value; ``detected`` doc_id, value, tag.  A
    sheet needs three rows and a column three filled cells; the first filled cell is
    a header unless it is itself detected.  The winner needs two rows and half of the
    values; of equal ones the tag seen first wins.
    """
    sheets = cells.groupBy("doc_id", "sheet").agg(F.count_distinct("row").alias("rows")).filter("rows >= 3").select("doc_id", "sheet")
    filled = cells.withColumn("value", strip(F.col("value"))).filter("value <> ''").join(sheets, ["doc_id", "sheet"], "left_semi")
    tagged = filled.join(detected.select("doc_id", "value", "tag"), ["doc_id", "value"], "left")
    column = ["doc_id", "sheet", "col"]
    per = tagged.groupBy(*column).agg(F.count("*").alias("n"), F.min(F.struct("row", "tag")).alias("head")).filter("n >= 3")
    per = per.select(*column, F.when(F.col("head.tag").isNull(), F.col("head.row")).otherwise(-1).alias("header"))
    values = tagged.join(per, column).filter("row > header")
    size = values.groupBy(*column).agg(F.count("*").alias("size"))
    votes = values.filter("tag is not null").groupBy(*column, "tag").agg(F.count("*").alias("hits"), F.min("row").alias("seen"))
    best = Window.partitionBy(*column).orderBy(F.desc("hits"), "seen", "tag")
    winner = votes.withColumn("k", F.row_number().over(best)).filter("k = 1").join(size, column).filter("hits >= 2 and hits * 2 >= size")
    added = values.filter("tag is null").drop("tag").join(winner.select(*column, "tag"), column)
    added = added.filter((F.length("value") <= 120) & (F.col("tag").isin(NUMERIC_TAGS) | ~is_plain_amount(F.col("value"))))
    place = F.col("sheet").cast("long") * (1 << 40) + F.col("col").cast("long") * (1 << 24) + F.col("row")
    return _hits(added.select("doc_id", "value", "tag", place.alias("seq")), "consensus")


class Truncated(Exception):
    """Raised by a model whose answer had no room."""


def _scan(text: str, model: Callable[[str], list[dict] | None], attempts: int, wait: float) -> list[dict] | None:
    """The items of a text, of its halves where an answer had no room; None if a part can't be read."""
    found, left = [], [text]
    while left:
        part = left.pop(0)
        items = None
        for k in range(attempts):
            try:
                items = model(part)
            except Truncated:
                if (both := halves(part)) is None:
                    return None
                left[:0] = both
                items = []
            if items is not None:
                break
            if k + 1 < attempts:
                time.sleep(wait * (k + 1))
        if items is None:
            return None
        found += items
    return found


def detect_model(chunks: DataFrame, model: Callable[[str], list[dict] | None], tags: Iterable[str] = TAGS, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Items that a pluggable model finds in each chunk (doc_id, chunk_no, text).

    ``model`` returns the items of a text, or None for an unreadable answer, which is
    asked again after ``wait`` seconds, then twice as many, and then fails the job: a
    chunk that can't be scanned never passes as clean.  If it raises ``Truncated``, the
    text is asked in halves.  Items of other than the allowed tags are left out; plain
    amounts too.
    """
    allowed = allowed_tags(tags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, no, text in zip(b["doc_id"], b["chunk_no"], b["text"], strict=True):
                items = _scan(text, model, attempts, wait)
                if items is None:
                    raise RuntimeError(f"chunk {no} can't be scanned")
                rows += [(doc_id, no, k, str(i.get("text", "")).strip(), str(i.get("type", "")).upper(), i.get("linked_to")) for k, i in enumerate(items)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "k", "value", "tag", "linked_to"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    found = chunks.select("doc_id", "chunk_no", "text").mapInPandas(run, f"doc_id {kind}, chunk_no int, k int, value string, tag string, linked_to string")
    return _model_hits(found, allowed)


def _model_hits(found: DataFrame, allowed: list[str]) -> DataFrame:
    keep = F.col("tag").isin(allowed) & (F.col("value") != "") & (F.col("tag").isin(NUMERIC_TAGS) | ~is_plain_amount(F.col("value")))
    return found.filter(keep).select("doc_id", "value", "tag", F.lit(0).alias("source"), (F.col("chunk_no").cast("long") * (1 << 20) + F.col("k")).alias("seq"), "linked_to")


def detect_answers(answers: DataFrame, tags: Iterable[str] = TAGS) -> DataFrame:
    """As ``detect_model``, from a table of raw answers (doc_id, chunk_no, answer); an unreadable one fails the job."""
    items = F.coalesce(answer_items(F.col("answer")), F.raise_error(F.concat(F.lit("chunk "), F.col("chunk_no").cast("string"), F.lit(" can't be scanned"))).cast(ITEMS))
    each = answers.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.posexplode(items).alias("k", "item"))
    found = each.select("doc_id", "chunk_no", "k", strip(F.coalesce("item.text", F.lit(""))).alias("value"), F.upper("item.type").alias("tag"), F.col("item.linked_to").alias("linked_to"))
    return _model_hits(found, allowed_tags(tags))


def skipped_amounts(items: DataFrame) -> DataFrame:
    """The distinct plain amounts among tagged items (doc_id, value, tag), kept as they are."""
    return items.filter(~F.col("tag").isin(NUMERIC_TAGS) & is_plain_amount(F.col("value"))).select("doc_id", "value").distinct()


def residue(docs: DataFrame, ascii_words: bool = False) -> DataFrame:
    """The labels of shapes left in finished texts: a warning, not a failure.  doc_id, labels.

    ``ascii_words`` as for ``pattern_matches``.
    """
    docs, text = docs.select("doc_id", without_placeholders(F.col("text")).alias("_bare")), F.col("_bare")
    flags = []
    for label, shape in RESIDUE.items():
        found = F.regexp_extract_all(text, F.lit(_pattern(f"(?:{shape})", ascii_words)), 0)
        if label == "IP":
            hit = F.exists(found, lambda x: ~is_version(x))
        elif label == "CREDIT_CARD":
            hit = F.exists(found, lambda x: luhn(x))
        else:
            hit = F.size(found) > 0
        flags.append(F.when(text.rlike(_pattern(RESIDUE_NEEDS[label], ascii_words)), F.when(hit, F.lit(label))))
    return docs.select("doc_id", F.array_sort(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("labels"))


def overlap_unions(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Stretches where detected values overlap without nesting, as values of their own.

    ``hits`` has doc_id, value, tag.  At each start the longest value counts, short
    numbers don't; values that only touch stay apart.  A stretch across a tab or line
    end, or that is a value already, is left out.  Its tag is its longest member's.
    """
    from maskwright.functions.text import is_short_number
    from maskwright.operators.matcher import document_occurrences

    found = document_occurrences(docs, hits.filter(~is_short_number(F.col("value"))))
    longest = found.groupBy("doc_id", "start").agg(F.max(F.struct("end", "value", "tag")).alias("m")).select("doc_id", "start", "m.*")
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    cut = longest.withColumn("cut", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    islands = cut.withColumn("island", F.sum("cut").over(upto)).groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members"),
        F.max(F.struct(F.length("value").alias("n"), (-F.col("start")).alias("s"), "tag"))["tag"].alias("tag"),
    ).filter("members > 1")
    text = islands.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.expr("substring(text, start + 1, end - start)").alias("value"), "tag", F.col("start").alias("seq"))
    text = text.filter(~F.col("value").rlike("[\t\n]")).join(hits.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti")
    first = Window.partitionBy("doc_id", "value").orderBy("seq")
    return _hits(text.withColumn("k", F.row_number().over(first)).filter("k = 1"), "unions")


def union_hits(parts: Sequence[DataFrame]) -> DataFrame:
    """All detectors' hits; ``linked_to`` only comes from the model."""
    out = None
    for p in parts:
        p = p if "linked_to" in p.columns else p.withColumn("linked_to", F.lit(None).cast("string"))
        out = p if out is None else out.unionByName(p)
    return out
