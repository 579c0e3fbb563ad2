"""Restoring placeholders to originals from key tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.tags import TAGS


class KeyConflict(ValueError):
    """Two keys give one identifier different values."""


# The forms in which the identifier of a value may come back: in brackets, with a tag, bare.
VALUE_FORMS = (
    r"(?P<boxed>\\?\[[ \t]*(?P<boxed_tag>[A-Za-z][A-Za-z_]{1,30})\\?_(?P<boxed_hex>[0-9A-Fa-f]{4,16})[ \t]*\\?\])"
    r"|(?<![0-9A-Za-z])(?P<named>(?P<named_tag>[A-Za-z][A-Za-z_]{1,30})\\?_(?P<named_hex>[0-9A-Fa-f]{4,16}))(?![0-9A-Fa-f])"
    r"|(?<![0-9A-Za-z])(?P<bare_hex>[0-9A-Fa-f]{12})(?![0-9A-Za-z])"
)
# The same of an identity.
IDENTITY_FORMS = (
    r"(?P<box>\\?\[[ \t]*(?:[A-Za-z][A-Za-z]{1,30}\\?_)?(?P<box_letter>[IiFf])(?P<box_hex>[0-9A-Fa-f]{16}|[0-9A-Fa-f]{8})[ \t]*\\?\])"
    r"|(?<![0-9A-Za-z])(?P<id>(?:[A-Za-z][A-Za-z]{1,30}\\?_)?(?P<id_letter>[IiFf])(?P<id_hex>[0-9A-Fa-f]{16}))(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<id_bare>[0-9A-Fa-f]{16})(?![0-9A-Za-z])"
)


def key_entries(keys: DataFrame) -> DataFrame:
    """One row per identifier of the keys: key_no, name, kind (hex, legacy, sheet), tag, hex, original."""
    each = keys.select("key_no", "session_id", F.explode("replacement_map").alias("original", "token")).filter("original <> ''")
    part = lambda g: F.regexp_extract("token", r"^\[([A-Z]+)_([0-9A-F]+)\]$", g)
    rows = each.select("key_no", "session_id", part(1).alias("tag"), part(2).alias("hex"), "original")
    rows = rows.withColumn("kind", F.when(F.length("hex") == 12, "hex").when(F.length("hex") == 4, "legacy")).filter("kind is not null")
    if "sheet_titles" in keys.columns:
        titles = keys.select("key_no", "session_id", F.explode("sheet_titles").alias("token", "original"))
        hexes = F.regexp_extract("token", r"^SHEET_([0-9A-F]{12})$", 1)
        rows = rows.unionByName(titles.select("key_no", "session_id", F.lit("SHEET").alias("tag"), hexes.alias("hex"), "original").filter("hex <> ''").withColumn("kind", F.lit("hex")))
    return rows


def key_conflicts(keys: DataFrame) -> DataFrame:
    """Identifiers that two keys give different values: kind, tag, hex."""
    e = key_entries(keys)
    whole = e.filter("kind = 'hex'").groupBy("hex").agg(F.count_distinct("original").alias("n")).filter("n > 1").select(F.lit("hex").alias("kind"), F.lit("").alias("tag"), "hex")
    # within one key an old short id may be shared; the longest original has it
    old = e.filter("kind = 'legacy'").groupBy("tag", "hex", "key_no").agg(F.max_by("original", F.length("original")).alias("original"))
    old = old.groupBy("tag", "hex").agg(F.count_distinct("original").alias("n")).filter("n > 1").select(F.lit("legacy").alias("kind"), "tag", "hex")
    return whole.unionByName(old)


def build_index(keys: DataFrame) -> DataFrame:
    """The merged lookup: kind (hex, legacy, identity), tag, hex, original.

    A conflict refuses the whole merge.  Of an identity's spellings the newest key's
    wins, an empty one never over a real one.
    """
    if (clash := key_conflicts(keys)).take(1):
        raise KeyConflict(f"{clash.count()} identifiers have different values in the selected keys")
    e = key_entries(keys)
    first = Window.partitionBy("kind", "hex", F.when(F.col("kind") == "legacy", F.col("tag"))).orderBy(F.desc(F.length("original")), "key_no", "original")
    out = e.withColumn("k", F.row_number().over(first)).filter("k = 1").select("kind", "tag", "hex", "original")
    if "identity_registry" in keys.columns:
        ids = keys.select("key_no", "created_at", F.explode("identity_registry").alias("cid", "rec"))
        hexes = F.upper(F.regexp_extract("cid", r"^([IF])([0-9A-F]{16}|[0-9A-F]{8})$", 2))
        ids = ids.select("key_no", "created_at", F.when(F.col("cid").startswith("I"), "INDIVIDUAL").otherwise("FAMILY").alias("tag"), hexes.alias("hex"), F.trim(F.coalesce("rec.display", F.lit(""))).alias("original")).filter("hex <> ''")
        newest = Window.partitionBy("hex").orderBy(F.desc(F.col("original") != ""), F.desc("created_at"), F.desc("key_no"))
        out = out.unionByName(ids.withColumn("k", F.row_number().over(newest)).filter("k = 1").select(F.lit("identity").alias("kind"), "tag", "hex", "original"))
    return out


def ambiguity(keys: DataFrame) -> DataFrame:
    """legacy_ambiguous and community_variants: ids with several originals, or spellings, and no conflict."""
    old = key_entries(keys).filter("kind = 'legacy'").groupBy("tag", "hex", "key_no").agg((F.count_distinct("original") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("legacy_ambiguous"))
    if "identity_registry" not in keys.columns:
        return old.withColumn("community_variants", F.lit(0).cast("long"))
    ids = keys.select(F.explode("identity_registry").alias("cid", "rec")).filter("trim(rec.display) <> ''")
    spelled = ids.groupBy("cid").agg((F.count_distinct(F.trim("rec.display")) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("community_variants"))
    return old.crossJoin(spelled)  # one row each


TOKENS = "start int, end int, token string, form string, tag string, hex string"


def tokens(docs: DataFrame, identities: bool = False) -> DataFrame:
    """Every token of the grammar: doc_id, start, end, token, form, tag, hex.

    The identity forms only count where a key has identities.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    grammar = (IDENTITY_FORMS + "|" if identities else "") + VALUE_FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(grammar)
        names = ["doc_id", *(x.split()[0] for x in TOKENS.split(", "))]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for m in pattern.finditer(text or ""):
                    g = {k: v for k, v in m.groupdict().items() if v is not None}
                    form = m.lastgroup
                    if "boxed" in g or "named" in g:
                        form = "boxed" if "boxed" in g else "named"
                        tag, hex_ = g[f"{form}_tag"], g[f"{form}_hex"]
                    elif "box" in g or "id" in g:
                        form = "box" if "box" in g else "id"
                        tag, hex_ = g[f"{form}_letter"], g[f"{form}_hex"]
                    else:
                        form = "id_bare" if "id_bare" in g else "bare"
                        tag, hex_ = "", g.get("id_bare") or g["bare_hex"]
                    rows.append((doc_id, m.start(), m.end(), m[0], form, tag.upper(), hex_.upper()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {TOKENS}")


def resolve(found: DataFrame, index: DataFrame, identities: bool = False) -> DataFrame:
    """Tokens with their original (null if none), the key's tag, and relabeled, untagged, report.

    Twelve digits resolve alone, four only with their own tag, identities by sixteen or
    eight.  What clearly was meant as an identifier and isn't known is to be reported.
    """
    lookup = lambda kind, x: index.filter(F.col("kind") == kind).select(F.col("hex").alias("hex"), F.col("tag").alias(f"{x}_tag"), F.col("original").alias(f"{x}_original"))
    rows = found.join(lookup("hex", "h"), "hex", "left")
    old = index.filter("kind = 'legacy'").select("hex", F.col("tag"), F.col("original").alias("l_original"))
    rows = rows.join(old, ["hex", "tag"], "left").join(lookup("identity", "i"), "hex", "left")
    size, form = F.length("hex"), F.col("form")
    identity_form = form.isin("box", "id", "id_bare")
    by_identity = (identity_form | (form.isin("boxed", "named") & size.isin(16, 8))) & F.col("i_tag").isNotNull() if identities else F.lit(False)
    by_hex = ~identity_form & (size == 12) & F.col("h_original").isNotNull()
    by_old = form.isin("boxed", "named") & (size == 4) & F.col("l_original").isNotNull()
    original = F.when(by_identity, F.when(F.col("i_original") != "", F.col("i_original"))).when(by_hex, F.col("h_original")).when(by_old, F.col("l_original"))
    known = F.col("tag").isin(TAGS)
    report = (
        F.when(by_identity, True).when(form.isin("bare", "id_bare"), False).when(identity_form, True).when(size == 12, True)
        .when(size == 4, (form == "boxed") & known).otherwise((known & ((form == "boxed") | (size >= 8))) | (F.lit(identities) & (size == 16)))
    )
    key_tag = F.when(by_identity, F.col("i_tag")).when(by_hex, F.col("h_tag")).when(by_old, F.col("tag"))
    letter = F.when(form.isin("box", "id"), F.substring("i_tag", 1, 1) != F.when(F.col("tag") == "I", "I").otherwise("F"))
    relabeled = F.when(by_identity, F.coalesce(letter, form != "id_bare")).when(by_hex & (form != "bare"), F.col("h_tag") != F.col("tag")).otherwise(False)
    out = rows.withColumns({"original": original, "key_tag": key_tag, "relabeled": relabeled, "untagged": form.isin("bare", "id_bare")})
    out = out.withColumn("report", F.col("original").isNull() & report)
    hit = F.col("original").isNotNull()
    return out.select("doc_id", "start", "end", "token", "original", F.when(hit, F.col("key_tag")).alias("key_tag"), (hit & F.col("relabeled")).alias("relabeled"), (hit & F.col("untagged")).alias("untagged"), "report")


def apply_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans (doc_id, start, end, original) of each text replaced in one pass."""
    own = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "original"))).alias("spans"))
    rows = docs.join(own, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,original:string>>)")))
    # what stands between the span before (or the start) and each span, then its original
    piece = F.expr("transform(spans, (s, i) -> concat(substring(text, if(i = 0, 0, coalesce(get(spans, i - 1).end, 0)) + 1, s.start - if(i = 0, 0, coalesce(get(spans, i - 1).end, 0))), s.original))")
    rest = F.expr("if(size(spans) = 0, text, substring(text, get(spans, size(spans) - 1).end + 1))")
    return rows.withColumn("text", F.concat(F.array_join(piece, ""), rest)).select(docs.columns)


def restore(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The restored documents, and the resolved tokens that the report is counted from."""
    identities = bool(index.filter("kind = 'identity'").take(1))
    found = resolve(tokens(docs, identities), index, identities)
    return apply_spans(docs, found.filter("original is not null").select("doc_id", "start", "end", "original")), found


def _inside_runs(docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """Known ids (hex) of ``width`` digits at any place of a longer run: doc_id, run, start, token."""
    pattern = f"[0-9A-Fa-f]{{{width},}}"
    cut = docs.filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract_all("text", F.lit(pattern), 0).alias("runs"), F.split("text", pattern, -1).alias("gaps"))
    # each run begins behind the gaps and runs before it
    step = lambda at, i: F.struct((at["next"] + F.length(F.element_at("gaps", i + 1))).alias("at"), (at["next"] + F.length(F.element_at("gaps", i + 1)) + F.length(F.element_at("runs", i + 1))).alias("next"))
    places = F.aggregate(F.sequence(F.lit(0), F.size("runs") - 1), F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("all")), lambda acc, i: F.struct(step(acc, i)["next"].alias("next"), F.concat(acc["all"], F.array(step(acc, i)["at"])).alias("all")), lambda acc: acc["all"])
    each = cut.select("doc_id", F.inline(F.arrays_zip(places.alias("at"), F.col("runs").alias("run"))))
    each = each.select("doc_id", "at", "run", F.explode(F.sequence(F.lit(0), F.length("run") - width)).alias("i"))
    rows = each.select("doc_id", F.col("at").alias("run"), (F.col("at") + F.col("i")).alias("start"), F.substring("run", F.col("i") + 1, F.lit(width)).alias("token"))
    return rows.join(known.select("hex"), F.upper("token") == F.col("hex"), "left_semi")


def _uncovered(rows: DataFrame, over: DataFrame, width: int) -> DataFrame:
    """The ids that begin in no span of ``over`` (d, a, b); of a run's overlapping ones the first, and so on."""
    free = rows.join(over, (F.col("doc_id") == F.col("d")) & (F.col("start") >= F.col("a")) & (F.col("start") < F.col("b")), "left_anti")
    per = free.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("start", "token"))).alias("all"))
    chosen = F.expr(f"aggregate(all, cast(array() as array<struct<start:int,token:string>>), (kept, x) -> if(size(kept) = 0 or x.start >= element_at(kept, -1).start + {width}, concat(kept, array(x)), kept))")
    return per.select("doc_id", F.inline(chosen))


def glued(docs: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """Known ids inside longer runs of digits that no token covers: doc_id, start, token.

    Ids of twelve digits first, then those of identities, sixteen, where none of the
    former covers them.
    """
    over = found.filter("original is not null or report").select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"))
    short = _uncovered(_inside_runs(docs, index.filter("kind = 'hex'"), 12), over, 12)
    taken = over.unionByName(short.select(F.col("doc_id").alias("d"), F.col("start").alias("a"), (F.col("start") + 12).alias("b")))
    return short.unionByName(_uncovered(_inside_runs(docs, index.filter("kind = 'identity' and length(hex) = 16"), 16), taken, 16))


def with_glued(docs: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` with glued ids as unresolved tokens, for ``restore_report``."""
    rows = glued(docs, found, index)
    no = F.lit(False)
    return found.unionByName(rows.withColumns({"end": F.col("start") + F.length("token"), "relabeled": no, "untagged": no, "report": F.lit(True)}), allowMissingColumns=True)


def restore_report(found: DataFrame) -> DataFrame:
    """doc_id, restored, relabeled, untagged, unresolved (distinct, in order seen), unresolved_count."""
    hit = F.col("original").isNotNull()
    seen = found.filter("report").groupBy("doc_id", "token").agg(F.min("start").alias("at")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("unresolved"))
    per = found.groupBy("doc_id").agg(F.count_if(hit).alias("restored"), F.count_if("relabeled").alias("relabeled"), F.count_if("untagged").alias("untagged"), F.count_if("report").alias("unresolved_count"))
    return per.join(seen, "doc_id", "left").withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))


def restored_by_tag(found: DataFrame) -> DataFrame:
    return found.filter("original is not null").groupBy("key_tag").agg(F.count("*").alias("n")).orderBy("key_tag")


def residual(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The number of restorable tokens still in written outputs."""
    _, found = restore(docs, index)
    return found.agg(F.count("original").alias("residual"))
