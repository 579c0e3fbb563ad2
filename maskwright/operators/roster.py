"""Identities of a roster: what an outside matching step planned, and what follows from it.

The matching itself is a table in, table out step that a caller plugs in; here its
plan is flattened, decisions are checked, and cells are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import canonical_hash, strip
from maskwright.operators.matcher import document_occurrences
from maskwright.sources.scratch import written

CANDIDATE = "struct<community_id:string,sheet_ref:string,given_name:string,family_name:string,display_name:string,confidence:double>"
PERSON = (
    "struct<key:string,slot:int,role:string,given_name:string,family_name:string,date_of_birth:string,"
    "name_cells:array<struct<col:int,part:string>>,action:string,code_state:string,community_id:string,same_as:string,"
    f"told_apart:int,review_reasons:array<string>,matched:{CANDIDATE},candidates:array<{CANDIDATE}>>"
)
FAMILY = f"struct<key:string,display_name:string,cell:struct<col:int>,action:string,code_state:string,community_id:string,same_as:string,review_reasons:array<string>,candidates:array<{CANDIDATE}>>"
PLAN = f"struct<sheets:array<struct<index:int,rows:array<struct<index:int,skipped:boolean,persons:array<{PERSON}>,family:{FAMILY}>>>>,pending:array<string>,stale_decisions:array<string>>"
# Limits of one roster file, and words that mark its header.
MOST_ROWS, MOST_SHEETS, MOST_COLUMNS, MOST_CHARS, HEADER_ROWS = 20_000, 25, 300, 4_000, 25
HEADER_WORD = (
    r"(?i)\b(name|first|last|given|surname|student|child|children|parent|guardian|"
    r"family|household|head|spouse|email|e-mail|phone|mobile|cell|address|grade)\b"
)
LIST_HEADER = r"(?i)^(?:(?:student|child|member|parishioner|person|parent|guardian)(?:'s)?\s+)?(?:full\s+|legal\s+)?names?$"


def roster_sheets(cells: DataFrame) -> DataFrame:
    """The sheets that can hold a roster: doc_id, sheet, place, header_row, last_row, width, one_column.

    A header is the first row of two filled cells with a header word, else the first
    of two filled cells; a list of one column needs a cell that names people.  ``place``
    numbers a document's roster sheets without gaps, as a plan lists them, while
    ``sheet`` is the number in the workbook.  Of more than MOST_SHEETS, those without a
    header word go.
    """
    filled = cells.filter((F.col("row") < HEADER_ROWS) & (strip(F.col("value")) != ""))
    rows = filled.groupBy("doc_id", "sheet", "row").agg(F.count("*").alias("n"), F.bool_or(F.col("value").rlike(HEADER_WORD)).alias("word"), F.bool_or(strip(F.col("value")).rlike(LIST_HEADER)).alias("names"))
    first = lambda where: F.min(F.when(where, F.struct("row", "word")))
    heads = rows.groupBy("doc_id", "sheet").agg(first((F.col("n") >= 2) & F.col("word")).alias("worded"), first(F.col("n") >= 2).alias("wide"), first((F.col("n") == 1) & F.col("names")).alias("single"))
    extent = cells.groupBy("doc_id", "sheet").agg((F.max("col") + 1).alias("width"), F.max("row").alias("last_row"))
    found = heads.withColumn("h", F.coalesce("worded", "wide", "single")).filter("h is not null")
    found = found.withColumn("many", F.count("*").over(Window.partitionBy("doc_id")) > MOST_SHEETS).filter("h.word or not many")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet")) - 1)
    found = found.select("doc_id", "sheet", "place", F.col("h.row").alias("header_row"), F.coalesce("worded", "wide").isNull().alias("one_column"))
    return found.join(extent, ["doc_id", "sheet"]).select("doc_id", "sheet", "place", "header_row", "last_row", "width", "one_column")


def over_limits(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Documents beyond a roster's limits and why: doc_id, reason.  Blank rows count, cells above a header don't."""
    rows = sheets.groupBy("doc_id").agg(F.sum(F.col("last_row") - F.col("header_row")).alias("n")).filter(F.col("n") > MOST_ROWS).select("doc_id", F.lit("rows").alias("reason"))
    many = sheets.groupBy("doc_id").count().filter(F.col("count") > MOST_SHEETS).select("doc_id", F.lit("sheets").alias("reason"))
    wide = sheets.filter(F.col("width") > MOST_COLUMNS).select("doc_id", F.lit("columns").alias("reason"))
    body = cells.filter(F.length("value") > MOST_CHARS).join(sheets.select("doc_id", "sheet", "header_row"), ["doc_id", "sheet"])
    long = body.filter("row >= header_row").select("doc_id", F.lit("cell").alias("reason"))
    return rows.unionByName(many).unionByName(wide).unionByName(long).distinct()


def roster_rows(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """The padded rows below each header, blank ones too: doc_id, sheet, row, cells."""
    every = sheets.filter("last_row > header_row").select("doc_id", "sheet", "width", F.explode(F.sequence(F.col("header_row") + 1, "last_row")).alias("row"))
    own = cells.groupBy("doc_id", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("m"))
    return every.join(own, ["doc_id", "sheet", "row"], "left").select("doc_id", "sheet", "row", F.expr("transform(sequence(0, width - 1), c -> coalesce(m[c], ''))").alias("cells"))


def parse_plan(plans: DataFrame) -> DataFrame:
    """doc_id and the nested ``plan`` from its JSON text (column ``json``)."""
    return plans.select("doc_id", F.from_json("json", PLAN).alias("plan"))


def plan_rows(plans: DataFrame) -> DataFrame:
    """doc_id, the place of the sheet among the roster sheets, and each row that isn't skipped."""
    sheets = plans.select("doc_id", F.posexplode("plan.sheets").alias("place", "s"))
    return sheets.select("doc_id", "place", F.explode("s.rows").alias("r")).filter("not coalesce(r.skipped, false)")


def persons(plans: DataFrame) -> DataFrame:
    return plan_rows(plans).select("doc_id", "place", F.col("r.index").alias("index"), F.col("r.family.community_id").alias("family_id"), F.explode("r.persons").alias("p"))


def _full_name(x: str):
    return F.concat_ws(" ", *(F.when(F.col(f"{x}.{c}") != "", F.col(f"{x}.{c}")) for c in ("given_name", "family_name")))


def plan_items(plans: DataFrame, sheets: DataFrame, committed: bool = False) -> DataFrame:
    """Each person and household of a plan: doc_id, key, kind, sheet, sheet_row, label, action, candidates, reasons.

    Before the commit a list of one column sends everybody to review.
    """
    meta = sheets.select("doc_id", "place", "sheet", "header_row", "one_column")
    people = persons(plans).join(meta, ["doc_id", "place"])
    ask = F.lit(not committed) & F.col("one_column") & F.col("p.action").isin("new", "matched")
    none, reasons = F.expr(f"cast(array() as array<{CANDIDATE}>)"), F.array().cast("array<string>")
    offered = F.coalesce("p.candidates", none)
    people = people.select(
        "doc_id", F.col("p.key").alias("key"), F.lit("person").alias("kind"), "sheet", (F.col("header_row") + F.col("index") + 2).alias("sheet_row"),
        F.coalesce(F.nullif(_full_name("p"), F.lit("")), F.lit("(no name)")).alias("label"), F.when(ask, "review").otherwise(F.col("p.action")).alias("action"),
        F.when(ask & F.col("p.matched").isNotNull(), F.concat(offered, F.array("p.matched"))).otherwise(offered).alias("candidates"),
        F.when(ask, F.concat(F.coalesce("p.review_reasons", reasons), F.array(F.lit("one_column_list")))).otherwise(F.coalesce("p.review_reasons", reasons)).alias("reasons"),
    )
    homes = plan_rows(plans).filter("r.family is not null").join(meta, ["doc_id", "place"])
    homes = homes.select(
        "doc_id", F.col("r.family.key").alias("key"), F.lit("family").alias("kind"), "sheet", (F.col("header_row") + F.col("r.index") + 2).alias("sheet_row"),
        F.coalesce(F.nullif("r.family.display_name", F.lit("")), F.lit("(household)")).alias("label"), F.col("r.family.action").alias("action"),
        F.coalesce("r.family.candidates", none).alias("candidates"), F.coalesce("r.family.review_reasons", reasons).alias("reasons"),
    )
    return people.unionByName(homes)


def normal_target(target, kind: str):
    """An attach target as ``I``/``F`` and hex digits in upper case, or a row reference; else null."""
    letter, last = ("I", r"\d+") if kind == "person" else ("F", "family")
    t = F.trim(target)
    return F.when(F.upper(t).rlike(rf"^{letter}(?:[0-9A-F]{{16}}|[0-9A-F]{{8}})\z"), F.upper(t)).when(t.rlike(rf"^\d+:\d+:{last}\z"), t)


def valid_decisions(decisions: DataFrame, items: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Decisions (doc_id, key, action, target) that still fit the plan; the rest are dropped.

    People are attached, created or skipped, households attached or created; a target
    must be one of the offered candidates.  ``stale`` (doc_id, key) were overtaken.
    """
    rows = decisions.join(items.select("doc_id", "key", "kind", "candidates"), ["doc_id", "key"])
    if stale is not None:
        rows = rows.join(stale.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    target = F.when(F.col("kind") == "person", normal_target(F.col("target"), "person")).otherwise(normal_target(F.col("target"), "family"))
    offered = F.concat(F.transform("candidates", lambda c: F.upper(F.coalesce(c["community_id"], F.lit("")))), F.transform("candidates", lambda c: F.coalesce(c["sheet_ref"], F.lit(""))))
    fits = F.when(F.col("action") == "attach", target.isNotNull() & F.array_contains(offered, target)).when(F.col("action") == "skip", F.col("kind") == "person").otherwise(F.col("action") == "create")
    return rows.withColumn("t", target).filter(fits).select("doc_id", "key", "action", F.when(F.col("action") == "attach", F.col("t")).alias("target"))


def decide(decisions: DataFrame, changes: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Decisions (doc_id, key, action, target) after ``changes``: a new one replaces that of its key, ``undo`` takes it back.

    Changes of ``frozen`` documents (doc_id), whose commit has no known outcome, are refused.
    """
    if frozen is not None:
        changes = changes.join(frozen.select("doc_id").distinct(), "doc_id", "left_anti")
    return overlay(decisions, changes).filter("action <> 'undo'")


def overlay(decisions: DataFrame, kept: DataFrame) -> DataFrame:
    """Decisions with those of kept names over them."""
    return decisions.join(kept.select("doc_id", "key"), ["doc_id", "key"], "left_anti").unionByName(kept)


def pending(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items to review that nobody has decided."""
    return items.filter("action = 'review'").join(decisions.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def name_cell(x: str):
    """The cell that names a person: full before list before given."""
    of = lambda part: F.get(F.filter(f"{x}.name_cells", lambda c: (c["part"] == part) & c["col"].isNotNull()), F.lit(0))
    return F.coalesce(of("full"), of("list"), of("given"))


def _with_row(df: DataFrame, sheets: DataFrame, index) -> DataFrame:
    """``df`` with the workbook's sheet and row numbers."""
    return df.join(sheets.select("doc_id", "place", "sheet", "header_row", "width"), ["doc_id", "place"]).withColumn("row", F.col("header_row") + 1 + index)


def kept_names(plans: DataFrame, sheets: DataFrame, cells: DataFrame, deselected: DataFrame) -> DataFrame:
    """Skip decisions for people whose name cell or full name is a kept value (doc_id, original)."""
    people = _with_row(persons(plans).withColumn("c", name_cell("p")), sheets, F.col("index")).withColumn("col", F.col("c.col"))
    people = people.join(cells.select("doc_id", "sheet", "row", "col", "value"), ["doc_id", "sheet", "row", "col"], "left")
    each = people.select("doc_id", F.col("p.key").alias("key"), F.explode(F.array(strip(F.coalesce("value", F.lit(""))), strip(_full_name("p")))).alias("name")).filter("name <> ''")
    kept = deselected.select("doc_id", strip(F.col("original")).alias("name"))
    return each.join(kept, ["doc_id", "name"], "left_semi").select("doc_id", "key").distinct().select("doc_id", "key", F.lit("skip").alias("action"), F.lit(None).cast("string").alias("target"))


def certain_names(plans: DataFrame, sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """Names to register whatever the detectors found: doc_id, value, tag, source, seq.

    Surname and household cells; full names of two words that stand in any cell; parts
    of names that stand as whole words outside the cells that hold names.
    """
    people = _with_row(persons(plans), sheets, F.col("index"))
    parts = people.select("doc_id", "sheet", "row", F.explode("p.name_cells").alias("c")).filter("c.part = 'family'").select("doc_id", "sheet", "row", F.col("c.col").alias("col"))
    homes = _with_row(plan_rows(plans).filter("r.family.cell.col is not null"), sheets, F.col("r.index")).select("doc_id", "sheet", "row", F.col("r.family.cell.col").alias("col"))
    in_cells = parts.unionByName(homes).join(cells, ["doc_id", "sheet", "row", "col"]).select("doc_id", F.col("value").alias("v"))
    named = people.withColumn("c", name_cell("p")).filter("c is not null").select("doc_id", "sheet", "row", F.col("c.col").alias("col")).unionByName(homes).distinct()
    # each document's text travels once for all its full names, and once, without the cells that hold names, for their parts
    text = lambda rows: rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("text"))
    looked = lambda texts, names, whole: document_occurrences(texts, names.select("doc_id", F.col("v").alias("value"), F.lit("PERSON").alias("tag")), whole).select("doc_id", F.col("value").alias("v")).distinct()
    full = looked(text(cells), people.select("doc_id", _full_name("p").alias("v")).filter("v like '% %'").distinct(), False)
    each = people.select("doc_id", F.explode(F.array("p.given_name", "p.family_name")).alias("v")).select("doc_id", strip(F.col("v")).alias("v")).filter("v <> ''").distinct()
    words = looked(text(cells.join(named, ["doc_id", "sheet", "row", "col"], "left_anti")), each, True)
    found = in_cells.unionByName(full).unionByName(words).select("doc_id", strip(F.col("v")).alias("value")).distinct()
    return found.filter((F.length("value") >= 2) & F.col("value").rlike(r"\p{L}")).select("doc_id", "value", F.lit("PERSON").alias("tag"), F.lit(4).alias("source"), F.lit(0).cast("long").alias("seq"))


def plan_totals(plans: DataFrame, sheets: DataFrame) -> DataFrame:
    """Roster sheets, rows sent and people planned of each document: doc_id, sheets, rows, people."""
    sent = sheets.groupBy("doc_id").agg(F.count("*").alias("sheets"), F.sum(F.greatest(F.col("last_row") - F.col("header_row"), F.lit(0))).alias("rows"))
    people = plan_rows(plans).groupBy("doc_id").agg(F.sum(F.greatest(F.size("r.persons"), F.lit(0))).alias("people"))
    return sent.join(people, "doc_id", "left").select("doc_id", "sheets", "rows", F.coalesce("people", F.lit(0)).alias("people"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """known and new people and households of committed results, and skipped rows: doc_id, kind, known, new, skipped.

    An id both new and known counts as new.
    """
    people = persons(results).select("doc_id", F.lit("people").alias("kind"), F.when(F.col("p.action") != "skip", F.col("p.community_id")).alias("id"), (F.col("p.code_state") == "new").alias("fresh"))
    homes = plan_rows(results).filter("r.family.community_id is not null").select("doc_id", F.lit("households").alias("kind"), F.col("r.family.community_id").alias("id"), (F.col("r.family.code_state") == "new").alias("fresh"))
    per = people.unionByName(homes).groupBy("doc_id", "kind", "id").agg(F.count("*").alias("n"), F.max(F.coalesce("fresh", F.lit(False))).alias("fresh"))
    has = F.col("id").isNotNull()
    return per.groupBy("doc_id", "kind").agg(F.count_if(has & ~F.col("fresh")).alias("known"), F.count_if(has & F.col("fresh")).alias("new"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("skipped"))


def identities(results: DataFrame) -> DataFrame:
    """The identity registry: doc_id, community_id, kind, display, family.

    The first spelling names a person unless it has no space and a longer one comes;
    the first household sticks.  A household without a label is named by its members.
    """
    at = F.struct("place", "index", F.coalesce("p.slot", F.lit(0)).alias("slot"))
    people = persons(results).filter("p.community_id is not null and coalesce(p.action, '') <> 'skip'").select("doc_id", F.col("p.community_id").alias("id"), at.alias("at"), _full_name("p").alias("name"), "family_id")
    seen = people.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "family_id"))).alias("s"))
    display = F.expr("aggregate(transform(s, x -> x.name), '', (d, n) -> if(length(n) > length(d) and not contains(d, ' '), n, d))")
    people = seen.select("doc_id", F.col("id").alias("community_id"), F.lit("person").alias("kind"), display.alias("display"), F.expr("get(filter(transform(s, x -> x.family_id), f -> f is not null), 0)").alias("family"), F.col("s")[0]["at"].alias("at"))
    labels = plan_rows(results).filter("r.family.community_id is not null").groupBy("doc_id", F.col("r.family.community_id").alias("community_id")).agg(F.min(F.when(F.trim("r.family.display_name") != "", F.struct("place", F.col("r.index").alias("i"), F.trim("r.family.display_name").alias("label"))))["label"].alias("label"))
    members = people.filter("family is not null and display <> ''").groupBy("doc_id", F.col("family").alias("community_id")).agg(F.concat(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "display"))), lambda x: x["display"])), " & "), F.lit(" household")).alias("by_members"))
    homes = labels.join(members, ["doc_id", "community_id"], "left").select("doc_id", "community_id", F.lit("family").alias("kind"), F.coalesce("label", "by_members", F.lit("")).alias("display"), F.lit(None).cast("string").alias("family"))
    return people.drop("at").unionByName(homes)


def identity_overrides(results: DataFrame, sheets: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell rewrites (doc_id, sheet, row, col, expected, new), and household ids for an appended column.

    Ids in one cell stand by slot, joined with ``, `` in a list and ``&`` else.  A cell
    that also holds somebody without an id is left alone.  A household's id goes to its
    own filled cell, else to the appended column.
    """
    people = _with_row(persons(results).withColumn("c", name_cell("p")).filter("c is not null"), sheets, F.col("index")).withColumn("col", F.col("c.col"))
    none = F.col("p.community_id").isNull() | (F.coalesce("p.action", F.lit("")) == "skip")
    at = ["doc_id", "sheet", "row", "col"]
    entry = F.struct(F.coalesce("p.slot", F.lit(0)).alias("slot"), F.concat(F.lit("["), F.col("p.community_id"), F.lit("]")).alias("token"), F.col("c.part").alias("part"))
    by_cell = people.groupBy(*at).agg(F.bool_or(none).alias("alone"), F.array_sort(F.collect_list(entry)).alias("e")).filter("not alone")
    joined = F.expr("array_join(array_distinct(transform(e, x -> x.token)), if(e[0].part = 'list', ', ', ' & '))")
    names = by_cell.select(*at, joined.alias("new")).join(cells, at, "left").select(*at, F.coalesce("value", F.lit("")).alias("expected"), "new")
    homes = _with_row(plan_rows(results).filter("r.family.community_id is not null"), sheets, F.col("r.index"))
    homes = homes.select("doc_id", "sheet", "row", F.col("r.family.cell.col").alias("col"), F.concat(F.lit("["), F.col("r.family.community_id"), F.lit("]")).alias("new")).join(cells, at, "left")
    own = F.coalesce(strip(F.col("value")), F.lit("")) != ""
    taken = names.select(*at, F.lit(True).alias("taken"))
    homes = homes.join(taken, at, "left").filter("taken is null")
    return names.unionByName(homes.filter(own).select(*at, F.col("value").alias("expected"), "new")), homes.filter(~own).select("doc_id", "sheet", "row", F.col("new").alias("value"))


def cells_left_alone(results: DataFrame) -> DataFrame:
    """doc_id and the number of name cells that keep their text because somebody in them has no id: doc_id, cells."""
    people = persons(results).withColumn("c", name_cell("p")).filter("c is not null")
    none = F.col("p.community_id").isNull() | (F.coalesce("p.action", F.lit("")) == "skip")
    by_cell = people.groupBy("doc_id", "place", "index", F.col("c.col").alias("col")).agg(F.bool_or(none).alias("alone"))
    return by_cell.groupBy("doc_id").agg(F.count_if("alone").alias("cells"))


def commit_key(requests: DataFrame) -> DataFrame:
    """Requests with the idempotency key of their content: equal ones share it whenever they are sent."""
    return requests.withColumn("idempotency_key", canonical_hash(*(F.col(c) for c in sorted(requests.columns))))


def commit_once(requests: DataFrame, ledger: DataFrame, send: Callable[[DataFrame], DataFrame], scope: str = "") -> DataFrame:
    """The outcome of each request: idempotency_key, outcome and what else ``send`` returns.

    A request whose key has an outcome in the ledger (idempotency_key, outcome) isn't
    sent again.  While an outcome is ``unknown``, its document (``doc_id``, if both
    tables have it) is frozen: the same request is sent again under the same key, any
    other for the document gets the outcome ``frozen`` unsent, as all but one of several
    new requests of a document do.  So does the same request
    if it was first sent under another ``scope`` (a column of the ledger, if there), as
    the receiver wouldn't know the key again.  Outcomes are written before they are
    returned, so reading them twice sends nothing twice.
    """
    keyed = commit_key(requests)
    done = ledger.filter("outcome <> 'unknown'")
    known = done.join(keyed.select("idempotency_key"), "idempotency_key", "left_semi")
    left = keyed.join(done.select("idempotency_key"), "idempotency_key", "left_anti")
    open_ = ledger.filter("outcome = 'unknown'").join(done.select("idempotency_key"), "idempotency_key", "left_anti")
    same = open_.select("idempotency_key", (F.coalesce(F.col("scope") != scope, F.lit(False)) if "scope" in ledger.columns else F.lit(False)).alias("foreign")).groupBy("idempotency_key").agg(F.bool_or("foreign").alias("foreign"))
    left = left.join(same, "idempotency_key", "left")
    held = F.coalesce("foreign", F.lit(False))
    if "doc_id" in ledger.columns and "doc_id" in requests.columns:
        left = left.join(open_.select("doc_id", F.lit(True).alias("waits")).distinct(), "doc_id", "left")
        held = held | (F.col("foreign").isNull() & F.coalesce("waits", F.lit(False)))
    left = left.withColumn("held", held)
    if "doc_id" in requests.columns:
        # of several new requests of a document one is sent
        own = F.row_number().over(Window.partitionBy("doc_id", "held").orderBy("idempotency_key"))
        left = left.withColumn("held", F.col("held") | (F.col("doc_id").isNotNull() & (own > 1)))
    sent = written(send(left.filter("not held").select(keyed.columns)), "outcomes")
    frozen = left.filter("held").select("idempotency_key", F.lit("frozen").alias("outcome"))
    return sent.unionByName(frozen, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
