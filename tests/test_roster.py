import json

from maskwright.operators import roster as R

SHEET = [["Student First Name", "Student Last Name", "Parent Name", "Family", "Notes"], ["Emma", "Lee", "Ann Lee", "Lee family", "Ann called"], ["Tom", "Lee", "Ann Lee", "", ""], ["Kim", "Ray", "", "", ""]]


def person(key, given, family, cells, pid=None, state="known", action="matched", slot=0, **more):
    return {"key": key, "slot": slot, "given_name": given, "family_name": family, "action": action, "community_id": pid, "code_state": state, "name_cells": [{"col": c, "part": p} for c, p in cells]} | more


def test_roster(spark):
    cells = spark.createDataFrame([(1, 0, r, c, v) for r, row in enumerate(SHEET) for c, v in enumerate(row)], "doc_id long, sheet int, row int, col int, value string")
    sheets = R.roster_sheets(cells)
    assert [tuple(r) for r in sheets.select("header_row", "width", "one_column").collect()] == [(0, 5, False)]
    assert R.over_limits(cells, sheets).count() == 0
    assert sorted(r.row for r in R.roster_rows(cells, sheets).collect()) == [1, 2, 3]
    fam = {"key": "0:0:family", "display_name": "Lee family", "cell": {"col": 3}, "action": "new", "code_state": "new", "community_id": "F0000000000000001"}
    rows = [
        {"index": 0, "persons": [person("0:0:0", "Emma", "Lee", [(0, "given"), (1, "family")], "I1", "new", "new"), person("0:0:1", "Ann", "Lee", [(2, "full")], "I2", candidates=[{"community_id": "I00000000"}], slot=1)], "family": fam},
        {"index": 1, "persons": [person("0:1:0", "Tom", "Lee", [(0, "given")], None, None, "review", candidates=[{"community_id": "I00000000"}]), person("0:1:1", "Ann", "Lee", [(2, "full")], "I2", "new", "matched", slot=1)], "family": fam | {"key": "0:1:family", "display_name": None}},
        {"index": 2, "persons": [person("0:2:0", "Kim", "Ray", [(0, "given")], None, None, "skip")], "family": None},
    ]
    plans = R.parse_plan(spark.createDataFrame([(1, json.dumps({"sheets": [{"index": 0, "rows": rows}]}))], "doc_id long, json string"))
    items = R.plan_items(plans, sheets)
    assert {r.key: (r.kind, r.sheet_row, r.action) for r in items.collect()}["0:1:0"] == ("person", 3, "review")
    assert items.count() == 7
    wanted = [(1, "0:1:0", "attach", "i00000000"), (1, "0:0:family", "skip", None), (1, "0:0:0", "attach", "I11111111"), (1, "gone", "create", None), (1, "0:2:0", "create", None)]
    decided = R.valid_decisions(spark.createDataFrame(wanted, "doc_id long, key string, action string, target string"), items)
    assert sorted((r.key, r.action, r.target) for r in decided.collect()) == [("0:1:0", "attach", "I00000000"), ("0:2:0", "create", None)]
    assert R.pending(items, decided).count() == 0
    counts = {r.kind: (r.known, r.new, r.skipped) for r in R.outcome_counts(plans).collect()}
    assert counts == {"people": (0, 2, 2), "households": (0, 1, 0)}
    over, appended = R.identity_overrides(plans, sheets, cells)
    assert {(r.row, r.col): r.new for r in over.collect()} == {(1, 0): "[I1]", (1, 2): "[I2]", (2, 2): "[I2]", (1, 3): "[F0000000000000001]"}
    assert [(r.row, r.value) for r in appended.collect()] == [(2, "[F0000000000000001]")]
    names = {r.value for r in R.certain_names(plans, sheets, cells).collect()}
    assert {"Lee", "Ann", "Ann Lee", "Lee family"} <= names and "Tom" not in names
    ids = {r.community_id: r.display for r in R.identities(plans).collect()}
    assert ids == {"I1": "Emma Lee", "I2": "Ann Lee", "F0000000000000001": "Lee family"}
    kept = R.kept_names(plans, sheets, cells, spark.createDataFrame([(1, "Ann Lee")], "doc_id long, original string"))
    assert sorted(r.key for r in kept.collect()) == ["0:0:1", "0:1:1"]


def test_a_list_of_one_column_goes_to_review(spark):
    cells = spark.createDataFrame([(1, 0, r, 0, v) for r, v in enumerate(["Roster", "Name", "Ann Lee"])], "doc_id long, sheet int, row int, col int, value string")
    sheets = R.roster_sheets(cells)
    assert [tuple(r) for r in sheets.select("header_row", "one_column").collect()] == [(1, True)]
    plan = {"sheets": [{"index": 0, "rows": [{"index": 0, "persons": [person("0:0:0", "Ann", "Lee", [(0, "full")], "I1", matched={"community_id": "I1"})]}]}]}
    (item,) = R.plan_items(R.parse_plan(spark.createDataFrame([(1, json.dumps(plan))], "doc_id long, json string")), sheets).collect()
    assert item.action == "review" and item.candidates[0].community_id == "I1" and list(item.reasons) == ["one_column_list"]


def test_commits_are_sent_once(spark):
    requests = spark.createDataFrame([("r1", "a"), ("r2", "b")], "ref string, body string")
    keyed = {r.ref: r.idempotency_key for r in R.commit_key(requests).collect()}
    ledger = spark.createDataFrame([(keyed["r1"], "done")], "idempotency_key string, outcome string")
    sent = []

    def send(rows):
        sent.extend(r.ref for r in rows.collect())
        return rows.selectExpr("idempotency_key", "'done' as outcome")

    assert R.commit_once(requests, ledger, send).count() == 2 and sent == ["r2"]


def test_a_cover_sheet_and_blank_rows_keep_places(spark):
    book = [[["Parish of the Hill"]], [["First Name", "Last Name", "Family"], ["Emma", "Lee", ""], [], ["Tom", "Ray", "Ray family"]], [["First Name", "Last Name"], ["Kim", "Day"]]]
    cells = spark.createDataFrame([(1, s, r, c, v) for s, rows in enumerate(book) for r, row in enumerate(rows) for c, v in enumerate(row)], "doc_id long, sheet int, row int, col int, value string")
    sheets = R.roster_sheets(cells)
    assert sorted((r.sheet, r.place, r.header_row, r.last_row) for r in sheets.collect()) == [(1, 0, 0, 3), (2, 1, 0, 1)]
    rows = {(r.sheet, r.row): r.cells for r in R.roster_rows(cells, sheets).collect()}
    assert rows == {(1, 1): ["Emma", "Lee", ""], (1, 2): ["", "", ""], (1, 3): ["Tom", "Ray", "Ray family"], (2, 1): ["Kim", "Day"]}
    of = lambda key, given, i: {"index": i, "persons": [person(key, given, "X", [(0, "given")], f"I{given}", "new", "new")]}
    plan = {"sheets": [{"index": 0, "rows": [of("0:0:0", "Emma", 0), of("0:2:0", "Tom", 2)]}, {"index": 1, "rows": [of("1:0:0", "Kim", 0)]}]}
    plans = R.parse_plan(spark.createDataFrame([(1, json.dumps(plan))], "doc_id long, json string"))
    assert sorted((r.key, r.sheet, r.sheet_row) for r in R.plan_items(plans, sheets).collect()) == [("0:0:0", 1, 2), ("0:2:0", 1, 4), ("1:0:0", 2, 2)]
    over, _ = R.identity_overrides(plans, sheets, cells)
    assert sorted((r.sheet, r.row, r.expected, r.new) for r in over.collect()) == [(1, 1, "Emma", "[IEmma]"), (1, 3, "Tom", "[ITom]"), (2, 1, "Kim", "[IKim]")]
    assert [tuple(r) for r in R.plan_totals(plans, sheets).collect()] == [(1, 2, 4, 3)]


def test_sheets_without_header_words_go_first(spark):
    book = {s: [["Total", "Sum"], ["1", "2"]] for s in range(R.MOST_SHEETS)} | {R.MOST_SHEETS: [["x" * (R.MOST_CHARS + 1)], ["Name", "Phone"], ["Ann", "1"]]}
    cells = spark.createDataFrame([(1, s, r, c, v) for s, rows in book.items() for r, row in enumerate(rows) for c, v in enumerate(row)], "doc_id long, sheet int, row int, col int, value string")
    sheets = R.roster_sheets(cells)
    assert [(r.sheet, r.place, r.header_row) for r in sheets.collect()] == [(R.MOST_SHEETS, 0, 1)]
    assert R.over_limits(cells, sheets).count() == 0  # the long cell is above the header
    assert R.roster_sheets(cells.filter(f"sheet < {R.MOST_SHEETS}")).count() == R.MOST_SHEETS


def test_an_unknown_outcome_freezes_its_document(spark):
    requests = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, body string")
    keyed = {r.body: r.idempotency_key for r in R.commit_key(requests).collect()}
    ledger = spark.createDataFrame([(1, keyed["a"], "unknown", "s"), (3, keyed["d"], "unknown", "other")], "doc_id long, idempotency_key string, outcome string, scope string")
    sent = []

    def send(rows):
        sent.extend(r.body for r in rows.collect())
        return rows.selectExpr("idempotency_key", "'done' as outcome")

    out = R.commit_once(requests, ledger, send, scope="s")
    by_key = {v: k for k, v in keyed.items()}
    expected = {"a": "done", "b": "frozen", "c": "done", "d": "frozen"}
    assert {by_key[r.idempotency_key]: r.outcome for r in out.collect()} == expected
    assert out.count() == 4 and sorted(sent) == ["a", "c"]


def test_decisions_are_replaced_undone_and_refused_while_frozen(spark):
    kind = "doc_id long, key string, action string, target string"
    now = spark.createDataFrame([(1, "x", "create", None), (1, "y", "skip", None), (2, "x", "create", None)], kind)
    new = spark.createDataFrame([(1, "x", "attach", "I1"), (1, "y", "undo", None), (2, "x", "undo", None), (1, "z", "undo", None)], kind)
    out = R.decide(now, new, spark.createDataFrame([(2,)], "doc_id long"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", "attach", "I1"), (2, "x", "create", None)]
