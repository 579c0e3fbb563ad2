import pytest
from pyspark.sql import functions as F

from maskwright.operators import cells as C
from maskwright.operators import detect, matcher, registry, restore
from maskwright.operators.verify import passed_only, residual_names, verify
from maskwright.plans.flow import anonymise, preview

TEXT = "Call +1 (512) 555-0147 or jane.doe@example.com. SSN 123-45-6789, card 4111 1111 1111 1111, bad 4111 1111 1111 1112, host 192.168.10.44, version 1.2.3.4. Lives at 12 Oak Hill Rd, Austin, TX 78701."


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_all_shapes(spark):
    found = {(r.value, r.tag) for r in detect.detect_patterns(docs_of(spark, TEXT)).collect()}
    assert found == {
        ("+1 (512) 555-0147", "PHONE"), ("jane.doe@example.com", "EMAIL"), ("123-45-6789", "ID"), ("4111 1111 1111 1111", "FINANCIAL"),
        ("192.168.10.44", "IP"), ("12 Oak Hill Rd, Austin, TX 78701", "ADDRESS"),
    }
    assert {r.tag for r in detect.detect_patterns(docs_of(spark, TEXT), ["EMAIL"]).collect()} == {"EMAIL"}


def test_round_trip_and_gate(spark):
    docs = docs_of(spark, TEXT, "nothing here", None, "")
    terms = detect.parse_terms(spark.createDataFrame([("ORG: Oak Hill", 0), ("jane", 1), ("jane", 2), (" ", 3)], "line string, seq int"))
    result = anonymise(docs, secret="s", terms=terms)
    assert all(r.passed for r in result.verified.collect())
    out = {r.doc_id: r.text for r in result.outputs.collect()}
    assert "example.com" not in out[0] and out[1] == "nothing here" and out[2] is None
    assert {r.doc_id: r.passed for r in verify(docs, result.registry).collect()}[0] is False
    assert [r.doc_id for r in passed_only(docs, verify(docs, result.registry)).orderBy("doc_id").collect()] == [1, 2, 3]
    keys = result.registry.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("original", "placeholder"))).alias("replacement_map")).select(F.col("doc_id").alias("key_no"), F.lit("s").alias("session_id"), "replacement_map")
    back, found = restore.restore(result.outputs.drop("replaced"), restore.build_index(keys))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert restore.restore_report(found).collect()[0].unresolved_count == 0
    assert preview(docs, result.registry, 20).filter("doc_id = 0").collect()[0].text.startswith("Call [PHONE_")is False


def test_ids_avoid_reserved_and_each_other(spark):
    rows = registry.first_wins(detect.detect_patterns(docs_of(spark, *[f"a{i}@example.com" for i in range(50)])))
    first = registry.with_ids(rows, "k")
    again = registry.with_ids(rows, "k", first.select("hex_id").limit(20))
    assert again.join(first.limit(20), "hex_id").count() <= 30
    ids = [r.hex_id for r in registry.with_ids(rows, "k", first.select("hex_id")).collect()]
    assert len(set(ids)) == 50 and not set(ids) & {r.hex_id for r in first.collect()}


def test_first_source_names_a_value(spark):
    hits = spark.createDataFrame([(1, "x", "ORG", 1, 5), (1, "x", "PERSON", 0, 9), (1, "x", "ID", 3, 0), (1, "", "ID", 0, 0)], "doc_id long, value string, tag string, source int, seq long")
    (r,) = registry.first_wins(hits).collect()
    assert (r.tag, list(r.types)) == ("PERSON", ["ID", "ORG", "PERSON"])


def test_deselecting_drops_links(spark):
    rows = spark.createDataFrame([(1, "Ann", "PERSON", "A1", None), (1, "Ann Lee", "PERSON", "B2", "A1"), (1, "x@y.zz", "EMAIL", "C3", "B2")], "doc_id long, original string, tag string, hex_id string, linked_to string")
    kept = {r.original: r.linked_to for r in registry.deselect(rows, spark.createDataFrame([(1, "Ann")], "doc_id long, original string")).collect()}
    assert kept == {"Ann Lee": None, "x@y.zz": "B2"}
    assert registry.deselect(rows, tags=["EMAIL"]).count() == 2


@pytest.mark.parametrize("block", [2, 100])
def test_terms_are_found_within_others(spark, monkeypatch, block):
    monkeypatch.setattr(matcher, "BLOCK_VALUES", block)
    terms = detect.parse_terms(spark.createDataFrame([("Ann", 0), ("Anna Smith", 1), ("Smith Jones", 2), ("FINANCIAL: 123", 3), ("absent", 4)], "line string, seq long"))
    found = detect.detect_terms(docs_of(spark, "for Anna Smith Jones, 51234", "Ann", None), terms)
    assert sorted((r.doc_id, r.value, r.tag) for r in found.collect()) == [(0, "123", "FINANCIAL"), (0, "Ann", "PERSON"), (0, "Anna Smith", "PERSON"), (0, "Smith Jones", "PERSON"), (1, "Ann", "PERSON")]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_unions_of_overlapping_values(spark):
    docs = docs_of(spark, "Doctor Mary Jones came", "Mary JonesBob", "Doctor Mary\nJones")
    hits = [(d, v, "PERSON") for d, vs in enumerate([["Doctor Mary", "Mary Jones"], ["Mary Jones", "Bob"], ["Doctor Mary", "Mary\nJones"]]) for v in vs]
    found = detect.overlap_unions(spark.createDataFrame(hits, "doc_id long, value string, tag string"), docs)
    assert [(r.doc_id, r.value) for r in found.collect()] == [(0, "Doctor Mary Jones")]


def test_consensus(spark):
    sheet = [["Guest", "Fee"], ["Ann Lee", "100"], ["Bob Ray", "250"], ["Cy Poe", "75"]]
    cells = spark.createDataFrame([(1, 0, r, c, v) for r, row in enumerate(sheet) for c, v in enumerate(row)], "doc_id long, sheet int, row int, col int, value string")
    known = spark.createDataFrame([(1, "Ann Lee", "PERSON"), (1, "Bob Ray", "PERSON"), (1, "100", "FINANCIAL"), (1, "250", "FINANCIAL")], "doc_id long, value string, tag string")
    assert [(r.value, r.tag) for r in detect.detect_consensus(cells, known).collect()] == [("Cy Poe", "PERSON")]
    few = known.filter("value = 'Ann Lee'")
    assert detect.detect_consensus(cells, few).count() == 0


def test_model_hits_and_failure(spark):
    chunks = spark.createDataFrame([(1, 0, "Ann paid $5")], "doc_id long, chunk_no int, text string")
    items = [{"text": "Ann", "type": "person"}, {"text": "$5", "type": "FINANCIAL"}, {"text": "Ann", "type": "NONSENSE"}]
    assert [(r.value, r.tag) for r in detect.detect_model(chunks, lambda t: items).collect()] == [("Ann", "PERSON")]
    with pytest.raises(Exception, match="can't be scanned"):
        detect.detect_model(chunks, lambda t: None).collect()


def test_residue_is_a_warning(spark):
    labels = {r.doc_id: r.labels for r in detect.residue(docs_of(spark, TEXT, "[EMAIL_3A4F9C2B1D0E] 1.2.3.4")).collect()}
    assert labels == {0: ["CREDIT_CARD", "EMAIL", "IP", "PHONE", "SSN"], 1: []}
    names = spark.createDataFrame([(0, "Oak"), (0, "ustin")], "doc_id long, name string")
    assert [(r.name, r.matches) for r in residual_names(docs_of(spark, TEXT), names).collect()] == [("Oak", 1)]


KEYS = "key_no long, session_id string, created_at string, replacement_map map<string,string>, identity_registry map<string,struct<kind:string,display:string,family:string>>"


def test_spellings_of_tokens(spark):
    keys = spark.createDataFrame([(1, "a", "2024", {"Jane": "[PERSON_3A4F9C2B1D0E]", "Smith": "[PERSON_12AB]"}, None)], KEYS)
    index = restore.build_index(keys)
    cases = {
        "[PERSON_3A4F9C2B1D0E]": "Jane", "\\[PERSON\\_3A4F9C2B1D0E\\]": "Jane", "[ person_3a4f9c2b1d0e ]": "Jane", "ORG_3A4F9C2B1D0E": "Jane", "3a4f9c2b1d0e": "Jane",
        "PERSON_3A4F9C2B1D0Es": "Janes", "[PERSON_12AB]": "Smith", "12AB": "12AB", "[ORG_12AB]": "[ORG_12AB]", "[PERSON_FFFFFFFFFFF1]": "[PERSON_FFFFFFFFFFF1]",
        "xPERSON_3A4F9C2B1D0E9": "xPERSON_3A4F9C2B1D0E9",
    }
    docs = docs_of(spark, *cases)
    back, found = restore.restore(docs, index)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(cases.values()))
    report = {r.doc_id: r for r in restore.restore_report(found).collect()}
    assert report[3].relabeled == 1 and report[4].untagged == 1 and list(report[9].unresolved) == ["[PERSON_FFFFFFFFFFF1]"]
    assert [r.doc_id for r in restore.glued(docs, found, index).collect()] == [10]
    assert restore.residual(docs, index).first()[0] == 7


def test_conflicting_keys_are_refused(spark):
    keys = spark.createDataFrame([(1, "a", "1", {"Jane": "[PERSON_3A4F9C2B1D0E]"}, None), (2, "b", "2", {"Joan": "[PERSON_3A4F9C2B1D0E]"}, None)], KEYS)
    with pytest.raises(restore.KeyConflict):
        restore.build_index(keys)


def test_identities_take_the_newest_spelling(spark):
    hx = "3A4F9C2B1D0E0011"
    ids = lambda name: {f"I{hx}": ("person", name, None)}
    keys = spark.createDataFrame([(1, "a", "2024-01", {"x y": "[ORG_0A4F9C2B1D0E]"}, ids("Ann L.")), (2, "b", "2024-03", {"x y": "[ORG_0A4F9C2B1D0E]"}, ids("Ann Lee")), (3, "c", "2024-09", {"x y": "[ORG_0A4F9C2B1D0E]"}, ids(""))], KEYS)
    back, _ = restore.restore(docs_of(spark, f"[I{hx}] and {hx} or F{hx}", "other 0011223344556677"), restore.build_index(keys))
    assert [r.text for r in back.orderBy("doc_id").collect()] == ["Ann Lee and Ann Lee or Ann Lee", "other 0011223344556677"]
    assert tuple(restore.ambiguity(keys).first()) == (0, 1)


def test_cells(spark):
    cells = spark.createDataFrame([(1, 0, r, c, v) for r, row in enumerate([["Name", "Room"], ["Ann", "94"], [], ["Bob"]]) for c, v in enumerate(row)], "doc_id long, sheet int, row int, col int, value string")
    assert C.sheet_text(cells).first().text == "Name,Room\nAnn,94\nBob"
    over = spark.createDataFrame([(1, 0, 1, 0, "Ann", "[I1]"), (1, 0, 3, 0, "Rob", "[I2]")], "doc_id long, sheet int, row int, col int, expected string, new string")
    done = {(r.row, r.col): (r.value, r.overridden, r.skipped) for r in C.apply_overrides(cells, over).collect()}
    assert done[1, 0] == ("[I1]", True, False) and done[3, 0] == ("Bob", False, True)
    spec = spark.createDataFrame([(1, 0, 2, 0, "FAMILY_ID")], "doc_id long, sheet int, col int, header_row int, header string")
    wide = C.append_column(cells, spec, spark.createDataFrame([(1, 0, 3, "[F0123456789ABCDEF]")], "doc_id long, sheet int, row int, value string"))
    assert {(r.row, r.col) for r in wide.collect()} - {(r.row, r.col) for r in cells.collect()} == {(0, 2), (3, 1), (3, 2)}
    assert C.remove_columns(wide, spec).filter("col = 2").count() == 0
    spoiled = wide.withColumn("value", F.when((F.col("row") == 3) & (F.col("col") == 2), "text").otherwise(F.col("value")))
    assert C.remove_columns(spoiled, spec).filter("col = 2").count() == 2
    layouts = spark.createDataFrame([("s1", 0, 1, 0, "Ann", "A"), ("s2", 0, 1, 0, "Ann", "A"), ("s2", 0, 3, 0, "Bob", "B")], "session_id string, sheet int, row int, col int, written string, original string")
    assert [(r.session_id, r.hits) for r in C.best_layout(cells, layouts).collect()] == [("s2", 2)]
    tie = layouts.filter("row = 1").withColumn("original", F.concat("original", "session_id"))
    assert C.best_layout(cells, tie).count() == 0


def test_cells_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    rows = [(d, s, r, c, f"v{d}{r}{'x' if c else ''}, 12 {r}") for d in (1, 2, 3) for s in (0, 1) for r in range(20) for c in range(3)] + [(1, 0, 50, 0, None), (None, 0, 0, 0, "v11")]
    cells = spark.createDataFrame(rows, "doc_id long, sheet int, row int, col int, value string").repartition(5)
    reg = spark.createDataFrame([(d, v, f"[ID_{d}A1B2C3D4E5F{k}]"[:15] + "]") for d in (1, 2) for k, v in enumerate([f"v{d}1", f"v{d}1x", "12", "3", ""])] + [(1, "v11", "[ID_000000000000]")], "doc_id long, original string, placeholder string")
    over = spark.createDataFrame([(1, 0, 3, 0, "v13, 12 3", "[I1]"), (1, 0, 4, 0, "other", "[I2]")], "doc_id long, sheet int, row int, col int, expected string, new string")
    for o in (None, over):
        got = C.scrub_cells(cells, reg, o)
        assert got.columns == ["doc_id", "sheet", "row", "col", "value", "overridden", "skipped"]
        want = matcher.scrub(C.apply_overrides(cells, over if o is not None else over.limit(0)).filter("not overridden"), reg, (), "value").drop("replaced")
        key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*C.KEY, "value", "skipped").collect())))
        assert key(got.filter("not overridden")) == key(want)
        assert got.count() == len(rows) and got.filter("overridden").count() == (o is not None)


def test_a_value_without_a_free_id_fails(spark):
    rows = registry.first_wins(detect.detect_patterns(spark.createDataFrame([(1, "a@b.org c@d.org")], "doc_id long, text string")))
    every = []
    for _ in range(registry.ATTEMPTS):
        taken = spark.createDataFrame([(x,) for x in every], "hex_id string")
        try:
            every += [r.hex_id for r in registry.with_ids(rows, "k", taken).collect()]
        except ValueError as e:
            assert "no free id" in str(e)
            break
    else:
        with pytest.raises(ValueError, match="no free id"):
            registry.with_ids(rows, "k", spark.createDataFrame([(x,) for x in every], "hex_id string"))


def test_patterns_are_found_in_one_scan(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    plan = detect.detect_patterns(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_glued_ids_by_place(spark):
    docs = spark.createDataFrame([(1, "xx AB12CD34EF56AA yy 0AB12CD34EF56 AB12CD34EF5 zz"), (2, None), (3, "AB12CD34EF56")], "doc_id long, text string")
    found = spark.createDataFrame([(3, 0, 12, "x", True)], "doc_id long, start int, end int, original string, report boolean")
    index = spark.createDataFrame([("hex", "AB12CD34EF56")], "kind string, hex string")
    assert sorted((r.doc_id, r.start, r.token) for r in restore.glued(docs, found, index).collect()) == [(1, 3, "AB12CD34EF56"), (1, 22, "AB12CD34EF56")]


def test_answers_of_a_model(spark):
    from maskwright.functions.answers import answer_items, halves

    one = '[{"text":"x]","type":"PERSON"}]'
    cases = {
        '[{"text":"x","type":"PERSON"}]': ["x"], 'Sure:\n```json\n[{"text":"y","type":"PERSON"}]\n```': ["y"], 'So: [{"text":"z","type":"EMAIL"}] then': ["z"], "[]": [], "{\"pii\": []}": [],
        '{"a": [{"text":"q"}], "b": []}': ["q"], "": None, "none found": None, '[{"text":"x"': None, '[{"text":"a"}, {"text":"b"': None, "[1] and [{}]": [None], one: ["x]"], f"So {one}": None, '{"pii": [{"text":"w"}], "n": 1}': ["w"],
        "[[1], 2": None, '```\n{"items": [{"text":"v"}]}\n```': ["v"],
    }
    docs = docs_of(spark, *cases)
    got = {r.doc_id: r.items and [i.text for i in r.items] if r.items is not None else None for r in docs.select("doc_id", answer_items(F.col("text")).alias("items")).collect()}
    assert got == dict(enumerate(cases.values()))
    assert docs.filter("false").select(answer_items(F.lit(None).cast("string"))).count() == 0
    short, lines, plain = "a" * 399, ("b" * 99 + "\n") * 10, "c" * 800
    assert halves(short) is None and halves(plain) == ("c" * 480, "c" * 480)
    first, second = halves(lines)
    assert len(first) == 699 + 80 and len(second) == 1000 - 699 + 80 and lines.startswith(first) and lines.endswith(second)


def test_a_long_answer_is_asked_in_halves(spark):
    text = "w " * 150 + "Ann " + "w " * 150 + "Bob"

    def model(part):
        if len(part) > 500:
            raise detect.Truncated
        return [{"text": n, "type": "PERSON"} for n in ("Ann", "Bob") if n in part]

    chunks = spark.createDataFrame([(1, 0, text)], "doc_id long, chunk_no int, text string")
    assert {r.value for r in detect.detect_model(chunks, model).collect()} == {"Ann", "Bob"}
    asked = iter([None, [{"text": "Ann", "type": "PERSON"}]])
    assert detect._scan("Ann", lambda t: next(asked), 3, 0) == [{"text": "Ann", "type": "PERSON"}]


def test_glued_ids_are_in_the_report(spark):
    keys = spark.createDataFrame([(1, "a", "2024", {"Jane": "[PERSON_A1A1A1A1A1A1]"}, {"I0123456789ABCDEF": ("person", "Ann Lee", None)})], KEYS)
    index = restore.build_index(keys)
    docs = docs_of(spark, "xPERSON_A1A1A1A1A1A1A1A1A1A9F", "f70123456789abcdef7", "plain")
    _, found = restore.restore(docs, index)
    assert sorted((r.doc_id, r.start, r.token) for r in restore.glued(docs, found, index).collect()) == [(0, 8, "A1A1A1A1A1A1"), (1, 2, "0123456789abcdef")]
    report = {r.doc_id: (r.unresolved_count, list(r.unresolved)) for r in restore.restore_report(restore.with_glued(docs, found, index)).collect()}
    assert report == {0: (1, ["A1A1A1A1A1A1"]), 1: (1, ["0123456789abcdef"])}


def test_links_by_id_and_by_text(spark):
    rows = [(1, "Ann", "PERSON", "AAAAAAAAAAA1", None), (1, "a@x.org", "EMAIL", "AAAAAAAAAAA2", "Ann"), (1, "555", "PHONE", "AAAAAAAAAAA3", "aaaaaaaaaaa1"), (1, "b", "ID", "AAAAAAAAAAA4", "[PERSON_AAAAAAAAAAA1]"), (1, "c", "ID", "AAAAAAAAAAA5", "nobody"), (1, "d", "ID", "AAAAAAAAAAA6", "d"), (2, "e", "ID", "AAAAAAAAAAA7", "Ann")]
    found = registry.resolve_links(spark.createDataFrame(rows, "doc_id long, original string, tag string, hex_id string, linked_to string"))
    assert {r.original: r.linked_to for r in found.collect()} == {"Ann": None, "a@x.org": "AAAAAAAAAAA1", "555": "AAAAAAAAAAA1", "b": "AAAAAAAAAAA1", "c": None, "d": None, "e": None}


def test_a_street_within_a_longer_word_of_any_script_is_none(spark):
    docs = docs_of(spark, "87 Stühle", "87 St")
    assert [r.doc_id for r in detect.detect_patterns(docs).collect()] == [r.doc_id for r in detect.pattern_matches(docs, "ADDRESS").collect()] == [1]
    assert [r.value for r in detect.detect_patterns(docs, ascii_words=True).collect()] == ["87 St"] * 2
