"""Pieces, titles, spans in SQL, keys and CSV files by ranges."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions import udtf
from maskwright.operators import roster, runs, titles
from maskwright.operators.matcher import Matcher, occurrences, placeholders, splice
from maskwright.operators.verify import residual_names
from maskwright.plans.flow import preview_counts, preview_spans
from maskwright.sources import csv_ranges, files, keys, sinks

REGISTRY = "doc_id long, original string, tag string, hex_id string, placeholder string"


def registry_of(spark, *rows):
    return spark.createDataFrame([(d, v, "PERSON", f"{k:011X}A", f"[PERSON_{k:011X}A]") for k, (d, v) in enumerate(rows, 1)], REGISTRY)


def scrubbed_pieces(pieces, own, shut):
    """The rule by hand: each character stays with its run, a value's placeholder goes where it begins."""
    text = "".join(p or "" for p in pieces)
    owner = [k for k, p in enumerate(pieces) for _ in p or ""]
    spans = [s for s in Matcher(own, placeholders(own.values())).find(text) if not any(s[0] < b and a < s[1] for a, b in shut if a < b)]
    out, at = [""] * len(pieces), 0
    while at < len(text):
        hit = next((s for s in spans if s[0] == at), None)
        out[owner[at]] += own[hit[2]] if hit else text[at]
        at = hit[1] if hit else at + 1
    return out


def test_values_across_runs(spark):
    rng = random.Random(2)
    values = ["Ann", "Ann Lee", "Lee", "na", "12", "é n"]
    own = {d: rng.sample(values, rng.randint(1, 4)) for d in range(4)}
    reg = registry_of(spark, *((d, v) for d, vs in own.items() for v in vs))
    tokens = {(r.doc_id, r.original): r.placeholder for r in reg.collect()}
    rows, shut, want = [], [], {}
    for p in range(120):
        d, text = rng.randrange(5), "".join(rng.choice(["Ann", "Lee", " ", "n", "a", "12", ",", "é", "Ann Lee "]) for _ in range(rng.randrange(9)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
        pieces = [text[a:b] or rng.choice(["", None]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows += [(d, p, k, x, "clash") for k, x in enumerate(pieces)]
        mine = [(rng.randrange(9), rng.randrange(12)) for _ in range(rng.randrange(2))]
        shut += [(d, p, *s) for s in mine]
        want |= {(p, k): x for k, x in enumerate(scrubbed_pieces(pieces, {v: tokens[d, v] for v in own.get(d, ())}, mine))}
    frame = spark.createDataFrame(rows, "doc_id long, paragraph int, run int, text string, spans string").repartition(5)
    got = runs.scrub_runs(frame, reg, spark.createDataFrame(shut, "doc_id long, paragraph int, start int, end int")).collect()
    assert {(r.paragraph, r.run): r.text for r in got} == want
    assert {(r.paragraph, r.run) for r in got if r.changed} == {k for k, x in want.items() if x != next(y[3] or "" for y in rows if (y[1], y[2]) == k)}
    assert runs.scrub_runs(frame.limit(0), reg).count() == 0


def test_new_titles(spark):
    sheets = ["Ann", "Bob", "ann list", "Plan", "PERSON_00000000001A", "Bob: 1", "Bob* 1", "Ann and a title that is rather", None, "Zed"]
    reg = registry_of(spark, (1, "Ann"), (1, "Bob"), (1, "Zed"), (1, "ann list"))
    reg = reg.withColumn("placeholder", F.when(F.col("original") == "Zed", F.lit("[?]")).otherwise(F.col("placeholder")))
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(sheets)] + [(2, 0, "Ann")], "doc_id long, sheet int, title string")
    got = {r.sheet: r.written for r in titles.sheet_titles(rows, reg, "s").collect()}
    assert set(got) == {0, 1, 2, 5, 6, 7, 9}
    assert got[1] == "PERSON_00000000002A" and got[2] == "PERSON_00000000004A" and got[5] == "PERSON_00000000002A_ 1"
    assert all(got[k].startswith("SHEET_") and len(got[k]) == 18 for k in (0, 6, 7))  # taken by sheet 4, by sheet 5, too long
    assert got[9] == "_?_".replace("?", "_")
    assert len({x.lower() for x in got.values()} | {"plan", "person_00000000001a"}) == 9


def test_titles_are_freed_in_order(spark):
    reg = registry_of(spark, (1, "x"), (1, "PERSON_00000000001A"))
    rows = lambda *t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "doc_id long, sheet int, title string")
    early = {r.sheet: r.written for r in titles.sheet_titles(rows("PERSON_00000000001A", "x"), reg, "s").collect()}
    assert early == {0: "PERSON_00000000002A", 1: "PERSON_00000000001A"}  # sheet 0 has left it
    late = {r.sheet: r.written for r in titles.sheet_titles(rows("x", "PERSON_00000000001A"), reg, "s").collect()}
    assert late[0].startswith("SHEET_") and late[1] == "PERSON_00000000002A"


def test_titles_are_searched_once_and_in_blocks(spark):
    # each title had a matcher of all 3,000 values, and was searched each time that the titles were read
    reg = registry_of(spark, *((1, f"Name{k}") for k in range(3_000)))
    rows = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("sheet"), F.concat(F.lit("Name"), F.col("id")).alias("title"))
    done = titles.sheet_titles(rows, reg, "s")
    assert "MapInArrow" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r.sheet: r.written for r in done.collect()} == {k: f"PERSON_{k + 1:011X}A" for k in range(3_000)}


def test_spans_in_sql(spark):
    udtf.register(spark)
    values = ["Ann Lee", "Ann", "Lee Ray", "12", "x"]
    texts = ["Ann Lee Ray has 12, not 123 or x12", "", None, "no", "Ann Ann"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.withColumn("own", F.array(*map(F.lit, values))).createOrReplaceTempView("udtf_docs")
    got = spark.sql("select d.doc_id, s.* from udtf_docs d, lateral spans(d.text, d.own) s")
    want = occurrences(docs, spark.createDataFrame([(v,) for v in values], "value string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert spark.sql("select count(*) from udtf_docs d, lateral spans(d.text, cast(null as array<string>)) s").first()[0] == 0
    own = "map('Ann', '[PERSON_0A1B2C3D4E5F]', '12', '[ID_0A1B2C3D4E50]', '', 'z')"
    out = [r[0] for r in spark.sql(f"select scrub(text, {own}) from udtf_docs order by doc_id").collect()]
    assert out == ["[PERSON_0A1B2C3D4E5F] Lee Ray has [ID_0A1B2C3D4E50], not 123 or x12", "", None, "no", "[PERSON_0A1B2C3D4E5F] [PERSON_0A1B2C3D4E5F]"]
    assert spark.sql("select scrub(text, null) from udtf_docs where doc_id = 4").first()[0] == "Ann Ann"


def test_names_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "Lee and Leeds, Ann-Lee. xLee Lee_ O'Lee Lée"), (2, "Lee"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([(1, "Lee"), (1, "Ann-Lee"), (1, ""), (1, "Lée"), (1, "Zed"), (3, "Lee")], "doc_id long, name string")
    assert sorted(tuple(r) for r in residual_names(docs, names).collect()) == [(1, "Ann-Lee", 1), (1, "Lee", 3), (1, "Lée", 1)]


def test_previews(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob " + "y" * 9_990 + " Ann"), (2, "Ann"), (3, None)], "doc_id long, text string")
    reg = registry_of(spark, (1, "Ann"), (1, "Bob"))
    assert sorted(tuple(r)[1:4] for r in preview_spans(docs, reg).collect()) == [(0, 3, "Ann"), (8, 11, "Bob")]
    amounts = spark.createDataFrame([(2, "$5"), (2, "$5"), (2, "7")], "doc_id long, value string")
    got = {r.doc_id: tuple(r)[1:] for r in preview_counts(docs, reg, amounts).collect()}
    assert got == {1: (10_006, True, {"PERSON": 2}, 2, 2, 0), 2: (3, False, {}, 0, 0, 2), 3: (0, False, {}, 0, 0, 0)}
    assert preview_counts(docs, reg).filter("kept_amounts > 0").count() == 0


def test_references_beyond_ascii(spark):
    df = spark.createDataFrame([("Jos&#233; &#38; &amp; &#xE9;&#10;&#xD800;",)], "x string")
    assert df.select(T.xml_unescape(F.col("x"), not_ascii_only=True)).first()[0] == "José &#38; &amp; é&#10;&#xD800;"


def test_placeholders_have_four_or_twelve_digits(spark):
    df = spark.createDataFrame([("[ID_12AB] [ID_12ABCD] [ID_0A1B2C3D4E5F] ID_0A1B2C3D4E5F",)], "x string")
    assert df.select(T.without_placeholders(F.col("x"))).first()[0] == "\n [ID_12ABCD] \n \n"
    assert placeholders(["[ID_12AB]", "[ID_12ABCD]", "[ID_0A1B2C3D4E5F]"]) == {"[ID_12AB]", "ID_12AB", "[ID_0A1B2C3D4E5F]", "ID_0A1B2C3D4E5F"}


KEY = '{"session_id": "s", "original_filename": "f.txt", "created_at": "2024", "replacement_map": {"Ann": "[PERSON_0A1B2C3D4E5F]"}}'


def test_imports_never_overwrite(spark, tmp_path):
    (tmp_path / "one (1).json").write_text(KEY)
    (tmp_path / "two.json").write_text(KEY.replace("Ann", "Bob"))
    (tmp_path / "bad.json").write_text("{}")
    folder, done = str(tmp_path / "keys"), []
    both = [threading.Thread(target=lambda s=s: done.append(keys.import_key(spark, str(tmp_path / s), folder, "../a/k.key.json"))) for s in ("one (1).json", "two.json")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(p.rpartition("/")[2] for p in done) == ["k.key.json", "k_1.key.json"]
    assert keys.import_key(spark, str(tmp_path / "one (1).json"), folder).endswith("/one__1_.key.json")
    read = keys.read_keys(spark, folder).collect()
    assert sorted(next(iter(r.replacement_map)) for r in read) == ["Ann", "Ann", "Bob"]
    with pytest.raises(ValueError, match="one valid key"):
        keys.import_key(spark, str(tmp_path / "bad.json"), folder)


def test_keys_name_the_commit(spark):
    reg = registry_of(spark, (1, "Ann"), (2, "Bob")).selectExpr("*", "array(tag) as types", "cast(null as string) as linked_to")
    sessions = spark.createDataFrame([(1, "s1", "a", "2024"), (2, "s2", "b", "2024")], "doc_id long, session_id string, original_filename string, created_at string")
    people = spark.createDataFrame([(1, "I1", "person", "Ann", None)], "doc_id long, community_id string, kind string, display string, family string")
    commits = spark.createDataFrame([(1, "https://Graph.example.org:8080/x", ["r1", "r2"], None, "2024-05-01 10:00:00"), (2, "http://h/", None, "c", "2024-05-01 10:00:00")], "doc_id long, url string, import_runs array<string>, category string, committed_at string").withColumn("committed_at", F.to_timestamp("committed_at"))
    got = {r.session_id: r.identity_source for r in keys.build_keys(reg, sessions, people, commits=commits).collect()}
    assert got["s1"].asDict() == {"host": "graph.example.org", "import_runs": ["r1", "r2"], "category": "other", "committed_at": "2024-05-01T10:00:00Z"} and got["s2"] is None


def test_cells_of_skipped_people_are_counted(spark):
    import json

    of = lambda key, col, pid, action: {"key": key, "slot": 0, "action": action, "community_id": pid, "name_cells": [{"col": col, "part": "full"}]}
    plan = {"sheets": [{"index": 0, "rows": [{"index": 0, "persons": [of("a", 0, "I1", "new"), of("b", 0, None, "skip"), of("c", 1, "I2", "new")]}]}]}
    plans = roster.parse_plan(spark.createDataFrame([(1, json.dumps(plan))], "doc_id long, json string"))
    assert [tuple(r) for r in roster.cells_left_alone(plans).collect()] == [(1, 1)]


def test_csv_files_that_anything_opens(spark, tmp_path):
    import csv
    import glob

    table = [["Name", "Note"], ['say "hi", now', "a\nb"], ["short"], ["", "x"]]
    cells = spark.createDataFrame([(1, s, r, c, v) for s in (0, 1) for r, row in enumerate(table) for c, v in enumerate(row)] + [(2, 0, 0, 0, "kept back")], "doc_id long, sheet int, row int, col int, value string")
    sinks.write_csv(cells.repartition(4), spark.createDataFrame([(1, True), (2, False)], "doc_id long, passed boolean"), str(tmp_path / "out"))
    for s in (0, 1):
        (name,) = glob.glob(f"{tmp_path}/out/doc_id=1/sheet={s}/part-*")
        with open(name, newline="") as f:
            assert list(csv.reader(f)) == table
    assert not glob.glob(f"{tmp_path}/out/doc_id=2")


def test_lines_within_quotes():
    import csv
    import io

    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice('a",\n\r ') for _ in range(rng.randrange(14)))
        want = list(csv.reader(io.StringIO(text + "\n", newline="")))
        quoted, begun = False, 0
        for line in csv_ranges._CUT.split(text + "\n") if True else ():
            for part in line.splitlines(keepends=True) if "\n" in line else [line]:
                begun += not quoted
                quoted = csv_ranges.ends_quoted(part, quoted)
        assert begun == len(want), text


@pytest.mark.parametrize("size", ["23", "100000"])
def test_csv_by_ranges(spark, tmp_path, size):
    rng = random.Random(3)
    for k in range(3):
        body = "".join(rng.choice(['a', '"', '""', ",", "\n", "\r\n", "é", " ", '"x, y\nz"', "\n\n", "word,"]) for _ in range(25)) + '"\n' * 3 + "end\n"
        (tmp_path / f"{k}.csv").write_bytes(body.encode("utf-8" if k % 2 else "latin-1"))
    (tmp_path / "cr.csv").write_bytes(b'a,b\rc,"d\re"\rf\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r.doc_id[-6:], r.row, r.col): r.value for r in csv_ranges.csv_cells(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(r.doc_id[-6:], r.row, r.col): r.value for r in files.cells(files.read_files(spark, str(tmp_path))).collect()}
    assert got == want


def test_splices():
    assert splice("abc", [(1, 2, "-")]) == "a-c"


def test_a_paragraph_of_many_runs_and_forbidden_places(spark):
    # each of these took work by the square of a paragraph's runs
    runs_ = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("paragraph"), F.col("id").cast("int").alias("run"), F.when(F.col("id") % 3 == 0, "An").when(F.col("id") % 3 == 1, "n ").otherwise("").alias("text"))
    shut = spark.range(0, 20_000, 2).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("paragraph"), (F.col("id") * 4).cast("int").alias("start"), (F.col("id") * 4 + 1).cast("int").alias("end"))
    done = runs.scrub_runs(runs_, registry_of(spark, (1, "Ann")), shut)
    got = done.groupBy("text", "changed").agg(F.count("*").alias("n")).collect()
    assert {(r.text, r.changed): r.n for r in got} == {("An", False): 10_000, ("n ", False): 10_000, ("[PERSON_00000000001A]", True): 10_000, (" ", True): 10_000, ("", False): 20_000}


def test_paragraphs_with_their_runs_as_rows_and_as_arrays(spark):
    pieces = [["A", "nn L", "ee Ann", ""], [], ["Bob"], ["", "Ann", "x"]]
    reg = registry_of(spark, (1, "Ann"), (1, "Ann Lee"), *((1, f"v{k}") for k in range(20)), (2, "Bob"))
    frame = spark.createDataFrame([(d, p, x, "kept") for d in (1, 2, 3) for p, x in enumerate(pieces)], "doc_id long, paragraph int, pieces array<string>, more string")
    got = {(r.doc_id, r.paragraph): (r.new, r.more) for r in runs.scrub_paragraphs(frame, reg).collect()}
    ann, lee, bob = "[PERSON_00000000001A]", "[PERSON_00000000002A]", "[PERSON_00000000017A]"
    new = {(1, 0): [lee, "", f" {ann}", ""], (1, 3): ["", ann, "x"], (2, 2): [bob]}
    assert got == {(d, p): (new.get((d, p), x), "kept") for d in (1, 2, 3) for p, x in enumerate(pieces)}
