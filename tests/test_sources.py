import json
import zipfile

from pyspark.sql import functions as F

from maskwright.operators import detect, registry
from maskwright.operators.matcher import scrub
from maskwright.operators.verify import verify
from maskwright.sources import files, keys, sinks
from maskwright.streaming import detect as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.md").write_bytes(b"caf\xe9")
    (tmp_path / "c.HTML").write_text("<p>Hi</p>")
    (tmp_path / "d.csv").write_text('name,"x, y"\nshort\n')
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>Ann</w:t></w:r><w:r><w:t> Lee</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="people" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2"><v>12</v></c></row></sheetData></worksheet>')
    found = files.read_files(spark, str(tmp_path))
    texts = {r.suffix: r.text for r in files.texts(found).collect()}
    assert texts == {"txt": "é", "md": "café", "html": "Hi", "docx": "Head\nAnn Lee"}
    assert [r.suffix for r in files.unsupported(found).collect()] == ["pdf"]
    cells = {(r.doc_id[-3:], r.row, r.col): r.value for r in files.cells(found).collect()}
    assert cells == {("csv", 0, 0): "name", ("csv", 0, 1): "x, y", ("csv", 1, 0): "short", ("lsx", 1, 0): "Ann", ("lsx", 1, 27): "12"}
    assert [r.title for r in files.sheets(found).collect()] == ["people"]
    assert "Ann" in files.deep_text((tmp_path / "g.xlsx").read_bytes())


def test_keys_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "write a@example.com"), (2, "to b@example.com")], "doc_id long, text string")
    rows = registry.with_ids(registry.first_wins(detect.detect_patterns(docs)), "s")
    outputs = scrub(docs, rows)
    mixed = outputs.filter("doc_id = 1").drop("replaced").unionByName(docs.filter("doc_id = 2"))
    sinks.write_texts(mixed, verify(mixed, rows), str(tmp_path / "out"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    sessions = docs.select("doc_id", F.concat(F.lit("s"), "doc_id").alias("session_id"), F.lit("f.txt").alias("original_filename"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    sinks.write_keys(keys.build_keys(rows, sessions), str(tmp_path / "keys"))
    (tmp_path / "keys" / "bad.json").write_text(json.dumps({"session_id": "x"}))
    spark_keys = spark.read.schema(keys.SCHEMA).json(str(tmp_path / "keys")).filter("replacement_map is not null")
    numbered = keys.numbered(spark_keys)
    assert numbered.count() == 2
    sinks.record_issued(rows, str(tmp_path / "ledger"))
    assert {r.hex_id for r in keys.read_ledger(spark, str(tmp_path / "ledger")).collect()} == {r.hex_id for r in rows.collect()}
    assert registry.reserved_ids(spark.read.text(str(tmp_path / "ledger")), numbered).count() == 2
    single = tmp_path / "single"
    single.mkdir()
    (single / "k.json").write_text(json.dumps({"session_id": "x", "original_filename": "f", "created_at": "1", "replacement_map": {"a": "[ID_3A4F9C2B1D0E]"}}, indent=1))
    (single / "bad.json").write_text("{}")
    assert [(r.name, r.format) for r in keys.recent_keys(keys.read_keys(spark, str(single))).collect()] == [("k.json", "hex12")]
    name = spark.createDataFrame([("list_anon_0f3e5d7c (2).csv",)], "n string").select(sinks.output_name(F.col("n"), None)).first()[0]
    assert name == "list_restored.csv"


def test_keys_are_numbered_by_age(spark):
    rows = [("b", "2024-02-01"), ("a", "2024-02-01"), ("c", None), ("d", "2024-01-01"), ("a", "2024-02-01"), ("c", None)]
    out = keys.numbered(spark.createDataFrame(rows, "session_id string, created_at string"))
    assert [(r.session_id, r.key_no) for r in out.orderBy("key_no").collect()] == [("c", 1), ("c", 2), ("d", 3), ("a", 4), ("a", 5), ("b", 6)]
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_stream(spark, tmp_path):
    rows = [(1, "a@example.com a@example.com", "2024-01-01 00:00:00"), (2, "a@example.com b@example.com", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(tmp_path / "in"))
    query = stream.first_seen(source, ["EMAIL"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.value for r in spark.sql("select value from seen").collect()) == ["a@example.com", "b@example.com"]


def test_a_rosters_key_has_its_identities(spark, tmp_path):
    from maskwright.operators import cells as C

    cells = spark.createDataFrame([(1, 0, 1, 0, "Ann Lee"), (1, 0, 2, 0, "=A1"), (1, 0, 3, 0, "changed")], "doc_id long, sheet int, row int, col int, value string")
    over = spark.createDataFrame([(1, 0, r, 0, v, "[I1]") for r, v in ((1, "Ann Lee"), (2, "=A1"), (3, "Tom"))], "doc_id long, sheet int, row int, col int, expected string, new string")
    done = C.apply_overrides(cells, over, forbidden=spark.createDataFrame([(1, 0, 2, 0)], "doc_id long, sheet int, row int, col int"))
    assert {r.row: (r.value, r.overridden, r.skipped) for r in done.collect()} == {1: ("[I1]", True, False), 2: ("=A1", False, True), 3: ("changed", False, True)}
    rows = spark.createDataFrame([(1, "Bob", "PERSON", "0A1B2C3D4E5F", "[PERSON_0A1B2C3D4E5F]"), (2, "Eve", "PERSON", "1A1B2C3D4E5F", "[PERSON_1A1B2C3D4E5F]")], "doc_id long, original string, tag string, hex_id string, placeholder string")
    rows = rows.selectExpr("*", "array(tag) as types", "cast(null as string) as linked_to")
    sessions = spark.createDataFrame([(1, "s1", "a.csv", "2024"), (2, "s2", "b.csv", "2024")], "doc_id long, session_id string, original_filename string, created_at string")
    people = spark.createDataFrame([(1, "I1", "person", "Ann Lee", None)], "doc_id long, community_id string, kind string, display string, family string")
    titles = spark.createDataFrame([(1, "PERSON_2A1B2C3D4E5F", "Eve's")], "doc_id long, written string, original string")
    columns = spark.createDataFrame([(1, 0, 4, 0, "Family id")], "doc_id long, sheet int, col int, header_row int, header string")
    built = keys.build_keys(rows, sessions, people, C.written_cells(done, over), columns, titles)
    sinks.write_keys(built, str(tmp_path / "keys"))
    read = {r.session_id: r for r in keys.read_keys(spark, str(tmp_path / "keys")).collect()}
    assert read["s1"].identity_registry["I1"].display == "Ann Lee" and read["s2"].identity_registry is None
    assert [tuple(c) for c in read["s1"].identity_cells] == [(0, 1, 0, "[I1]", "Ann Lee")]
    assert [tuple(c) for c in read["s1"].identity_columns] == [(0, 4, 0, "Family id")]
    ids = registry.reserved_ids(None, keys.read_keys(spark, str(tmp_path / "keys")))
    assert {r.hex_id for r in ids.collect()} == {"0A1B2C3D4E5F", "1A1B2C3D4E5F", "2A1B2C3D4E5F"}


def test_a_blank_line_keeps_its_row_number(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"Name,Phone\n\nAnn,1\n")
    found = files.cells(files.read_files(spark, str(tmp_path))).collect()
    assert sorted((r.row, r.col, r.value) for r in found) == [(0, 0, "Name"), (0, 1, "Phone"), (1, 0, ""), (2, 0, "Ann"), (2, 1, "1")]


def test_no_name_is_written_twice(spark):
    names = spark.createDataFrame([(1, "a.csv"), (2, "a.csv"), (3, "a.csv"), (4, "a_1.csv"), (5, "b"), (6, "c.csv"), (7, "a_1.csv")], "doc_id long, name string")
    taken = spark.createDataFrame([("b",), ("b_1",), ("b_3",), ("a_3.csv",), ("a_3.txt",)], "name string")
    free = {r.doc_id: r.free for r in sinks.free_names(names, taken).collect()}
    assert free == {1: "a.csv", 2: "a_2.csv", 3: "a_4.csv", 4: "a_1.csv", 5: "b_2", 6: "c.csv", 7: "a_1_1.csv"}
    assert sinks.free_names(names.filter("false"), taken).count() == 0


def test_counts_of_a_stream_by_window(spark, tmp_path):
    rows = [(1, "a@example.com b@example.com", "2024-01-01 00:01:00"), (2, "a@example.com", "2024-01-01 00:12:00"), (3, "x", "2024-01-01 09:00:00")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    for k in (1, 2, 3):
        frame.filter(f"doc_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.counts_by_window(source, ["EMAIL"]).writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.tag, r.n) for r in spark.sql("select tag, n from windows").collect()) == [("EMAIL", 1), ("EMAIL", 2)]
