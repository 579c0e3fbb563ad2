"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import decontamination, exact_dedup, licenses, minhash, packing, quality, substring_dedup, toxicity, urls, warc
from maskwright.llm.common import scratch_path

CLASHING = "key digest node component shard n score words id at value signature bands copies own rule ruled pages found seq seeds grams held_out lines"
LONG = "long text " * 30_000
ROWS = [(1, "same text here", "en"), (1, "same text here", "en"), (2, "same text here", None), (None, "same text here", "en"), (3, None, "de"), (4, "", "xx"), (5, " \n\t", "en"), (6, LONG, "en"), (7, "one", "fr")]


def with_clashes(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING.split()))


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return with_clashes(df)


def pages(spark, empty=False):
    df = spark.createDataFrame([(1, "http://a.org/x", "h" * 200), (1, "http://a.org/x", "h" * 200), (2, None, None), (None, "x", "h" * 200), (3, "://", ""), (4, "HTTP://B.com/de/", LONG)], "page_id long, url string, html string")
    return with_clashes(df.limit(0) if empty else df)


def labels(spark, empty=False):
    df = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 6, 7)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return df.limit(0) if empty else df


OPERATORS = {
    "near": lambda s, d, e: minhash.near_components(d),
    "substring": lambda s, d, e: substring_dedup.substring_dedup(d),
    "toxicity": lambda s, d, e: toxicity.score(d, toxicity.fit(d, labels(s, e))),
    "quality": lambda s, d, e: quality.score(d, quality.fit(d, labels(s, e))),
    "decontamination": lambda s, d, e: decontamination.contaminated(d, s.createDataFrame([(1, "same text here"), (2, None), (3, "")], "item_id long, text string")),
    "licenses": lambda s, d, e: licenses.scan(d),
    "exact": lambda s, d, e: exact_dedup.exact_dedup(d),
    "packing": lambda s, d, e: corpus_pipeline.pack(s, d, ""),
    "urls": lambda s, d, e: urls.judge(pages(s, e)),
    "warc": lambda s, d, e: warc.round_trip(pages(s, e), scratch_path(s, "warc")),
}
#: Rows of each on ROWS, or None where they are checked below.
COUNTS = {"near": 9, "toxicity": 9, "quality": 9, "exact": 9, "urls": 6, "warc": 6, "licenses": 0, "decontamination": 2}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, documents(spark), False).collect()
    if name in COUNTS:
        assert len(got) == COUNTS[name]
    if name == "near":
        by = sorted((r.doc_id or 0, r.component_id, r.n_shingles, r.kept) for r in got)
        assert by[0] == (0, None, 1, True) and by[1:4] == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)] and by[4] == (3, 3, 0, True)
    if name == "exact":
        by = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got}
        assert {(1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (3, 3, 3, True), (5, 5, 3, True)} & by == {(1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (5, 5, 3, True)}
    if name in ("toxicity", "quality"):
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        # the text alone decides: null and empty ones alike, repeated rows alike
        assert by[3] == by[4] and (name == "quality" or by[4] == by[5]) and by[1] == by[2] == by[None] and all(len(x) == 1 and 0 <= min(x) <= 1 for x in by.values())
    if name == "urls":
        assert sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in got) == [
            (0, "", None, "allow"), (1, "a.org", "org/", "allow"), (1, "a.org", "org/", "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "b.com", "com/de/", "block"),
        ]
    if name == "substring":
        assert all(r.doc_id == r.row_key for r in got) and {r.doc_id for r in got} <= {6}
    if name == "packing":
        assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6, 7} and sum(r.doc_id == 1 for r in got) == 2
    if name == "decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1)}
    if name == "warc":
        assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response"), (1, "response"), (1, "response"), (2, "response"), (3, "response"), (4, "response")]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, documents(spark).limit(0), True).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, tmp_path, k):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this kind stands in any document")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    docs = documents(spark)
    out = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    want = {"toxicity": None, "exact_dedup": {1, 5, 6, 7} | {None}, "near_dedup": {None, 1, 3, 4, 5, 6, 7}, "decontamination": {None, 1, 2, 3, 4, 5, 6, 7}, "packing": {None, 1, 2, 3, 4, 5, 6, 7}}[name]
    assert want is None or ids == want
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_decide_row_by_row(spark, tmp_path):
    near = " ".join(f"w{i}" for i in range(60))
    item = "seven plain words stand in this item"
    rows = [(0, "b b b"), (1, "only one"), (1, "b b b"), (1, "only one"), (2, near), (3, near + " more"), (3, "unlike the others"), (4, f"so {item} then"), (4, "clean"), (None, "b b b"), (None, near + " too"), (None, "b b b")]
    docs = documents(spark, [(*r, "en") for r in rows])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    left = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect())
    every = sorted((-1 if d is None else d, t) for d, t in rows)
    want = list(every)
    want.remove((1, "b b b"))
    want.remove((1, "only one"))
    assert left(stages["exact_dedup"](spark, docs, "")) == want
    got = left(stages["near_dedup"](spark, docs, ""))
    # equal texts are one set; which of the two rows of a pair stays depends on their ids
    assert len([r for r in got if r[1] == "b b b" and r[0] >= 0]) == 1 and len([r for r in got if r[0] in (2, 3) and r[1].startswith(near)]) == 1
    assert [r for r in got if r[0] == -1 or r[1] in ("only one", "unlike the others", "clean")] == [r for r in every if r[0] == -1 or r[1] in ("only one", "unlike the others", "clean")]
    assert left(stages["decontamination"](spark, docs, str(tmp_path))) == [r for r in every if r != (4, f"so {item} then")]


def test_pipeline_against_brute_force(spark, tmp_path):
    import random
    import re

    import public_tokenizers
    from test_operators import edited, near_brute, smith_waterman
    from tokenizers import Tokenizer

    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [[word() for _ in range(rng.randint(12, 30))] for _ in range(6)]
    texts = []
    for k in range(90):
        body = [word() for _ in range(rng.randint(30, 80))]
        if k % 9 == 0:
            w = list(items[k // 9 % 6])
            for _ in range(k % 2):  # four words in a row are left
                w[rng.randrange(len(w))] = word()
            body[20:20] = w
        texts.append(" ".join(body))
    texts += [t.replace(" ", "  ", rng.randint(0, 4)) for t in texts[:20]]  # equal but for white space
    texts += [edited(rng, texts[k].split(), rng.randint(0, 3)) for k in range(20, 60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark, empty=True).write.parquet(str(tmp_path / "labels.parquet"))  # nothing is learnt, so nothing is toxic
    best = {}
    for i, t in enumerate(texts):
        best.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), i))
    kept = sorted(min(group)[1] for group in best.values())
    root = near_brute([texts[i] for i in kept], 5, 80)
    kept = [i for k, i in enumerate(kept) if root[k] == k]
    kept = [i for i in kept if not any(smith_waterman(w, texts[i].split()) >= len(w) for w in items)]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(out["doc_id"]) == kept and 60 < len(kept) < len(texts)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert dict(zip(out["doc_id"], out["length"], strict=True)) == {i: len(plain.encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept}


def test_pipeline_runs_its_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert out.columns.tolist() == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert set(out["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()}
    # what a brute-force pass removes is gone: equal texts and contaminated ones
    texts = {}
    for r in docs.collect():
        assert texts.setdefault("".join(r.text.split()), r.doc_id) == r.doc_id
