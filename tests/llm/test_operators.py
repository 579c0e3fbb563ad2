"""Each operator against brute force or a round trip on small data."""

import hashlib
import pathlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from maskwright.llm import common, decontamination, exact_dedup, licenses, minhash, packing, quality, queries, substring_dedup, toxicity, urls, warc
from maskwright.llm.common import Words, ngrams, scratch_path
from maskwright.llm.components import connected_components

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = connection.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def shingles(text, k):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent", "bucket"), [(3, 85, 32), (5, 80, 32), (3, 85, 2)])
def test_near_components_are_exact(spark, monkeypatch, k, percent, bucket):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", bucket)
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 150))]
        texts += [edited(rng, base, rng.randint(0, max(1, len(base) // 18))) for _ in range(25)]
    texts += ["a", "a", "A b", "", "  \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in minhash.near_components(df, words=k, percent=percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == near_brute(texts, k, percent)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t, k)) for t in texts]


@pytest.mark.parametrize("turns", [1, 3])
def test_star_turns_lose_no_link(spark, monkeypatch, turns):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    rng = random.Random(16)
    texts = []
    for size in (12, 25, 60, 150):
        base = [f"w{rng.randrange(300)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randint(0, max(1, size // 10))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = common.written(minhash.sketches(df, 3, minhash.least_linked(85), minhash.BANDS, minhash.ROWS, minhash.MINIMA), "sketches")
    found = minhash.cluster(rows, lambda ids: minhash.full_sets(df, ids, 3), 85, turns=turns)
    got = {r.doc_id: r.component for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == near_brute(texts, 3, 85)


def test_pairs_of_near_copies_grow_in_proportion(spark, monkeypatch):
    made = []
    for name in ("by_difference", "_across"):

        def counted(*args, plain=getattr(minhash, name)):
            found = plain(*args)
            made[-1] += found.count()
            return found

        monkeypatch.setattr(minhash, name, counted)
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [" ".join(base), *(edited(rng, base, rng.randint(1, 16)) for _ in range(599))]
    for size in (150, 600):
        made.append(0)
        df = spark.createDataFrame(list(enumerate(texts[:size])), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash.near_components(df, words=3, percent=85).collect()}
        assert [got[i] for i in range(size)] == near_brute(texts[:size], 3, 85)
    assert 0 < made[0] and made[1] <= 6 * made[0]


def test_hot_keys_are_dealt_to_several_tasks(spark):
    from maskwright.llm import common

    rows = spark.range(3000).selectExpr("if(id < 2000, 0, id) as k", "id as v")
    one = spark.range(2900).selectExpr("id as k", "id * 2 as w")
    got = sorted((r.k, r.v, r.w) for r in common.meet(rows, one, ["k"], "v", hot=300).collect())
    assert got == sorted((0 if i < 2000 else i, i, 0 if i < 2000 else 2 * i) for i in range(2900))


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared in (0, 500, 800, 1000):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - shared : 2000 - shared])
        x, y = minhash.packed(minhash.minima(a)), minhash.packed(minhash.minima(b))
        nibbles = lambda v: [(int(w) >> s) & 15 for w in v for s in range(0, 64, 4)]
        agree = np.mean([p == q for p, q in zip(nibbles(x), nibbles(y), strict=True)])
        assert abs((agree - 1 / 16) / (15 / 16) - shared / (2000 - shared)) < 0.2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngrams_of_short_texts():
    w = Words(pa.array(["a b c d", "", "a b", None, " A\tB\x0b"]))
    grams, offsets = ngrams(w.hashes(), w.offsets, 3)
    assert list(np.diff(offsets)) == [2, 0, 1, 0, 1] and grams[2] == grams[3]
    sliced = Words(pa.array(["zz yy"] * 50 + ["A b", "c"]).slice(50))
    assert sliced.dictionary == ["a", "b", "c"]


def test_substring_dedup_finds_shared_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, other = " ".join(word() for _ in range(55)), [word() for _ in range(70)]
    texts = [" ".join([*(word() for _ in range(40)), passage, *(word() for _ in range(60))]) for _ in range(8)]
    texts += [" ".join(word() for _ in range(120)) for _ in range(8)]
    near = list(other)
    near[30] = "changed"
    texts += ["\n".join([" ".join(other), word()]), "\n".join([word(), " ".join(near)]), "", "short line", "short line"]
    found = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    passages = {r.doc_id for r in found if r.unit == "passage"}
    assert set(range(8)) <= passages and not passages & set(range(8, 16))
    lines = {r.doc_id: (r.class_id, r.kept) for r in found if r.unit == "line"}
    assert lines == {16: (16, True), 17: (16, False)}
    assert [r.doc_id for r in found if r.unit == "passage" and r.kept and r.doc_id < 8] == [0]


def test_every_repeated_block_keeps_one_document(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    fill = lambda n: [word() for _ in range(n)]
    a, b, shared, rest = fill(60), fill(60), fill(60), fill(80)
    texts = {1: [*fill(30), *a, *fill(30)], 5: [*a, *b], 9: [*fill(30), *b, *fill(30)], 11: [*fill(30), *shared, *fill(30)], 15: [*shared, *rest], 22: [*shared, *rest]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    removed = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        if not r.kept:
            removed.setdefault(r.doc_id, set()).update(range(r.at, r.at + r.words))
    assert {5, 9, 15, 22} == set(removed) and removed[22] == set(range(140))
    left = lambda doc, piece: [w for k, w in enumerate(texts[doc]) if k not in removed.get(doc, ()) and w in piece]
    assert left(1, a) == a and left(5, b)[-40:] == b[-40:] and left(15, rest)[-70:] == rest[-70:]
    blocks = {}
    for r in substring_dedup.blocks(docs).collect():
        blocks.setdefault(r.key, {}).setdefault(r.doc_id, []).append(not removed.get(r.doc_id, set()) & set(range(r.begin, r.begin + r.size)))
    assert all(any(all(x) for x in found.values()) for found in blocks.values() if len(found) > 1)


def test_repeats_within_one_document(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    fill = lambda n: [word() for _ in range(n)]
    part = fill(60)
    twice, line = [*fill(30), *part, *fill(40), *part, *fill(20)], " ".join(fill(25))
    docs = [(3, " ".join(twice)), (4, " ".join(fill(200))), (5, "\n".join([line, word(), line])), (6, " ".join(fill(90)))]
    docs += [docs[3]]  # a repeated row is no repeat
    found = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    passages = sorted((r.at, r.kept) for r in found if r.unit == "passage" and r.doc_id == 3)
    assert [kept for _, kept in passages] == [True, False] and 30 <= passages[0][0] < 60 and passages[1][0] == passages[0][0] + 100
    assert sorted((r.at, r.kept) for r in found if r.unit == "line") == [(0, True), (2, False)] and {r.doc_id for r in found} == {3, 5}


def test_recall_of_lines_and_passages(spark):
    frame = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "text"]].head(400)
    found = substring_dedup.substring_dedup(spark.createDataFrame(frame)).collect()
    lines = {(d, k): shingles(x, 5) for d, text in zip(frame["doc_id"], frame["text"], strict=True) for k, x in enumerate((text or "").split("\n")) if len(x.split()) >= 20}
    by_gram, near = {}, set()
    for at, grams in lines.items():
        for g in grams:
            by_gram.setdefault(g, []).append(at)
    for at, grams in lines.items():
        for other in {o for g in grams for o in by_gram[g]} - {at}:
            both = len(grams & lines[other])
            if 100 * both >= 80 * (len(grams) + len(lines[other]) - both):
                near.add(at)
    got = {(r.doc_id, r.at) for r in found if r.unit == "line"}
    assert near and len(got & near) >= 0.98 * len(near) and got <= near
    runs, repeated = {}, set()
    for d, text in zip(frame["doc_id"], frame["text"], strict=True):
        w = (text or "").lower().split()
        for i in range(len(w) - 59):
            runs.setdefault(tuple(w[i : i + 60]), set()).add(d)
    for docs in runs.values():
        if len(docs) > 1:
            repeated |= docs
    assert repeated and len(repeated & {r.doc_id for r in found if r.unit == "passage"}) >= 0.98 * len(repeated)


def test_blocks_are_cut_and_keyed_alike_in_any_batch():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 9, 400).astype(np.uint64)
    offsets = np.array([0, 0, 1, 150, 150, 400])
    begin = substring_dedup.block_starts(words, offsets)
    end = np.append(begin[1:], len(words))
    keys = substring_dedup.block_keys(words, begin, end)
    alone = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        at = substring_dedup.cuts(words[a:b])
        alone += [(a + x, int(k)) for x, k in zip(at[:-1], substring_dedup.block_keys(words[a:b], at[:-1], at[1:]), strict=True)]
    assert alone == list(zip(begin.tolist(), keys.tolist(), strict=True))
    by = {}
    for a, b, k in zip(begin, end, keys, strict=True):
        assert by.setdefault(int(k), words[a:b].tolist()) == words[a:b].tolist()


def test_cuts_depend_on_their_surroundings_alone():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, 60).astype(np.uint64)
    seen = []
    for _ in range(5):
        before = rng.integers(0, 2**63, int(rng.integers(0, 50))).astype(np.uint64)
        at = substring_dedup.cuts(np.concatenate([before, passage, rng.integers(0, 2**63, 20).astype(np.uint64)])) - len(before)
        seen.append([x for x in at if 6 <= x <= 50])
    assert len(seen[0]) >= 2 and all(x == seen[0] for x in seen)


def held_out(parts, fold, frame):
    return frame["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % parts == fold)


@pytest.mark.parametrize(("name", "label", "parts", "fold", "least"), [("op3_toxicity", "toxic", 5, 0, 0.85), ("op6_quality", "quality", 4, 2, 0.95)])
def test_classifiers_on_held_out_rows(spark, name, label, parts, fold, least):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert (got["held_out"] == held_out(parts, fold, got)).all() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= (0.5 if label == "toxic" else 0.7)).astype(int)).all()
    known = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    test = known[known["held_out"]]
    rank, y = test["score"].rank(), test[label]
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert len(got) == 10_000 and auc > least
    assert (test["predicted"] == y).mean() > 0.93


def test_thresholds_by_language():
    model = toxicity.train(*toxicity.word_buckets(pa.array(["good day"] * 30 + ["bad day"] * 30)), np.array([0] * 30 + [1] * 30))
    toxicity.calibrate(model, *toxicity.word_buckets(pa.array(["good day"] * 25 + ["bad day"] * 25)), np.array([0] * 25 + [1] * 25), ["en"] * 50)
    assert 0 < model.threshold("en") < 1 and model.threshold("xx") == model.default
    s = model.scores(model.responses(*toxicity.word_buckets(pa.array(["good day", "bad day", "", None])))[0])
    assert s[1] > model.threshold("en") > s[0] and s[2] == s[3]


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(quality.FEATURES)))
    x[:, 0], x[:, 1] = rng.random(3000), rng.random(3000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9 and (0, 1) in model.pairs


def test_warc_rejects_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/", "x" * 120), (2, "http://b/", "x" * 120), (3, "http://c/", inner * 3), (4, None, None), (5, "http://e/\r\nX: 1", "é" * 60), (6, "u", "short"), (7, "u", "short"), (8, "http://h/", "x" * 120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.records(df), path, file_records=2)
    assert warc.candidates(spark, path).filter("page_id = 99").count() == 3
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == set(range(1, 9)) and all(r.sound for r in got.values())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.refers_to} == {2: ("revisit", 1), 8: ("revisit", 1)}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_a_chain_that_breaks_is_an_error(spark, tmp_path):
    record = lambda i, size: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(b'abc').hexdigest()}\r\nContent-Length: {size}\r\n\r\nabc\r\n\r\n"
    for name, sizes in (("good", [3] * 5), ("bad", [3, 3, 4, 3, 3])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_text("".join(record(i, n) for i, n in enumerate(sizes)), newline="")
    assert {r.page_id for r in warc.read_archives(spark, str(tmp_path / "good")).collect()} == set(range(5))
    with pytest.raises(ValueError, match="followed to the end"):
        warc.read_archives(spark, str(tmp_path / "bad"))
    found = warc.reachable(warc.candidates(spark, str(tmp_path / "bad")))
    assert {r.page_id for r in found.collect()} == {0, 1} and warc.broken(spark, str(tmp_path / "bad"), found).count() == 1


def test_pointer_jumping():
    at, after = np.array([0, 10, 15, 30, 44]), np.array([10, 30, 44, 60, 7])
    assert warc.reached(at, after).tolist() == [True, True, False, True, False]
    assert warc.reached(np.zeros(0, int), np.zeros(0, int)).tolist() == []
    long = np.arange(5000) * 7
    assert warc.reached(long[::-1], long[::-1] + 7).all()


def test_trust_flows_along_links_and_distrust_against_them(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p?q">t</a>' for h in hosts)
    pages = [(1, "http://good.org/", link("friend.net")), (2, "http://friend.net/x", link("far.net")), (3, "http://far.net/", ""), (4, "http://bad.com/de/1", ""), (5, "http://shill.net/", link("bad.com", "far.net")), (6, "http://alone.net/", None), (7, None, "x"), (8, "no scheme", ""), (9, "HTTP://EXAMPLE.ORG/es/1#f", ""), (10, "http://a.example.org/en/12", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    assert got[9].host == "example.org" and got[9].rule == "example.org/es/" and got[7].host == "" and got[5].rule is None
    links = {"good.org": ["friend.net"], "friend.net": ["far.net"], "shill.net": ["bad.com", "far.net"]}
    hosts = ["good.org", "friend.net", "far.net", "bad.com", "shill.net"]
    trust = dict.fromkeys(hosts, 0.0)
    start = {"good.org": 1.0}
    trust |= {h: 0.15 * s for h, s in start.items()}
    for _ in range(urls.ROUNDS):
        new = {h: 0.15 * start.get(h, 0) for h in hosts}
        for src, out in links.items():
            for dst in out:
                new[dst] += 0.85 * trust[src] / len(out)
        trust = new
    assert all(abs(next(r.trust for r in got.values() if r.host == h) - trust[h]) < 1e-12 for h in hosts)


def test_shares_reach_the_end_of_long_chains(spark):
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(15)], "src string, dst string")
    got = {r.host: r.trust for r in urls.propagate(links, spark.createDataFrame([("h0", 1, 0)], "host string, allowed long, blocked long")).collect()}
    assert set(got) == {f"h{i}" for i in range(16)} and all(abs(got[f"h{i}"] - 0.15 * 0.85**i) < 1e-12 for i in range(16))


def smith_waterman(a, b, match=2, miss=-1, gap=-1):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (match if x == y else miss), table[i - 1][j] + gap, table[i][j - 1] + gap)
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64)
        score, best, begin, end = decontamination.align(a, b)
        assert best == smith_waterman(a.tolist(), b.tolist()) and abs(score - best / (2 * len(a))) < 1e-12
        if best:
            assert smith_waterman(a.tolist(), b[begin:end].tolist()) == best


def test_copies_of_benchmark_items_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randint(20, 40)))) for i in range(12)] + [(50, "two words"), (51, ""), (None, "x y z w v")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(100)]
        if i < 36:
            w = items[i % 12][1].split()
            for k in range(4, len(w) if i >= 12 else 0, (1, 9, 7)[i // 12]):  # whole, and edited copies
                w[k] = word()
            body[50:50] = w
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "says two words"), (102, "says two words")]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(i, i % 12) for i in range(36)}
    assert all(got[i, i].score == 1.0 and (got[i, i].begin, got[i, i].end) == (50, 50 + got[i, i].item_words) for i in range(12))


@pytest.mark.parametrize("step", [5, 6])
@pytest.mark.parametrize("beside", [False, True])
def test_copies_with_every_fifth_or_sixth_word_changed(spark, step, beside):
    rng = random.Random(step)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [(i, " ".join(word() for _ in range((17, 30)[i % 2]))) for i in range(10)]
    docs = []
    for i, text in items:
        w = text.split()
        w[step - 1 :: step] = [word() for _ in w[step - 1 :: step]]
        docs.append((i, " ".join([*(word() for _ in range(60)), *w, *(word() for _ in range(60))])))
    docs += [(100 + i, text) for i, text in items if beside]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i + j, i) for i in range(10) for j in ((0, 100) if beside else (0,))}


def test_bound_of_alignments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = rng.integers(0, 9, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 9, rng.integers(0, 9)).astype(np.uint64)
        assert decontamination.bound(a, np.unique(b)) >= decontamination.align(a, b)[0]


def test_license_texts_and_lines(spark):
    mit = next(t for t in licenses.NOTICES["MIT"] if t.startswith("MIT License"))
    texts = ["// MIT LICENCE\n// Copyright (c) 2020 Someone\n" + mit.partition("\n")[2].upper(), "Text\n  * released under the mit license *\nmore", "Released under the MIT License of words", None, "", "Copyright 2020 X"]
    got = {(r.doc_id, r.unit, r.license, r.units) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, "text", "MIT", 1), (1, "line", "MIT", 1)}


def test_entire_licences_and_rewrapped_ones(spark):
    bsd = next(t for t in licenses.NOTICES["BSD-3-Clause"] if len(t) > 200)
    words = bsd.split()
    at = next(i for i, w in enumerate(words) if w == "COPYRIGHT" and words[i + 1] == "HOLDERS")
    rewrapped = " ".join(words[:at]) + "\n" + " ".join(words[at:])
    texts = [rewrapped, "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + rewrapped, "copyright holders be liable"]
    names = [*["BSD-3-Clause"] * 2, None]
    folder = pathlib.Path("/usr/share/common-licenses")
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3"), ("MPL-2.0", "MPL-2.0")):
        if (folder / file).exists():
            texts.append((folder / file).read_text().upper().replace("\n", "\r\n  "))
            names.append(name)
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.unit == "text"}
    assert got == {i: name for i, name in enumerate(names) if name}


def test_licences_under_any_heading(spark):
    mit = next(t for t in licenses.NOTICES["MIT"] if t.startswith("MIT License"))
    body = mit.partition("\n")[2].lstrip()
    heads = ["MIT License\n\nCopyright Jane Doe\n\n", "The MIT License (MIT)\n\nCopyright (c) 2020 Jane\n\n", "", "Copyright Jane Doe <j@x.org>\nAll rights reserved.\n", "Copyright 2020 A\nThe MIT License\nCopyright B\n"]
    texts = [h + body for h in heads] + ["Copyright Jane Doe\nsome other words\nand more"]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.unit == "text"}
    assert got == dict.fromkeys(range(len(heads)), "MIT")


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    fill = lambda n: [word() for _ in range(n)]
    part, unique = fill(60), fill(120)
    texts = [(1, [*part, *fill(40)]), (5, [*fill(60), *part, *fill(20)]), (5, unique), (5, unique), (6, fill(90))]
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts], "doc_id long, text string")
    found = substring_dedup.substring_dedup(docs).collect()
    assert {(r.doc_id, r.kept) for r in found} == {(1, True), (5, False)} and len({r.row_key for r in found if r.doc_id == 5}) == 1
    (gone,) = [r for r in found if not r.kept]
    # only what stands in document 1 too is removable
    assert gone.at >= 60 and gone.at + gone.words <= 120 and gone.words >= 30


def test_items_that_repeat_an_id_are_both_found(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    one, two = [" ".join(word() for _ in range(25)) for _ in range(2)]
    docs = spark.createDataFrame([(1, f"x y {one} z"), (2, f"{two} w"), (3, " ".join(word() for _ in range(80)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, one), (7, two), (7, two), (8, one)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 7): 1.0, (1, 8): 1.0, (2, 7): 1.0}


def test_recall_against_every_alignment(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    head = [word() for _ in range(10)]
    items = [[*head, *(word() for _ in range(20))] if i % 3 == 0 else [word() for _ in range(rng.randint(12, 40))] for i in range(30)]
    docs = []
    for _ in range(120):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, len(w) // 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [word()], [word(), w[k]]])
            w = w or [word()]
        docs.append([*(word() for _ in range(rng.randint(0, 30))), *w, *(word() for _ in range(rng.randint(0, 30)))])
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if smith_waterman(item, text) >= len(item)}
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got <= want and len(want) > 80 and len(got) >= 0.9 * len(want)


def test_cuckoo_shard_against_a_dict():
    rng = random.Random(8)
    shard, live = exact_dedup.CuckooShard(4), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(900)]
    for _ in range(6000):
        k = rng.choice(keys)
        if k in live and rng.random() < 0.4:
            assert shard.delete(k)
            del live[k]
        elif k not in live:
            assert shard.find(k) is None
            shard.insert(k, [1, 1, 1])
            live[k] = True
    assert shard.resizes and all(shard.find(k) for k in live) and not any(shard.find(k) for k in keys if k not in live)
    assert not shard.delete(b"\0" * 32)


def test_index_lives_with_its_rows(spark):
    df = lambda *x: exact_dedup.digests(spark.createDataFrame(list(x), "doc_id long, text string"))
    index = exact_dedup.build_index(df((1, "a b"), (2, "ab"), (3, "c")), 3)
    later = exact_dedup.update_index(index, df((4, "c"), (5, "d")), df((1, "a b"), (3, "c"), (9, "zz")), 3)
    assert sorted((r.n, r.keep_id) for r in later.collect()) == [(1, 1), (1, 3), (1, 5)]
    gone = exact_dedup.update_index(later, None, df((2, "ab"), (5, "d")), 3)
    assert sorted(r.n for r in gone.collect()) == [1]


def test_copies_meet_in_the_index_and_keepers_are_replaced(spark, monkeypatch):
    rows = exact_dedup.digests(spark.createDataFrame([(i, "a b" if i % 2 else f"t{i}") for i in range(200)], "doc_id long, text string").repartition(8))
    found = exact_dedup.changes(rows, 1).collect()
    assert sum(r.n for r in found) == 200 and sum(r.n for r in found if r.n > 1) > 50 and len({r.digest for r in found}) == 101 < len(found)
    assert {(r.n, r.keep_id) for r in exact_dedup.build_index(rows, 1).collect() if r.n > 1} == {(100, 1)}
    gone, left = rows.filter("doc_id < 20"), rows.filter("doc_id >= 20")
    index = exact_dedup.build_index(rows, 3)
    after = exact_dedup.update_index(index, None, gone, 3, live=left)
    want = exact_dedup.build_index(left, 3)
    key = lambda df: sorted((bytes(r.digest), r.n, r.keep_id, r.code_points) for r in df.collect())
    assert key(after) == key(want)


def test_hot_groups_join_by_broadcast(spark, monkeypatch):
    from maskwright.llm import common

    left = spark.range(1000).selectExpr("id", "if(id < 400, 0, id) as k")
    groups = left.groupBy("k").count()
    got = common.attach(left, groups, ["k"], "count", hot=50)
    assert sorted((r.id, r["count"]) for r in got.collect()) == [(i, 400 if i < 400 else 1) for i in range(1000)]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [r["text"] for r in pd.read_parquet(f"{SF}/documents.parquet").to_dict("records")] + ["", None, "Don't STOP <|endoftext|> it's 12,345.6 ΑΣ café café İ d'être x\x1cy ①\x85z", "word " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(df, path).toPandas().sort_values(["doc_id", "piece"])
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"] == i]
        assert own["length"].sum() == len(ids) and list(own["start"]) == list(range(0, len(ids), 4096))
        assert list(own["ids_crc32"]) == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in range(0, len(ids), 4096)]
    total = 0
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq["offset"]) == [0, *seq["length"].cumsum()[:-1]] and seq["length"].sum() <= 4096
        total += 1
    assert total == -(-got["length"].sum() // 4096)


def test_two_documents_replace_the_smallest():
    # 60 and 30 leave 10; 21 and 19 fill what 30 and the gap make room for
    sequence, offset = packing.best_two_fit([60, 30, 21, 19], 100)
    assert sequence == [0, 1, 0, 0] and sorted(o for s, o in zip(sequence, offset, strict=True) if s == 0) == [0, 60, 81]
    assert packing.best_two_fit([], 10) == ([], [])
