"""Lexical search, quality rules and conversation repair against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from maskwright.llm import conversations, lexical, ngram_rules, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def ranked(docs, items, top):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            s = sum(weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize(("impacts", "block"), [(1 << 21, 4 << 20), (7, 40)])
def test_search_against_brute_force(spark, monkeypatch, impacts, block):
    monkeypatch.setattr(lexical, "IMPACTS", impacts)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = random.Random(3)
    word = lambda: rng.choice(["The", "é", "Été9", "x_y", "a-b", "42", "ß", "\x1cz", "rare" + str(rng.randrange(30))])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "-- ..."), (7, docs[7][1]), (None, "rare1 rare2"), (None, None), (300, "rare1 " * 400)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(12)] + [(50, None), (51, ""), (None, "rare1 rare1 Rare2"), (60, "rare3 rare4"), (60, "rare3 rare4"), (61, "nowhere")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string").repartition(6)
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), top=5).collect()
    want = ranked(docs, [x for x in dict.fromkeys(items) if x[1]], 5)
    assert sorted(map(repr, ((r.item_id, r.rank, r.doc_id, r.score) for r in got))) == sorted(map(repr, want))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0 and lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_radix_order():
    rng = np.random.default_rng(0)
    for top in (1, 300, 1 << 17, 1 << 40, 1 << 63):
        keys = rng.integers(0, top, 500, np.uint64)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.uint64))) == 0


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rule_counts_against_brute_force():
    rng = random.Random(4)
    pieces = ["a b c d e", "x", "\n", "\n\n", " \t", "é%é", "#$ <b>", "a b c d e f", "\x1c", "the", "A"]
    texts = ["", None, " \n ", "a b c d a b c d", "a b c d e a b c d e", "l\nl\n l\n\n"] + ["".join(rng.choice(pieces) + rng.choice(" \n") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts.append("word " * 50_000)
    got = ngram_rules.counts(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [rule_counts(t) for t in texts]


def brute_scores(texts, trusted):
    """Scores by dictionaries of buckets."""
    grams = [[int(b) for b in ngram_rules.buckets(pa.array([t], pa.string()))[0]] for t in texts]
    for t, g in zip(texts, grams, strict=True):
        n = len(WORD.findall(t or ""))
        assert len(g) == n + (n - 1 if n > 1 else min(n, 1))
    every, good = Counter(b for g in grams for b in g), Counter(b for g, x in zip(grams, trusted, strict=True) for b in g if x)
    size, prior = sum(every.values()) + ngram_rules.BUCKETS, ngram_rules.PRIOR
    base = lambda b: (every[b] + 1) / size
    ratio = lambda b: math.log((good[b] + prior * base(b)) / (sum(good.values()) + prior)) - math.log(base(b))
    return [sum(map(ratio, g)) / (len(g) + ngram_rules.LIGHT) for g in grams]


def test_rules_against_brute_force(spark):
    rng = random.Random(5)
    good, bad = [f"w{k}" for k in range(60)], [f"q{k}" for k in range(60)]
    texts = [" ".join(rng.choice(good if i % 4 else bad) for _ in range(rng.randint(8, 90))) for i in range(400)]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[1], "x"), (500, None, "x"), (501, "", "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(7)
    trusted = spark.createDataFrame([(i,) for i in range(200) if i % 4] + [(None,), (1,)], "doc_id long")
    model = ngram_rules.fit(df, trusted)
    got = [r.asDict() for r in ngram_rules.judge(df, model).collect()]
    counted = [d is not None and d < 200 and d % 4 > 0 and zlib.crc32(str(d).encode()) % 5 > 0 for d, _, _ in docs]
    scores = brute_scores([t for _, t, _ in docs], counted)
    want = {}
    for (d, t, _), s in zip(docs, scores, strict=True):
        n = rule_counts(t)
        bad_base = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.setdefault(d, []).append((*n, bad_base, s, not bad_base and s >= model.threshold))
    assert len(got) == len(docs)
    for r in got:
        *n, failed, s, kept = want[r["doc_id"]][0]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == n and r["base_failed"] == failed
        assert abs(r["score"] - s) < 1e-9 and (r["kept"] == kept or abs(s - model.threshold) < 1e-9)
    fine = [r for r in got if not r["base_failed"] and r["doc_id"] is not None]
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in fine)


def test_rules_without_trusted_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b"), (3, None)], "doc_id long, text string")
    model = ngram_rules.fit(docs, docs.limit(0))
    assert model.threshold == 0 and {r.doc_id: r.kept for r in ngram_rules.judge(docs, model).collect()} == {1: True, 2: False, 3: False}
    assert ngram_rules.judge(docs.limit(0), ngram_rules.fit(docs.limit(0), docs)).count() == 0


def test_rules_keep_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op12_quality_rules"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    unseen = got[(got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0) & ~got["base_failed"]]
    assert unseen[unseen["quality"] == 1]["kept"].mean() > 0.99 and unseen[unseen["quality"] == 0]["kept"].mean() < 0.1


GRAMMAR = re.compile("(s?(ua)+)?")


def repaired(rows):
    """All ways of a small conversation, tried one after the other."""
    rows = sorted(((None if t is None else t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
    seen, turns, counts = set(), [], Counter()
    for _, role, text in rows:
        body = WORD.sub(lambda m: m[0], text)
        last = re.sub("[\x20\x09-\x0d]", "", body)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        turns.append((role, text, fault))
    firsts = [r[:1] for r, _, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
    best = []

    def go(k, state, cost, audit, said):
        if best and cost > best[0][0]:
            return
        for who, letter in (("user", "u"), ("assistant", "a")):
            if letter == "a" and state == "u" or letter == "u" and state != "u":
                if len(audit) - len(audit.rstrip("I")) < 2:
                    go(k, letter, cost + 2, audit + "I", [*said, f"{who}:"])
        if k == len(turns):
            if GRAMMAR.fullmatch("".join(x[0] for x in said)):
                best.append((cost, audit, said))
                best.sort(key=lambda x: x[:2])
                del best[1:]
            return
        role, text, fault = turns[k]
        go(k + 1, state, cost + 3, audit + "D", said)
        if fault in ("", "truncated"):
            extra = fault == "truncated"
            if role[:1] == "s" and state == "" or role[:1] == "u" and state != "u" or role[:1] == "a" and state == "u":
                go(k + 1, role[:1], cost + extra, audit + "K", [*said, f"{role}:{text}"])
            who = "assistant" if state == "u" else "user"
            go(k + 1, who[0], cost + 2 + extra, audit + "R", [*said, f"{who}:{text}"])

    go(0, "", 0, "", [])
    cost, audit, said = best[0]
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


@pytest.mark.parametrize("long", [5_000, 3])
def test_repairs_against_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(conversations, "LONG_TURNS", long)
    monkeypatch.setattr(conversations, "BLOCK_TURNS", 2)
    monkeypatch.setattr(conversations, "BATCH_TURNS", 40)
    rng = random.Random(6)
    chats = {}
    for k in range(120):
        role = lambda: rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
        text = lambda: rng.choice(["Hi.", "ok", "Why? ", "", " \n", None, "é!", "a.b", f"t{rng.randrange(99)}."])
        chats[k if k else None] = [(rng.choice([None, 1, 2, 3, 4, 9]), role(), text()) for _ in range(rng.randint(1, 6))]
    rows = [(k, *r, "x") for k, chat in chats.items() for r in chat]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(5)
    ids = spark.createDataFrame([(k,) for k in [*chats, 999, 999]], "conv_id long")
    got = {r.conv_id: tuple(r[1:]) for r in conversations.repair(df, ids).collect()}
    assert got.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {k: repaired(chat) for k, chat in chats.items()}


def test_damage_follows_the_crc(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "A. b!"), ("assistant", "c?"), (None, None)])] + [(None, None, "user", "z.")]
    want = Counter()
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fate:
            want[c, t, "user" if fate == 4 else r, "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x] += 2 if fate == 3 else 1
    got = Counter(tuple(r) for r in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == want and len({zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows[:-1]} & {0, 1, 2, 3, 4}) == 5


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(none).count() == 0 and conversations.repair(conversations.damaged(none), none.select("conv_id")).count() == 0
