import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from maskwright.operators import prompts, registry
from maskwright.plans.flow import register
from maskwright.streaming import commits, issued, plans

REQUEST = "doc_id string, body string, seq long"


class Receiver:
    """Answers by body; remembers what it was sent."""

    def __init__(self, unknown=()):
        self.sent, self.unknown = [], set(unknown)

    def __call__(self, rows):
        got = rows.collect()
        self.sent += [json.loads(r.request)["body"] for r in got]
        answers = [(r.idempotency_key, None if json.loads(r.request)["body"] in self.unknown else "done", "a") for r in got]
        return rows.sparkSession.createDataFrame(answers, "idempotency_key string, outcome string, answer string")


def came_of(spark, path, batch):
    """(doc_id, outcome) of each request of a batch."""
    return sorted(((r.doc_id or "", r.outcome) for r in commits.outcomes(spark, path).filter(F.col("batch") == batch).collect()))


def test_a_batch_that_runs_again_sends_nothing(spark, tmp_path):
    path, to = str(tmp_path / "ledger"), Receiver(unknown={"u"})
    first = spark.createDataFrame([("1", "a", 2), ("1", "b", 1), ("2", "u", 1), ("3", "c", 1), ("3", "c", 9), (None, "x", 1), (None, "y", 1)], REQUEST)
    commits.commit_batch(first, 0, path, to)
    assert sorted(to.sent) == ["b", "c", "u", "x", "y"]  # of document 1 the first by seq
    assert came_of(spark, path, 0) == [("", "done"), ("", "done"), ("1", "done"), ("1", "frozen"), ("2", "unknown"), ("3", "done")]
    to.sent.clear()
    to.unknown = set()
    commits.commit_batch(first, 0, path, to)  # only what has no outcome
    assert to.sent == ["u"]
    assert came_of(spark, path, 0) == [("", "done"), ("", "done"), ("1", "done"), ("1", "frozen"), ("2", "done"), ("3", "done")]
    commits.commit_batch(first.limit(0), 0, path, to)
    commits.commit_batch(first, 0, path, to)
    assert to.sent == ["u"]
    commits.commit_batch(spark.createDataFrame([("1", "a", 1), ("2", "v", 1), ("3", "c", 1)], REQUEST), 1, path, to)
    assert sorted(to.sent) == ["a", "u", "v"] and came_of(spark, path, 1) == [("1", "done"), ("2", "done")]


def test_an_open_request_is_sent_again_alone(spark, tmp_path):
    path, to = str(tmp_path / "ledger"), Receiver(unknown={"u"})
    commits.commit_batch(spark.createDataFrame([("2", "u", 1)], REQUEST), 0, path, to, scope="s")
    commits.commit_batch(spark.createDataFrame([("2", "v", 1), ("2", "u", 2)], REQUEST), 1, path, to, scope="other")
    assert to.sent == ["u"] and {r.outcome for r in commits.outcomes(spark, path).filter("batch = 1").collect()} == {"frozen"}
    to.unknown = set()
    commits.commit_batch(spark.createDataFrame([("2", "v", 1), ("2", "u", 2)], REQUEST), 2, path, to, scope="s")
    assert to.sent == ["u", "u"] and commits.open_requests(spark, path).count() == 0
    commits.commit_batch(spark.createDataFrame([("2", "v", 1)], REQUEST), 3, path, to, scope="s")
    assert to.sent == ["u", "u", "v"] and commits.settled(spark, path).count() == 2


def test_a_batch_that_broke_off_is_finished(spark, tmp_path):
    path, to = str(tmp_path / "ledger"), Receiver()

    def breaks(rows):
        to(rows)
        raise RuntimeError("lost")

    rows = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 1)], REQUEST)
    with pytest.raises(RuntimeError):
        commits.commit_batch(rows, 0, path, breaks)
    assert sorted(to.sent) == ["a", "c"] and commits.open_requests(spark, path).count() == 2
    commits.commit_batch(rows, 0, path, to)  # under the same keys, so the receiver knows them
    assert sorted(to.sent) == ["a", "a", "c", "c"] and commits.settled(spark, path).count() == 2
    commits.commit_batch(rows, 0, path, to)
    assert len(to.sent) == 4


def test_commits_of_a_stream(spark, tmp_path):
    path, to = str(tmp_path / "ledger"), Receiver()
    for k in range(3):
        spark.createDataFrame([(str(d), f"{d % 2}", k) for d in range(4)], REQUEST).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    commits.commit_stream(source, path, to, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(to.sent) == 4  # equal requests of later batches are known
    commits.commit_stream(source, path, to, str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(to.sent) == 4 and commits.settled(spark, path).count() == 4


ITEMS = [{"key": "0:0:0", "kind": "person", "action": "review", "offered": ["I0123456789ABCDEF"]}, {"key": "0:0:family", "kind": "family", "action": "new", "offered": []}]


def events(*steps):
    return [("d", f"2024-01-01 00:{i:02d}:00", kind, json.dumps(about)) for i, (kind, about) in enumerate(steps)]


UP = ("upload", {"tabular": True, "configured": True, "tags": ["PERSON"], "rows": 3})
DECIDE = ("decide", {"key": "0:0:0", "action": "attach", "target": "I0123456789ABCDEF"})


def test_steps_of_a_plan():
    def walk(*steps):
        state, out = ("off", "", {}, []), []
        for kind, about in steps:
            *state, ask, refused = plans.step(*state, kind, about)
            out.append((state[0], ask, refused, sorted(state[2])))
        return out

    for about, status in ((UP[1] | {"tabular": False}, "off"), (UP[1] | {"configured": False}, "off"), (UP[1] | {"tags": ["EMAIL"]}, "off"), (UP[1] | {"rows": 0}, "none")):
        assert walk(("upload", about)) == [(status, False, False, [])]
    ready = ("plan", {"items": ITEMS, "people": 1})
    assert walk(UP, ("plan", {"error": "timeout"}), ("retry", {}), ready) == [("waiting", True, False, []), ("error", False, False, []), ("waiting", True, False, []), ("ready", False, False, [])]
    assert walk(UP, ("plan", {"people": 0}))[-1][0] == "none" and walk(ready)[-1][2]
    kept = walk(UP, ready, DECIDE, ("decide", {"key": "0:0:family", "action": "skip"}), ("retry", {}), ready)
    assert [x[3] for x in kept] == [[], [], ["0:0:0"], ["0:0:0"], ["0:0:0"], ["0:0:0"]] and kept[3][2]
    gone = walk(UP, ready, DECIDE, ("retry", {}), ("plan", {"items": [ITEMS[0] | {"offered": []}], "people": 1}))
    assert gone[-1] == ("ready", False, False, [])
    assert walk(UP, ready, ("sent", {}))[-1] == ("ready", False, True, [])  # an item is undecided
    frozen = walk(UP, ready, DECIDE, ("sent", {}), ("decide", {"key": "0:0:0", "action": "undo"}), ("retry", {}), UP, ("sent", {}), ("outcome", {"stale": ["0:0:0"]}), ("outcome", {"committed": True}))
    assert [x[0] for x in frozen[3:]] == ["frozen"] * 6 + ["committed"] and [x[2] for x in frozen[3:]] == [False, True, True, True, False, False, False]
    assert walk(UP, ready, DECIDE, ("sent", {}), ("outcome", {"items": ITEMS, "stale": []}))[-1] == ("ready", False, False, ["0:0:0"])


def test_states_of_a_stream(spark, tmp_path):
    ready = ("plan", {"items": ITEMS, "people": 1})
    first = events(UP, ("plan", {"error": "no answer"}), ("retry", {}), ready)
    rest = [("d", f"2024-01-01 01:{i:02d}:00", k, json.dumps(a)) for i, (k, a) in enumerate([DECIDE, ("sent", {}), ("retry", {}), ("outcome", {"committed": True})])]
    late = [("e", "2024-01-01 09:00:00", "upload", json.dumps(UP[1])), ("f", "2024-01-01 09:30:00", "upload", json.dumps({"tabular": False}))]
    for rows in (first, rest, late, [("e", "2024-01-01 18:00:00", "plan", json.dumps({"people": 0}))], [("g", "2024-01-01 18:30:00", "retry", "{}")]):
        spark.createDataFrame(rows, "doc_id string, at string, kind string, payload string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id string, at string, kind string, payload string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    with plans.state_store(spark):
        query = plans.plan_states(source).writeStream.format("memory").queryName("plan_states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    got = spark.sql("select * from plan_states").collect()
    of = lambda d: [(r.kind, r.status, r.refused) for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r["at"])]
    assert of("d") == [
        ("upload", "waiting", False), ("plan", "error", False), ("retry", "waiting", False), ("plan", "ready", False), ("decide", "ready", False), ("sent", "frozen", False),
        ("retry", "frozen", True), ("outcome", "committed", False), ("idle", "off", False),
    ]
    assert of("e") == [("upload", "waiting", False), ("plan", "none", False)]  # nine hours of waiting don't count as idle
    assert of("f") == [("upload", "off", False), ("idle", "off", False)]


def test_payloads_of_plans_and_decisions(spark):
    items = spark.createDataFrame([("d", "0:0:0", "person", "review", [("I0123456789abcdef", "1:2:0")])], "doc_id string, key string, kind string, action string, candidates array<struct<community_id:string,sheet_ref:string>>")
    (r,) = plans.plan_event(items, spark.createDataFrame([("d", "x")], "doc_id string, key string")).collect()
    assert json.loads(r.payload) == {"items": [{"key": "0:0:0", "kind": "person", "action": "review", "offered": ["I0123456789ABCDEF", "1:2:0"]}], "people": 1, "stale": ["x"]}
    (d,) = plans.decide_event(spark.createDataFrame([("d", "0:0:0", "attach", " i0123456789abcdef ")], "doc_id string, key string, action string, target string")).collect()
    assert json.loads(d.payload) == {"key": "0:0:0", "action": "attach", "target": "I0123456789ABCDEF"}


def test_no_id_is_issued_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    values = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, original string, tag string")
    first = {(r.doc_id, r.original): r.hex_id for r in issued.issue_batch(values(*(("a", f"v{i}", "ID") for i in range(30))), 0, path, "s", "one").collect()}
    again = {(r.doc_id, r.original): r.hex_id for r in issued.issue_batch(values(*(("a", f"v{i}", "ID") for i in range(30))), 0, path, "s", "one").collect()}
    assert first == again and len(set(first.values())) == 30  # a batch that runs again has the same
    # the second run's first candidates are all taken
    hit = spark.createDataFrame([(d, o) for d, o in first], "doc_id string, original string")
    clash = hit.select("doc_id", "original", F.explode(registry.candidates("t")).alias("hex_id"), F.lit("ID").alias("tag"), F.lit("zero").alias("run"), F.lit(0).cast("long").alias("batch"))
    best = clash.groupBy("original").agg(F.first("hex_id").alias("h"))
    taken = clash.join(best, "original").filter("hex_id = h").select("hex_id", F.lit("z").alias("doc_id"), "original", "tag")
    taken.write.parquet(f"{path}/run=zero/batch=0")
    more = issued.issue_batch(values(*(("b", f"v{i}", "ID") for i in range(20)), ("a", "v1", "ORG"), ("a", "v1", "ORG"), ("a", "", "ID")), 0, path, "t", "two").collect()
    ids = {(r.doc_id, r.original): (r.hex_id, r.tag) for r in more}
    assert len(more) == 21 and ids["a", "v1"] == (first["a", "v1"], "ID")
    monkeypatch.setattr(issued, "BROADCAST_IDS", 0)
    issued.issue_batch(values(("c", "new", "ID")), 1, path, "t", "two")
    every = [r.hex_id for r in issued.ledger(spark, path).collect()]
    assert len(every) == len(set(every)) == 30 + 30 + 20 + 1


def test_ids_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(str(d), f"v{k}", "ID") for d in range(4)], "doc_id string, original string, tag string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for run in ("one", "two"):
        source = spark.readStream.schema("doc_id string, original string, tag string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        issued.issue_stream(source, str(tmp_path / "ledger"), str(tmp_path / "out"), run, str(tmp_path / run), run).trigger(availableNow=True).start().awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 12  # the second run finds all values known
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 24 and out.select("doc_id", "original", "hex_id").distinct().count() == 12


@pytest.mark.parametrize("parts", [1, 7])
def test_a_prompt_lists_what_earlier_chunks_gave(spark, parts):
    def words(prompt, text):
        """A model double: words with a capital are people, linked to the first known one."""
        known = [line.split(": ", 1)[1] for line in prompt.split("Known entries")[1].split("----")[0].splitlines() if line.startswith("  PERSON: ")]
        return [{"text": w, "type": "person", "linked_to": known[0] if known else None} for w in text.split() if w.istitle()]

    rows = [(d, n, f"Aa{d} said B{n % 3} to C{n}") for d in range(5) for n in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string").repartition(parts, "text")
    found = {(r.doc_id, r.chunk_no): r for r in prompts.turns(chunks, words, ["PERSON"], most=10).collect()}
    entries = {}
    for d, n, text in rows:
        own = entries.setdefault(d, [])
        r = found[d, n]
        assert r.known == len(own) and list(r.listed) == [f"  PERSON: {v}" for v in own[-10:]]
        own += [w for w in text.split() if w.istitle() and w not in own]
    hits = prompts.detect_in_turn(chunks, words, ["PERSON"], most=10)
    assert {(r.doc_id, r.value) for r in hits.collect()} == {(d, v) for d, own in entries.items() for v in own}
    assert hits.filter("linked_to is null").count() == 5 * 3  # of the first chunks


def test_prompts():
    text = prompts.prompt_text("the chunk", ["EMAIL"], [("PERSON", "Ann")], 7)
    assert "EMAIL: email address" in text and "PHONE" not in text and "  PERSON: Ann\n  and 7 earlier ones" in text and "\n----\nthe chunk\n----\n" in text
    assert "  none" in prompts.prompt_text("x")


def test_unreadable_answers_fail_in_turn(spark):
    chunks = spark.createDataFrame([(1, 0, "x")], "doc_id long, chunk_no int, text string")
    with pytest.raises(Exception, match="can't be scanned"):
        prompts.detect_in_turn(chunks, lambda prompt, text: None, wait=0).collect()


def test_a_model_is_asked_once_a_chunk(spark, tmp_path):
    from maskwright.operators import detect

    calls = str(tmp_path)

    def model(text):
        import uuid

        with open(f"{calls}/{uuid.uuid4()}", "w") as f:
            f.write(text)
        return [{"text": "Ann Lee", "type": "PERSON"}]

    docs = spark.createDataFrame([(1, "Ann Lee and Lee Ray wrote a@example.com")], "doc_id long, text string")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", " and ")).alias("chunk_no", "text"))
    cells = spark.createDataFrame([(1, 0, r, 0, v) for r, v in enumerate(["Name", "Ann Lee", "Ann Lee", "Cy Poe"])], "doc_id long, sheet int, row int, col int, value string")
    found = register(docs, model_hits=detect.detect_model(chunks, model), cells=cells)
    assert {(r.original, r.tag) for r in found.collect()} == {("Ann Lee", "PERSON"), ("a@example.com", "EMAIL"), ("Cy Poe", "PERSON")}
    assert len(list(tmp_path.iterdir())) == 2


def test_a_plan_takes_three_messages_a_batch_and_moves_its_timer():
    class Handle:
        def __init__(self):
            self.value, self.timers, self.calls = None, set(), []

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):  # noqa: N802
            self.calls.append("register")
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.calls.append("delete")
            self.timers.remove(at)

    handle, states = Handle(), plans.PlanStates()
    states.init(handle)
    event = lambda minute, kind, about: Row(doc_id="d", at=datetime(2024, 1, 1, 0, minute, tzinfo=UTC), kind=kind, payload=json.dumps(about))
    idle = lambda minute: {int(datetime(2024, 1, 1, plans.IDLE_HOURS, minute, tzinfo=UTC).timestamp() * 1000)}
    batches = [
        ([event(1, "retry", {}), event(0, "upload", {"tabular": False})], ["get", "update", "register"], idle(1)),
        ([event(3, "retry", {})], ["get", "update", "delete", "register"], idle(3)),
        ([event(2, "retry", {})], ["get", "update"], idle(3)),  # late: the last event's time stays
        ([event(4, *UP)], ["get", "update", "delete"], set()),
        ([event(5, "plan", {"people": 0})], ["get", "update", "register"], idle(5)),
    ]
    for rows, calls, timers in batches:
        handle.calls.clear()
        assert [r["at"] for r in states.handleInputRows(("d",), iter(rows), None)] == sorted(r["at"] for r in rows)
        assert handle.calls == calls and handle.timers == timers
