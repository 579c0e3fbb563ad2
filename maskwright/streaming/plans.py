"""The life of a roster's plan, as keyed state of a stream of events.

A document's state is one of STATES.  What must be asked of the matching step, and what
was refused, goes out with each event; the matching itself is outside.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.operators.roster import normal_target

#: off: no plan for this document; none: nobody in it; waiting: a plan is asked for; ready: items
#: can be decided; error: no answer, ask again; frozen: a commit's outcome is unknown; committed.
STATES = ("off", "none", "waiting", "ready", "error", "frozen", "committed")
# Fixed value: hours without an event after which a document is forgotten, unless an answer is awaited.
IDLE_HOURS = 2

EVENTS = "doc_id string, at timestamp, kind string, payload string"
OUTPUT = "doc_id string, at timestamp, kind string, status string, reason string, ask boolean, refused boolean, decisions string, pending int"
_STATE = "status string, reason string, decisions string, items string, at long"
_HOUR = 3_600_000


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_OUT = Row(*(c.split()[0] for c in OUTPUT.split(", ")))


class PlanStates(StatefulProcessor):
    """One document's plan: see ``plan_states``.

    Each call of the state or a timer is a message to the JVM, so there are three a
    document and batch: a timer's time follows from the state and is never looked up.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("plan", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = sorted(rows, key=lambda e: (e["at"], e["kind"] is None, e["kind"]))  # of one document in one batch
        known = self.state.get()
        status, reason, decisions, items, at = known or ("off", "nothing was uploaded", "{}", "[]", 0)
        before = _forgotten_at(status, at) if known else None
        decisions, items = json.loads(decisions), json.loads(items)
        out = []
        for e in events:
            status, reason, decisions, items, ask, refused = step(status, reason, decisions, items, e["kind"], json.loads(e["payload"] or "{}"))
            at = max(at, (e["at"] - _EPOCH) // timedelta(milliseconds=1))
            out.append(_OUT(key[0], e["at"], e["kind"], status, reason, ask, refused, json.dumps(decisions, sort_keys=True), len(undecided(items, decisions))))
        self.state.update((status, reason, json.dumps(decisions, sort_keys=True), json.dumps(items), at))
        after = _forgotten_at(status, at)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        at = _EPOCH + timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
        yield _OUT(key[0], at, "idle", "off", "forgotten", False, False, "{}", 0)

    def close(self) -> None:
        pass


def _forgotten_at(status: str, at: int) -> int | None:
    """When a document in this state, whose last event was ``at``, is forgotten; None if it is not."""
    return None if status in ("waiting", "frozen") else at + IDLE_HOURS * _HOUR


def undecided(items: list[dict], decisions: dict) -> list[str]:
    return [i["key"] for i in items if i.get("action") == "review" and i["key"] not in decisions]


def fitting(decisions: dict, items: list[dict], stale: Iterable[str] = ()) -> dict:
    """The decisions that still have their item, an offered target and an action of its kind."""
    known, gone = {i["key"]: i for i in items}, set(stale)
    fits = {
        "attach": lambda d, i: d.get("target") in (i.get("offered") or ()),
        "skip": lambda d, i: i.get("kind") == "person",
        "create": lambda d, i: True,
    }
    return {k: d for k, d in decisions.items() if k in known and k not in gone and d.get("action") in fits and fits[d["action"]](d, known[k])}


def step(status: str, reason: str, decisions: dict, items: list[dict], kind: str, about: dict) -> tuple[str, str, dict, list[dict], bool, bool]:
    """The state after an event: status, reason, decisions, items; whether to ask for a plan, and whether the event was refused.

    ``upload`` (tabular, configured, tags, rows) begins anew.  ``plan`` (items, people,
    stale) or ``plan`` (error) answers what was asked.  ``decide`` (key, action, target)
    and ``retry`` are refused while frozen; a retry keeps the decisions that the next
    plan still offers.  ``sent`` freezes, ``outcome`` (committed, items, stale) settles.
    """
    same = (status, reason, decisions, items)
    if kind == "upload":
        if status == "frozen":
            return *same, False, True
        tags = about.get("tags")
        off = "not a table" if not about.get("tabular") else "no matching step is configured" if not about.get("configured") else "names are not replaced" if tags and "PERSON" not in tags else ""
        if off:
            return "off", off, {}, [], False, False
        if not about.get("rows"):
            return "none", "no rows", {}, [], False, False
        return "waiting", "", {}, [], True, False
    if kind == "plan" and status == "waiting":
        if about.get("error"):
            return "error", about["error"], decisions, [], False, False
        found = about.get("items") or []
        if not about.get("people"):
            return "none", "no columns of names", fitting(decisions, found, about.get("stale") or ()), found, False, False
        return "ready", "", fitting(decisions, found, about.get("stale") or ()), found, False, False
    if kind == "retry" and status in ("ready", "error", "none") and reason != "no rows":
        return "waiting", "", decisions, items, True, False
    if kind == "decide" and status == "ready":
        rest = {k: d for k, d in decisions.items() if k != about.get("key")}
        if about.get("action") == "undo":
            return status, reason, rest, items, False, False
        new = fitting({about.get("key"): {"action": about.get("action"), "target": about.get("target")}}, items)
        return (status, reason, rest | new, items, False, False) if new else (*same, False, True)
    if kind == "sent" and status in ("ready", "frozen") and not undecided(items, decisions):
        return "frozen", "the outcome is unknown", decisions, items, False, False
    if kind == "outcome" and status in ("ready", "frozen"):
        if about.get("committed"):
            return "committed", "", decisions, items, False, False
        if status == "frozen" and about.get("stale"):
            return *same, False, False  # the first send may have been written
        found = about.get("items") or items
        return "ready", "refused", fitting(decisions, found, about.get("stale") or ()), found, False, False
    return *same, False, True


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While it lasts, new streams of this session keep their state in RocksDB, as ``plan_states`` needs it."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The state of each document after each of its events (a stream of EVENTS): OUTPUT.

    ``ask`` says that a plan is to be requested, with ``decisions``; ``refused`` that the
    event changed nothing; ``pending`` counts the items to review without a decision.
    Events of one batch are taken in order of time.  After IDLE_HOURS of event time
    without an event a document is forgotten, but never while an answer is awaited.
    The stream must start within ``state_store``.
    """
    keyed = events.select(F.col("doc_id").cast("string").alias("doc_id"), "at", "kind", "payload").withWatermark("at", delay).groupBy("doc_id")
    return keyed.transformWithState(PlanStates(), OUTPUT, "Append", "EventTime")


def plan_event(items: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """The ``plan`` events' payload from flattened plans (``roster.plan_items``): doc_id, payload."""
    offered = F.array_compact(F.flatten(F.transform("candidates", lambda c: F.array(F.upper(c["community_id"]), c["sheet_ref"]))))
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "action", offered.alias("offered")))).alias("items"), F.count_if(F.col("kind") == "person").alias("people"))
    if stale is not None:
        rows = rows.join(stale.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("stale")), "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias("payload"))


def decide_event(decisions: DataFrame) -> DataFrame:
    """The ``decide`` events' payload of decisions (doc_id, key, action, target), targets in their normal form: doc_id, payload."""
    kind = F.when(F.col("key").endswith("family"), "family").otherwise("person")
    target = F.when(kind == "person", normal_target(F.col("target"), "person")).otherwise(normal_target(F.col("target"), "family"))
    return decisions.select("doc_id", F.to_json(F.struct("key", "action", target.alias("target"))).alias("payload"))
