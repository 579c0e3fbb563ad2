"""Repair of conversation structure at least cost.

Conversations are dealt by hash to batches, and a recursive DuckDB query repairs all
of a batch at once: each recursion advances one turn for all conversations and keeps,
for each state of the grammar, the least cost and its audit.  A conversation beyond
the bounds of a batch is streamed through in blocks of turns instead, with the states
carried from block to block.

The grammar of role initials is ``(s?(ua)+)?``.  Its states are 0 (nothing yet), 1
(after the system turn), 2 (after a user turn) and 3 (after an assistant turn); 0 and
3 may end.  Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3,
Insert an empty user or assistant turn 2; a truncated turn that stays adds 1.  Blank
and duplicate turns must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import BROADCAST_ROWS, small_batches, table, written

#: Turns and bytes that a batch is meant to hold.
BATCH_TURNS, BATCH_BYTES = 1_000, 4 << 20
#: From so many turns or bytes on, a conversation is streamed alone, in blocks of BLOCK_TURNS.
LONG_TURNS, LONG_BYTES = 5_000, 16 << 20
BLOCK_TURNS = 500
# What may be done with a turn, and its cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_SPACES = r"\x20\x09-\x0D"
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _moves() -> list[tuple[int, int, str | None, str, int]]:
    """(state, next state, initial that is needed, letters, cost) of inserts followed by one edit of a turn.

    Inserts lead from state to state as user and assistant turns do; more of them than
    reach each state once only cost more.
    """
    found = []
    for begin in range(4):
        state, k, passed = begin, 0, set()
        while state not in passed:
            passed.add(state)
            after = 3 if state == 2 else 2
            found.append((begin, state, None, "I" * k + "D", INSERT * k + DELETE))
            found.append((begin, after, None, "I" * k + "R", INSERT * k + REROLE))
            found += [(begin, e, c, "I" * k + "K", INSERT * k) for (at, c), e in _NEXT.items() if at == state]
            state, k = after, k + 1
    return found


_MOVES = ", ".join(f"({s}, {e}, {'NULL' if c is None else repr(c)}, '{x}', {cost})" for s, e, c, x, cost in _moves())
_ENDS = "(0, 0, ''), (3, 0, ''), (2, {0}, 'I'), (1, {1}, 'II')".format(INSERT, 2 * INSERT)

#: Turns of ``damaged`` (conv, turn, role, text) in order, with their first fault.
FAULTS = rf"""
numbered AS (SELECT *, substr(role, 1, 1) AS c, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
seen AS (SELECT *, NOT regexp_matches(text, '[^{_SPACES}]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS again,
  lag(c) OVER (PARTITION BY conv ORDER BY n) AS c_before FROM numbered),
turns AS (SELECT *, blank OR again AS gone, NOT blank AND again AS duplicate, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][{_SPACES}]*\z') AS truncated FROM seen)"""

#: What stands in the turns, by conversation.
COUNTS = """
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (c_before IS NOT NULL AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM turns GROUP BY conv)"""

#: One recursion a turn: the best way to each state, from the states in ``begins`` (conv, state, cost, audit).
WAYS = f"""
moves(state, next, c, letters, cost) AS (VALUES {_MOVES}),
ways AS (
  SELECT conv, 0::BIGINT AS n, state, {{'cost': cost, 'audit': audit}} AS best FROM begins
  UNION ALL
  SELECT w.conv, t.n, m.next, min({{'cost': w.best.cost + m.cost + CASE WHEN t.truncated AND m.letters NOT LIKE '%D' THEN {TRUNCATED} ELSE 0 END, 'audit': w.best.audit || m.letters}})
  FROM ways w JOIN turns t ON t.conv = w.conv AND t.n = w.n + 1
  JOIN moves m ON m.state = w.state AND (m.letters LIKE '%D' OR (NOT t.gone AND (m.c IS NULL OR m.c = t.c)))
  GROUP BY w.conv, t.n, m.next)"""

#: A batch's conversations (``conversations``: conv), repaired.
REPAIR = f"""WITH RECURSIVE {FAULTS},
{COUNTS},
begins AS (SELECT conv, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM counts),
{WAYS},
ends(state, cost, letters) AS (VALUES {_ENDS}),
chosen AS (SELECT conv, min({{'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.letters}}) AS best FROM ways w JOIN counts USING (conv, n) JOIN ends e USING (state) GROUP BY conv),
letters AS (SELECT conv, k, audit[k] AS letter FROM (SELECT conv, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS k FROM chosen)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY k) AS n FROM letters),
left_ AS (SELECT p.conv, p.k, p.letter, t.role, t.text, t.c, row_number() OVER (PARTITION BY p.conv ORDER BY p.k) AS j FROM placed p LEFT JOIN turns t ON t.conv = p.conv AND t.n = p.n AND p.letter <> 'I' WHERE p.letter <> 'D'),
first_ AS (SELECT *, (first_value(letter) OVER w = 'K' AND first_value(c) OVER w = 's')::INT AS system FROM left_ WINDOW w AS (PARTITION BY conv ORDER BY j)),
said AS (SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM first_ GROUP BY conv)
SELECT conv, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM conversations LEFT JOIN counts USING (conv) LEFT JOIN chosen USING (conv) LEFT JOIN said USING (conv)"""

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SCHEMA = "conv long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a turn, 1 empties its text, 2 removes its ``.!?``, 3 has it twice, 4 makes it
    the user's.  A null is one space in the key, a role or a text.
    """
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fate.alias("fate"),
    ).filter("fate <> 0")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("fate", "copy")


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("SET temp_directory = ''")
    return con


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text).

    Gives conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 for every id in ``ids`` (conv_id; those of ``turns`` by default); a
    conversation without turns has zeros, an empty audit and the hash of an empty text.
    Turns stand by number, nulls first, those of one number by role, then text (by code
    points).  Null roles and texts are one space, and rows with a null conv_id are one
    conversation.  Of equally cheap audits the least by ASCII counts.  Other columns
    aren't read.  Costs are exact at every length: conversations of more than LONG_TURNS
    turns or LONG_BYTES are streamed, sorted, in blocks.
    """
    spark = turns.sparkSession
    small_batches(spark)
    kept = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    sizes = written(kept.groupBy("conv").agg(F.count("*").alias("n"), size.alias("bytes")), "conversations")
    long = sizes.filter((F.col("n") > LONG_TURNS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv").alias("_conv"))
    total, bytes_, many = sizes.agg(F.sum("n"), F.sum("bytes"), F.count_if((F.col("n") > LONG_TURNS) | (F.col("bytes") > LONG_BYTES))).first()
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    usual, parts = kept, []
    if many:
        long = F.broadcast(long) if many <= BROADCAST_ROWS else long
        usual = kept.join(long, same, "left_anti")
        parts.append(_streamed(kept.join(long, same, "left_semi")))
    batches = max(1, -(-(total or 0) // BATCH_TURNS), -(-(bytes_ or 0) // BATCH_BYTES))

    def run(rows: pa.Table) -> pa.Table:
        con = _connection()
        # a null id must find itself in joins
        ids = pc.unique(rows.column("conv").combine_chunks())
        at = pc.index_in(rows.column("conv"), value_set=ids)
        con.register("damaged", rows.drop_columns(["conv"]).append_column("conv", at.cast(pa.int64())))
        con.register("conversations", pa.table({"conv": pa.array(range(len(ids)), pa.int64())}))
        found = con.sql(REPAIR).to_arrow_table()
        con.close()
        return found.set_column(0, "conv", ids.take(found.column("conv"))).cast(pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in found.column_names]))

    dealt = usual.withColumn("_batch", F.pmod(F.xxhash64("conv"), F.lit(batches)))
    out = dealt.groupBy("_batch").applyInArrow(lambda rows: run(rows.drop_columns(["_batch"])), SCHEMA)
    for part in parts:
        out = out.unionByName(part)
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COLUMNS]
        nothing = hashlib.sha256(b"").hexdigest()
        joined = every.join(out, same, "left")
        return joined.select(F.col("_conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    return out.withColumnRenamed("conv", "conv_id")


def _flags(rows: DataFrame) -> DataFrame:
    """The turns of long conversations with their place in the order and their faults."""
    from pyspark.sql import Window

    rows = rows.withColumns({"digest": F.sha2("text", 256), "blank": ~F.col("text").rlike(rf"[^{_SPACES}]"), "c": F.substring("role", 1, 1)})
    again = Window.partitionBy("conv", "role", "digest").orderBy("turn")
    rows = rows.withColumn("again", F.row_number().over(again) > 1)
    cut = ~F.col("blank") & ~F.col("again") & ~F.col("text").rlike(rf"[.!?][{_SPACES}]*\z")
    return rows.withColumns({"gone": F.col("blank") | F.col("again"), "duplicate": ~F.col("blank") & F.col("again"), "truncated": cut})


def _streamed(rows: DataFrame) -> DataFrame:
    """As ``repair``, each conversation streamed in order through one task, which holds a few bytes a turn.

    A hash of a whole text can't be taken in parts, so the order of turns is that of the
    stream; texts pass by in batches, twice: for the ways, then for the hash.
    """
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("at"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("again")]
    turns = written(_flags(rows).withColumn("at", F.lit(1)).drop("digest"), "turns")

    def ways_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in _by_conversation(batches):
            counts = dict.fromkeys(COLUMNS, 0)
            best, before, low, high, numbers, last = {0: (0, "")}, None, None, None, 0, None
            for part in parts:
                for c, turn in zip(part.column("c").to_pylist(), part.column("turn").to_pylist(), strict=True):
                    counts["illegal"] += before is not None and before + c not in ("su", "ua", "au")
                    before = c
                    if turn is not None:
                        numbers += turn != last
                        low, high, last = turn if low is None else low, turn, turn
                for name in ("blank", "duplicate", "truncated"):
                    counts[name] += pc.sum(part.column(name)).as_py() or 0
                best = _advanced(best, part)
            counts["gaps"] = high - low + 1 - numbers if numbers else 0
            ends = {0: (0, ""), 3: (0, ""), 2: (INSERT, "I"), 1: (2 * INSERT, "II")}
            counts["cost"], audit = min((best[s][0] + cost, best[s][1] + x) for s, (cost, x) in ends.items() if s in best)
            yield pa.record_batch([pa.array([conv], pa.int64()), *(pa.array([counts[c]], pa.int64()) for c in COLUMNS), pa.array([audit])], names=["conv", *COLUMNS, "audit"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in _by_conversation(batches):
            audit, k, j, system, digest = None, 0, 0, 0, hashlib.sha256()

            def say(role: str | None, text: str) -> None:
                nonlocal j
                j += 1
                who = role if role is not None else "user" if (j - system) % 2 else "assistant"
                digest.update(("\n" * (j > 1) + who + ":" + text).encode())

            for part in parts:
                for head, role, text, c in zip(*(part.column(x).to_pylist() for x in ("audit", "role", "text", "c")), strict=True):
                    if head is not None:
                        audit = head
                        continue
                    while audit[k] == "I":
                        say(None, "")
                        k += 1
                    if audit[k] == "K":
                        system = 1 if j == 0 and c == "s" else system
                        say(role, text)
                    elif audit[k] == "R":
                        say(None, text)
                    k += 1
            for _ in audit[k:]:
                say(None, "")
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    found = written(turns.repartition("conv").sortWithinPartitions(*order).select("conv", "turn", "c", "gone", "blank", "duplicate", "truncated").mapInArrow(ways_of, SCHEMA.replace(", repaired_sha256 string", "")), "repaired")
    heads = found.select("conv", "audit").withColumn("at", F.lit(0))
    both = turns.unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*order)
    sha = both.select("conv", "audit", "role", "text", "c").mapInArrow(hashed, "conv long, repaired_sha256 string").withColumnRenamed("conv", "_conv")
    return found.join(sha, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[pa.RecordBatch]]]:
    """Each conversation of sorted rows, with its rows in parts of at most BLOCK_TURNS, to be read in turn."""

    def parts() -> Iterator[tuple[int | None, pa.RecordBatch]]:
        for batch in batches:
            ids = batch.column("conv").to_pylist()
            begin = 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[begin] or k - begin == BLOCK_TURNS:
                    yield ids[begin], batch.slice(begin, k - begin)
                    begin = k

    every = parts()
    waiting = next(every, None)
    while waiting is not None:
        conv = waiting[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            while waiting is not None and waiting[0] == conv:
                yield waiting[1]
                waiting = next(every, None)

        yield conv, own()


def _advanced(best: dict[int, tuple[int, str]], part: pa.RecordBatch) -> dict[int, tuple[int, str]]:
    """The best ways to each state after the turns of a block; ways begin anew in the query, so only their ends are joined."""
    con = _connection()
    table_ = pa.Table.from_batches([part]).select(["c", "gone", "truncated"]).append_column("n", pa.array(range(1, part.num_rows + 1), pa.int64()))
    con.register("block", table_)
    con.register("starts", pa.table({"conv": pa.array(list(best), pa.int64())}))
    query = f"WITH RECURSIVE turns AS (SELECT s.conv, b.* FROM block b, starts s), begins AS (SELECT conv, conv::INT AS state, 0::BIGINT AS cost, '' AS audit FROM starts), {WAYS} SELECT conv, state, best.cost, best.audit FROM ways WHERE n = {part.num_rows}"
    out: dict[int, tuple[int, str]] = {}
    for start, state, cost, audit in con.execute(query).fetchall():
        way = (best[start][0] + cost, best[start][1] + audit)
        if state not in out or way < out[state]:
            out[state] = way
    con.close()
    return out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns.select("conv_id"))


def _crc32_sql(text: str) -> str:
    """crc32 of a text's bytes, which DuckDB lacks, by a table of 256 steps."""
    steps = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        steps.append(k)
    code = "list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)".format(text)
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {code}), lambda a, b: xor(a >> 8, ({steps}::BIGINT[])[(xor(a, b) & 255) + 1])))"


# the same conditions, from the last turn back to the first: the best end of each state
_BACK = f"""
moves(state, next, c, letters, cost) AS (VALUES {_MOVES}),
ways AS (
  SELECT conv, n + 1 AS n, state, {{'cost': cost, 'audit': letters}} AS best FROM counts, (VALUES {_ENDS}) e(state, cost, letters)
  UNION ALL
  SELECT w.conv, t.n, m.state, min({{'cost': w.best.cost + m.cost + CASE WHEN t.truncated AND m.letters NOT LIKE '%D' THEN {TRUNCATED} ELSE 0 END, 'audit': m.letters || w.best.audit}})
  FROM ways w JOIN turns t ON t.conv = w.conv AND t.n = w.n - 1 JOIN moves m ON m.next = w.state AND (m.letters LIKE '%D' OR (NOT t.gone AND (m.c IS NULL OR m.c = t.c)))
  GROUP BY w.conv, t.n, m.state)"""
OP13_SQL = (
    "WITH RECURSIVE raw AS (SELECT conv_id, turn, " + _crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')") + " % 20 AS fate, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations), "
    "damaged AS (SELECT conv_id AS conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text "
    "FROM raw, range(2) r(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3))," + FAULTS + "," + COUNTS + "," + _BACK
    + ", chosen AS (SELECT conv, best FROM ways WHERE n = 1 AND state = 0)," + REPAIR[REPAIR.index("letters AS") : REPAIR.index("SELECT conv, coalesce(gaps")]
    + REPAIR[REPAIR.index("SELECT conv, coalesce(gaps") :].replace("SELECT conv,", "SELECT conv AS conv_id,").replace("FROM conversations", "FROM (SELECT DISTINCT conv_id AS conv FROM conversations)")
)
