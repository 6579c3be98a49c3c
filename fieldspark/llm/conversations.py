"""Repair of conversation structure by iterative-deepening A*.

Rows are put in order once; runs of at most ``SEGMENT`` rows of one conversation are searched apart from each other,
for each state of the roles that they may start and end in. A search goes depth first through the edits in ASCII order
of their initials (D, I, K, R), under bounds of cost that grow by one; what failed under a bound is remembered by place
and state with the budget that was left, and isn't entered again with no more than that. So the first path that is
accepted is the cheapest, and of equally cheap ones the first in ASCII order. Runs are then put together from the last
to the first: a run's paths end with an edit of its last row, so none is the beginning of another, and the order of
whole audits is that of the runs' parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from fieldspark.llm.common import written

#: Rows in a run that is searched at once: a power of two.
SEGMENT_BITS = 7
#: States of the roles so far: nothing, after s, after u, after a. An added or changed role is the only one that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Fixed costs of the edits; what a row that breaks off adds unless it is deleted.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
LEGAL = ("su", "ua", "au")
#: A place where all ends well, instead of a state.
END = -1
PATHS = "c string, s long, paths array<struct<entry:int,exit:int,cost:long,audit:string>>"
CHOICE = "c string, s long, choice array<struct<entry:int,exit:int,audit:string>>"
REPAIRED = "c string, illegal long, cost long, audit string, repaired_sha256 string"

Row = tuple[str, bool, bool]


def _moves(rows: list[Row], i: int, state: int, tail: bool) -> Iterator[tuple[str, int, int, int]]:
    """(initial, next place, next state, cost) of each edit, in ASCII order."""
    row = i < len(rows)
    if row:
        yield "D", i + 1, state, DELETE
    if row or tail:
        yield "I", i, FORCED[state], INSERT
    if row:
        initial, doomed, cut = rows[i]
        if not doomed:
            if (state, initial) in KEPT:
                yield "K", i + 1, KEPT[state, initial], CUT * cut
            yield "R", i + 1, FORCED[state], REROLE + CUT * cut


def _reachable(rows: list[Row], entry: int, goal: int) -> bool:
    if goal in (START, SYSTEM) and goal != entry:
        return (entry, goal) == (START, SYSTEM) and any(r == "s" and not doomed for r, doomed, _ in rows)
    return goal == END or bool(rows) or goal == entry


def search(rows: list[Row], entry: int = START, goal: int = END) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits of ``rows`` (role's initial, must go, breaks off) from state ``entry``.

    With a state as ``goal`` the edits lead to it and end with one of the last row; with ``END`` the roles end well, and
    rows may be added after the last. None if there is no such path.
    """
    if not _reachable(rows, entry, goal):
        return None
    n, tail = len(rows), goal == END
    ahead = [0] * (n + 1)  # what the rest costs at least
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] or rows[i][2] else 0)
    failed: dict[tuple[int, int], int] = {}
    for bound in range(ahead[0], DELETE * n + CUT + 2 * INSERT + 1):
        path, stack = [], [(0, entry, 0, _moves(rows, 0, entry, tail))]
        if failed.get((0, entry), -1) >= bound:
            continue
        while stack:
            i, state, cost, moves = stack[-1]
            if i == n and (state in (START, ASSISTANT) if tail else state == goal):
                return cost, "".join(path)
            for edit, j, to, more in moves:
                left = bound - cost - more
                if left >= ahead[j] and failed.get((j, to), -1) < left:
                    path.append(edit)
                    stack.append((j, to, cost + more, _moves(rows, j, to, tail)))
                    break
            else:
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
    return None


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn``, and n: how many equal rows there are."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), hit.alias("_hit")).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_hit") == 3, 2).otherwise(1).alias("_n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("_n").alias("n"))


def _key(conv_id: str = "conv_id"):
    """Ids as text, null as the empty one, so that they can be joined and ranged by."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows of ``damaged`` with c (the id as text), their fault and ``at``, which grows in order of turn (nulls first),
    then role and text. Equal rows are one with their number, so ranges can part even a conversation with most rows."""
    rows = rows.withColumn("c", _key()).withColumn("_digest", F.sha2("text", 256)).withColumn("_t", F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn")))
    first = rows.groupBy("c", "role", "_digest").agg(F.min("_t").alias("_first"))
    fault = (
        F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), "blank").when(F.col("_t") > F.col("_first"), "duplicate")
        .when(F.col("text").rlike("[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise("")
    )
    rows = rows.join(first, ["c", "role", "_digest"]).select("c", "turn", "role", "text", "n", fault.alias("fault"))
    order = [F.col("c"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")


def segments(rows: DataFrame) -> DataFrame:
    """Cheapest edits of each run of rows between the states that it may start and end in."""
    runs = rows.groupBy("c", F.shiftright("at", SEGMENT_BITS).alias("s")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.substring("role", 1, 1).alias("r"), F.col("fault").isin("blank", "duplicate").alias("d"), (F.col("fault") == "truncated").alias("t")))).alias("rows")
    )
    ends = rows.groupBy("c").agg(F.shiftright(F.min("at"), SEGMENT_BITS).alias("first"), F.shiftright(F.max("at"), SEGMENT_BITS).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = [(x["r"], x["d"], x["t"]) for x in r["rows"]]
                entries = (START,) if r["s"] == r["first"] else (START, SYSTEM, USER, ASSISTANT)
                goals = (END,) if r["s"] == r["last"] else (START, SYSTEM, USER, ASSISTANT)
                found = [(e, g, search(rows, e, g)) for e in entries for g in goals]
                out.append({"c": r["c"], "s": r["s"], "paths": [{"entry": e, "exit": g, "cost": f[0], "audit": f[1]} for e, g, f in found if f]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    path = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    schema = pa.schema([("c", pa.string()), ("s", pa.int64()), ("paths", pa.list_(path))])
    return runs.join(ends, "c").mapInArrow(run, PATHS)


def choices(paths: DataFrame) -> DataFrame:
    """For each run and state before it the way that the cheapest repair takes. Runs stream by from a conversation's last
    to its first, with nothing kept but what the rest costs from each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest = None, {END: 0}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["c"] != now:
                    now, rest = r["c"], {END: 0}
                best: dict[int, tuple[int, str, int]] = {}
                for p in r["paths"]:
                    if p["exit"] in rest:
                        way = (p["cost"] + rest[p["exit"]], p["audit"], p["exit"])
                        best[p["entry"]] = min(best.get(p["entry"], way), way)
                rest = {e: way[0] for e, way in best.items()}
                out.append({"c": now, "s": r["s"], "choice": [{"entry": e, "exit": x, "audit": a} for e, (_, a, x) in best.items()]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    choice = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("audit", pa.string())])
    schema = pa.schema([("c", pa.string()), ("s", pa.int64()), ("choice", pa.list_(choice))])
    return paths.repartition("c").sortWithinPartitions("c", F.desc("s")).mapInArrow(run, CHOICE)


class _Repair:
    """What one conversation comes to, row by row."""

    def __init__(self, c: str) -> None:
        self.c, self.state, self.roles, self.before = c, START, START, None
        self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0
        self.edits: Iterator[str] = iter("")

    def line(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def choose(self, choice: list[dict]) -> None:
        self.rest()
        way = next(w for w in choice if w["entry"] == self.state)
        self.state, self.edits = way["exit"], iter(way["audit"])

    def _insert(self) -> None:
        self.roles = FORCED[self.roles]
        self.cost += INSERT
        self.audit.append("I")
        self.line(NAMES[self.roles], "")

    def row(self, role: str, text: str, n: int, fault: str) -> None:
        initial = role[:1]
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + (n - 1)
        self.before = initial
        edit = next(self.edits)
        while edit == "I":
            self._insert()
            edit = next(self.edits)
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += CUT * (fault == "truncated") + REROLE * (edit == "R")
            self.roles = FORCED[self.roles] if edit == "R" else KEPT[self.roles, initial]
            self.line(NAMES[self.roles] if edit == "R" else role, text)
        self.audit.append(edit + "D" * (n - 1))  # further equal rows must go
        self.cost += DELETE * (n - 1)

    def rest(self) -> None:
        """What is added after the last row."""
        for _ in self.edits:
            self._insert()

    def done(self) -> dict:
        self.rest()
        return {"c": self.c, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repaired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """c, illegal, cost, audit and repaired_sha256 of each conversation that has rows.

    A conversation's rows stream by in order through one task, batch by batch, as its SHA-256 can't be put together from
    parts; only the audit, which is part of the result, is kept meanwhile.
    """
    left = chosen.select("c", "s", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), F.lit("").alias("fault"), "choice")
    right = rows.select("c", F.shiftright("at", SEGMENT_BITS).alias("s"), "at", "role", "text", "n", "fault", F.lit(None).cast("array<struct<entry:int,exit:int,audit:string>>").alias("choice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        schema = pa.schema([("c", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for batch in batches:
            out = []
            for c, at, role, text, n, fault, choice in zip(*(batch.column(k).to_pylist() for k in ("c", "at", "role", "text", "n", "fault", "choice"))):
                if now is None or now.c != c:
                    out += [now.done()] if now else []
                    now = _Repair(c)
                if at < 0:
                    now.choose(choice)
                else:
                    now.row(role, text, n, fault)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.done()], schema)

    return left.unionByName(right).repartition("c").sortWithinPartitions("c", "s", "at").mapInArrow(run, REPAIRED)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Digest of ``conversations`` (conv_id, turn, role, text) after damage and repair, one row for each original conv_id.

    Null roles and texts are one space; a null conv_id is an id like others, and a null turn comes first. Rows of one turn
    go by role, then text, in code-point order. A role that begins with none of s, u, a (or is empty) can't be kept.
    Conversations without rows after damage have zeros, an empty audit and the hash of the empty string. An empty table
    has no rows; further columns are not read.
    """
    rows = ordered(damaged(conversations))
    bad, many = F.col("fault").isin("blank", "duplicate"), F.col("n")
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = rows.groupBy("c").agg(
        turns.cast("long").alias("gaps"), F.sum(F.when(F.col("fault") == "blank", many).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", many).when(~bad, many - 1).otherwise(0)).alias("duplicate"), F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"),
    )
    found = repaired(rows, choices(segments(rows)))
    ids = conversations.select(F.col("conv_id").cast("long"), _key().alias("c")).distinct()
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(counts, "c", "left").join(found, "c", "left").select(
        "conv_id", *map(none, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
