"""Repair of conversations by the cheapest edits, found by depth-first branch-and-bound.

A conversation's rows, in order, are kept (0), given the role user or assistant (2) or deleted (3); rows with empty text may be inserted anywhere (2).
Blank rows and duplicates must be deleted, and a truncated row that stays adds 1. The initials of the roles must then read `(s?(ua)+)?`.
Among the cheapest edits those whose audit, their initials in order, comes first in ASCII are taken; an audit and the roles it is
applied to determine the repaired rows.

1. `damage` damages rows as the contract says, and `rows_of` gives each row its facts: initial of the role, its first fault, a digest of role
   and text. All are column expressions; duplicates are numbered by a window over (conversation, digest), so a long conversation is not one key.
2. `solved`: rows, without their texts, are range-partitioned by conversation and place, so a long conversation is spread over tasks. Each run of at most PIECE
   rows of a conversation in a task is searched: a conversation that is one run from its start to a legal end, all others from each of the four
   states (nothing yet, after s, u or a) to each.
3. `search`: an explicit stack of nodes (row, state) with cost and edits so far. A node's branches go on the stack so that the most promising is
   taken first. A branch is cut if its cost and the least that the rest must cost, were its end free (`suffix_bounds`), exceed the incumbent, the best (cost, audit) found,
   or if the node's dominance table holds a prefix that costs less, or as much with an audit that comes first. What follows a node does not depend on how it was
   reached, so neither cut loses the best edits; when the stack is empty, they are proved.
4. `repaired`: a conversation's runs, a few rows, meet its rows in one sort. They are put together first (`Chain`), then the rows stream by and are
   hashed as they are edited, so a task holds the edits of a conversation, some bytes a row, and never its texts.

Scale: two shuffles of narrow rows and one of texts. A conversation's SHA-256 needs its bytes in order, so its texts stream through one task; nothing else
of it is in one place.

Defined results: a null role or text is one space; in the checksum a null id or turn is one space too. Rows of equal turn are in the order of role, then digest (SHA-256 of role
and text); repeated rows are duplicates. A null conv_id is a conversation of its own. A role's initial is its first character; an
empty role has none and is legal nowhere. An empty table gives an empty result. Extra columns are left alone. Nothing depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
DAMAGES = 20
#: Rows of a conversation that are searched at once.
PIECE = 256
#: States: nothing yet, after s, after u, after a.
STATES = 4
LEGAL_ENDS = (0, 3)
#: The end of a conversation searched as a whole.
WHOLE = -1
#: Initials that may follow each other.
ORDER = ("su", "ua", "au")
#: The role that an inserted or renamed row takes in each state, and the state it leads to.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: The states that can follow a state.
REACHED = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
#: Where a kept row leads, by state and initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FAULTS = ("blank", "duplicate", "truncated")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the checksum of conv_id and turn."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % DAMAGES).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.where("kind != 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return made.drop("col")


def last_letter(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def rows_of(damaged: DataFrame) -> DataFrame:
    """damaged with digest, initial and fault (1 blank, 2 duplicate, 3 truncated, 0 none)."""
    last = last_letter(F.col("text"))
    # a role's length keeps role and text apart
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    facts = damaged.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    return facts


def numbered(facts: DataFrame) -> DataFrame:
    """The narrow rows of facts, with fault."""
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    narrow = facts.select("conv_id", "turn", "role", "digest", "initial", "blank", "cut").withColumn("again", again)
    return narrow.select("conv_id", "turn", "role", "digest", "again", "initial", F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0).alias("fault"))


class Row(NamedTuple):
    initial: str
    fault: int


def suffix_bounds(rows: list[Row]) -> list[tuple[int, ...]]:
    """For each place and state the least that the rows from there on cost, were a conversation free to end anywhere."""
    bounds = [(0,) * STATES] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        rest = bounds[k + 1]
        least = [min(cost + rest[to] for _, cost, to in branches(rows[k], state)) for state in range(STATES)]
        bounds[k] = tuple(min(c, INSERT + least[NEXT[state][1]]) for state, c in enumerate(least))
    return bounds


def branches(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state."""
    yield "D", DELETE, state
    if row.fault in (1, 2):
        return
    extra = TRUNCATED if row.fault == 3 else 0
    if (kept := KEPT.get((state, row.initial))) is not None:
        yield "K", extra, kept
    if kept != NEXT[state][1]:  # else keeping does the same for less
        yield "R", REROLE + extra, NEXT[state][1]


def search(rows: list[Row], start: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """The cheapest edits of rows that lead from start to one of ends, as (cost, audit); None if there are none."""
    n, bounds, goal = len(rows), suffix_bounds(rows), set(ends)
    incumbent: tuple[int, str] | None = None
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if goal.isdisjoint(REACHED[state]) or incumbent and cost + bounds[at][state] > incumbent[0]:
            continue
        known = table[at].get(state)
        if known and known <= (cost, audit):
            continue
        table[at][state] = (cost, audit)
        if at == n and state in goal and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        out = [(at, NEXT[state][1], cost + INSERT, audit + "I")]
        if at < n:
            out += [(at + 1, to, cost + price, audit + edit) for edit, price, to in branches(rows[at], state)]
        # the last is taken first: the least bound, then the first in ASCII
        stack += sorted(out, key=lambda b: (b[2] + bounds[b[0]][b[1]], b[3]), reverse=True)
    return incumbent


def pieces_of(rows: list[Row], whole: bool) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit): of a whole conversation the one from its start to a legal end, otherwise between any two states."""
    if whole:
        cost, audit = search(rows, 0, LEGAL_ENDS)
        return [(0, WHOLE, cost, audit)]
    found = [(a, b, search(rows, a, (b,))) for a in range(STATES) for b in range(STATES)]
    return [(a, b, *f) for a, b, f in found if f]


SOLVED = "conv_id long, task int, run int, whole boolean, rows long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, starts array<int>, ends array<int>, costs array<long>, audits array<string>"


def solved(narrow: DataFrame) -> DataFrame:
    """A row for each run of at most PIECE rows of a conversation in a task: its place (task, run), counts, initials at its ends and cheapest edits."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("task", pa.int32()), ("run", pa.int32()), ("whole", pa.bool_()), ("rows", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
        + [(c, pa.int64()) for c in (*FAULTS, "illegal")]
        + [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, list] = {}  # of the rows' facts: equal conversations are searched once
        out: list[tuple] = []
        held: list[Row] = []
        key, open_, runs = None, False, 0  # open_: the conversation may have rows in another task, or has been cut already

        def flush(more: bool) -> None:
            nonlocal held, runs, open_
            whole = not (open_ or more)
            facts = (tuple(held), whole)
            if facts not in done:
                if len(done) > 2000:
                    done.clear()
                done[facts] = pieces_of(held, whole)
            found = done[facts]
            faults = [sum(r.fault == k for r in held) for k in (1, 2, 3)]
            illegal = sum(a.initial + b.initial not in ORDER for a, b in zip(held, held[1:], strict=False))
            out.append((key, task, runs, whole, len(held), held[0].initial, held[-1].initial, *faults, illegal, *map(list, zip(*found, strict=True))))
            held, runs, open_ = [], runs + 1, open_ or more

        def shown() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        task, seen = 0, False
        for batch in batches:
            for conv, number, initial, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                task = number
                if not seen or conv != key:
                    if held:
                        flush(False)
                    key, open_, runs, seen = conv, not seen, 0, True  # the first conversation of a task may have begun in another
                elif len(held) == PIECE:
                    flush(True)
                held.append(Row(initial, fault))
                if len(out) >= 1000:
                    yield shown()
                    out = []
        if held:
            open_ = True  # the last one may go on in another
            flush(False)
        if out:
            yield shown()

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "again"]
    spread = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(spread.select("conv_id", F.spark_partition_id().alias("task"), "initial", "fault"), run, SOLVED)


class Path(NamedTuple):
    """The cheapest edits that lead to a state; earlier ones are in before."""

    cost: int
    depth: int
    audit: str
    before: Path | None


def _first(a: Path, b: Path) -> bool:
    """Whether a is better than b: less cost, or as much and the audit that comes first."""
    if a.cost != b.cost:
        return a.cost < b.cost
    ends_a, ends_b = [], []
    while a is not b:  # the same depth
        ends_a.append(a.audit)
        ends_b.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(ends_a)) < "".join(reversed(ends_b))


class Chain:
    """A conversation's runs, put together as they come: for each state the cheapest edits that lead to it."""

    def __init__(self) -> None:
        self.paths, self.depth, self.totals, self.last = {0: Path(0, 0, "", None)}, 0, [0] * (len(FAULTS) + 1), None

    def add(self, run: dict) -> None:
        self.depth += 1
        self.totals = [t + run[c] for t, c in zip(self.totals, (*FAULTS, "illegal"), strict=True)]
        if self.last is not None and self.last + run["first_initial"] not in ORDER:
            self.totals[-1] += 1
        self.last = run["last_initial"]
        met: dict[int, Path] = {}
        for start, end, cost, audit in zip(run["starts"], run["ends"], run["costs"], run["audits"], strict=True):
            if start in self.paths:
                new = Path(self.paths[start].cost + cost, self.depth, audit, self.paths[start])
                if end not in met or _first(new, met[end]):
                    met[end] = new
        self.paths = met

    def best(self) -> tuple[int, str]:
        """(cost, audit); a run that was whole has its legal end already."""
        last: Path | None = None
        for end in (WHOLE, *LEGAL_ENDS):
            if end in self.paths and (last is None or _first(self.paths[end], last)):
                last = self.paths[end]
        cost, parts = last.cost, []
        while last:
            parts.append(last.audit)
            last = last.before
        return cost, "".join(reversed(parts))


class Edited:
    """A conversation's repaired rows, hashed as its rows come by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.rows = audit, 0, 0, hashlib.sha256(), 0

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.rows += 1

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = NEXT[self.state]
            self.put(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self.put(role, text)
        elif edit == "R":
            role, self.state = NEXT[self.state]
            self.put(role, text)

    def end(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repaired(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with a row."""
    of_run = ["task", "run", "whole", "first_initial", "last_initial", *FAULTS, "illegal", "starts", "ends", "costs", "audits"]
    none = {"turn": "long", "role": "string", "text": "string", "digest": "binary"}
    heads = runs.select("conv_id", F.lit(0).alias("kind"), F.struct(*of_run).alias("head"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    body = facts.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), *none)
    both = heads.unionByName(body).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "kind", "head.task", "head.run", F.asc_nulls_first("turn"), "role", "digest")
    counts = [*FAULTS, "illegal", "cost"]
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, chain, now, seen = None, Chain(), None, False
        report: tuple = ()

        def shown() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv, kind, head, role, text in zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)], strict=True):
                if not seen or conv != key:
                    if seen:
                        out.append((key, *report, now.end()))
                    key, chain, now, seen = conv, Chain(), None, True
                if kind == 0:
                    chain.add(head)
                    continue
                if now is None:
                    cost, audit = chain.best()
                    report, now = (*chain.totals, cost, audit), Edited(audit)
                now.row(role, text)
            if len(out) >= 1000:
                yield shown()
                out = []
        if seen:
            out.append((key, *report, now.end()))
        if out:
            yield shown()

    return map_arrow(both, run, f"conv_id long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Every conv_id of conversations, damaged and repaired: gaps, counts of faults, cost, audit and the hash of what the repair gives."""
    facts = rows_of(damage(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")))
    runs = written(solved(numbered(facts)), "runs")
    gaps = facts.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    done = repaired(facts, runs)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    whole = every.join(gaps, same(every, gaps), "left").drop(gaps["conv_id"]).join(done, same(every, done), "left").drop(done["conv_id"])
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
