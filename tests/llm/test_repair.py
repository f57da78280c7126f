"""Repair of conversations against plain dynamic programming, which is held against every edit of short ones."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from oracle import connect
from oracle import rows as frame_rows
from plain import sha

from wharfline.llm import conversation_repair as repair
from wharfline.llm import queries
from wharfline.llm.oracles import ORACLE_SQL

STOPS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows (turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(STOPS)[-1:]
        out.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit) by going from row to row with the best prefix of each string of roles' last part."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def insert(best):
        for _ in range(2):
            for q, (cost, audit, roles) in list(best.items()):
                c = "a" if q == "u" else "u"
                new = (cost + 2, audit + "I", [*roles, ("user" if c == "u" else "assistant", "")])
                if step.get((q, c)) == c and (c not in best or new[:2] < best[c][:2]):
                    best[c] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), f in zip(rows, fault, strict=True):
        new = {}
        for q, (cost, audit, made) in insert(best).items():
            options = [(3, "D", q, [])]
            if f not in (1, 2):
                options += [(f == 3, "K", step[q, role[:1]], [(role, text)])] if (q, role[:1]) in step else []
                options += [(2 + (f == 3), "R", step[q, r[0]], [(r, text)]) for r in ("user", "assistant") if (q, r[0]) in step]
            for price, letter, to, row in options:
                got = (cost + price, audit + letter, made + row)
                if to not in new or got[:2] < new[to][:2]:
                    new[to] = got
        best = new
    return min((v for q, v in insert(best).items() if q in ("", "a")), key=lambda v: v[:2])


def every_edit(rows, fault):
    """The same by trying every edit, with up to two insertions at each place."""
    found = []
    for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, roles, fine = 0, "", "", True
            for k in range(len(rows) + 1):
                cost, audit, roles = cost + 2 * len(inserts[k]), audit + "I" * len(inserts[k]), roles + inserts[k]
                if k < len(rows):
                    e = edits[k]
                    fine &= e == "D" or fault[k] not in (1, 2)
                    cost += (3 if e == "D" else 2 if e in "ua" else 0) + (e != "D" and fault[k] == 3)
                    audit += "R" if e in "ua" else e
                    roles += "" if e == "D" else e if e in "ua" else (rows[k][1][:1] or "?")
            if fine and re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def plain(conversations):
    by = {}
    for row in conversations:
        by.setdefault(row[0], []).append(row)
    out = []
    for conv, mine in by.items():
        rows = damaged(mine)
        fault, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
        cost, audit, made = cheapest(rows, fault)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out.append((conv, gaps, *[fault.count(k) for k in (1, 2, 3)], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made))))
    return sorted(out, key=str)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def done(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def talk(rnd, conv, n, nulls=True):
    texts = ["Yes.", "No!", "Well, then", "", "  \n", "Why?", "Ünd so weiter.", None]
    roles = ["system", "user", "assistant", "tool", "", None, "s"]
    turn = lambda k: rnd.choice([k, k, k, k + 1, k * 2, None]) if nulls else k
    return [(conv, turn(k), rnd.choices(roles, [2, 9, 9, 1, 1, 1, 1])[0], rnd.choice([f"Text {k}.", f"Text {k}", *texts])) for k in range(n)]


def frame(spark, rows, partitions=4):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    return df.withColumns({"kind": F.lit("k"), "head": F.lit(1), "digest": F.lit("d"), "cost": F.lit(None).cast("string"), "gaps": F.lit(2)})


def test_plain_version_against_every_edit():
    rnd = random.Random(1)
    for _ in range(60):
        rows = [(k, rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["Yes.", "No", ""])) for k in range(rnd.randrange(0, 4))]
        fault = [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in rows]
        assert cheapest(rows, fault)[:2] == every_edit(rows, fault)


def test_random_conversations(spark):
    rnd = random.Random(2)
    rows = [r for conv in range(150) for r in talk(rnd, conv, rnd.randrange(1, 12))] + [r for conv in (500, 501) for r in talk(rnd, conv, 60)] + talk(rnd, None, 9)
    assert done(repair.repair(frame(spark, rows))) == plain(rows)


def test_conversations_cut_between_tasks_and_runs(spark, monkeypatch):
    """One conversation has most of the rows: it lies in several tasks, in runs of seven rows."""
    monkeypatch.setattr(repair, "PIECE", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rnd = random.Random(3)
    rows = talk(rnd, 5, 600, nulls=False) + [r for conv in range(10) for r in talk(rnd, conv + 6, rnd.randrange(1, 30))]
    runs = repair.solved(repair.numbered(repair.rows_of(repair.damage(frame(spark, rows).drop("kind", "head", "digest", "cost", "gaps")))))
    assert runs.where("conv_id = 5").select("task").distinct().count() > 1 and runs.where("conv_id = 5").count() > 80
    try:
        assert done(repair.repair(frame(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_given_table(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    made = queries.op12_repair(spark, sf)
    assert done(made) == plain(rows)
    assert frame_rows(made.toPandas()) == frame_rows(connect(sf).sql(ORACLE_SQL["op12_repair"]).df())


@pytest.mark.parametrize("roles", ["u", "ua", "au", "sut", "a", "us", "t"])
def test_search_is_exact_and_quick(roles):
    """Long runs with every kind of trouble: the search proves its optimum without going through most prefixes."""
    rnd = random.Random(roles)
    name = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(k, name[rnd.choice(roles)], "") for k in range(repair.PIECE)]
    fault = [rnd.choice([0, 0, 0, 0, 1, 2, 3]) for _ in rows]
    began = time.time()
    assert repair.search([repair.Row(r[1][:1], f) for r, f in zip(rows, fault, strict=True)], 0, repair.LEGAL_ENDS) == cheapest(rows, fault)[:2]
    assert time.time() - began < 5


def test_empty_table_and_long_text(spark):
    assert repair.repair(frame(spark, [])).collect() == []
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "word " * 300_000 + str(k) + ".") for k in range(6)]
    assert done(repair.repair(frame(spark, rows))) == plain(rows)
