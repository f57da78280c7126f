"""Quiet sessions as a stream, stopped and started again, against all rows at once."""

import random

import numpy as np
from pyspark.sql import functions as F

from wharfline.streaming import quiet

MINUTE = 60 * 1_000_000


def plain(rows, until):
    """Every run of a session that ended QUIET before `until`, with the characters up to its end."""
    out, by = set(), {}
    for s, at, chars in rows:
        if s is not None and at is not None:
            by.setdefault(s, []).append((at, chars or 0))
    for s, mine in by.items():
        mine.sort()
        total = 0
        for k, (at, chars) in enumerate(mine):
            total += chars
            if (k + 1 == len(mine) or mine[k + 1][0] - at >= quiet.QUIET) and at + quiet.QUIET <= until:
                out.add((s, at, total))
    return out


def test_restart_loses_and_doubles_nothing(spark, tmp_path):
    rnd = random.Random(1)
    start = 1_700_000_000_000_000
    rows, at = [], start
    for _ in range(600):
        at += rnd.choice([0, 1, 5, 29, 30, 31, 90]) * MINUTE // 7
        rows.append((rnd.choice([1, 2, 3, 4, None]), at - rnd.randrange(0, 40) * MINUTE, rnd.choice([1, 10, None])))  # up to 40 minutes late
    rows.append((99, at, 1))
    folder = f"{tmp_path}/in"
    for a, b in ((0, 150), (150, 151), (151, 480), (480, 601)):
        frame = spark.createDataFrame(rows[a:b], "session_id long, us long, chars long").select("session_id", F.timestamp_micros("us").alias("at"), "chars")
        frame.repartition(3).write.mode("append").parquet(folder)
        quiet.run_due_sessions(spark.readStream.schema(frame.schema).parquet(folder), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = [(r.session_id, r.us, r.content_chars) for r in spark.read.parquet(f"{tmp_path}/out").withColumn("us", F.unix_micros("ended_at")).collect()]
    newest = max(r[1] for r in rows)
    assert len(got) == len(set(got))
    assert set(got) == plain(rows, newest - 60 * MINUTE)


def test_runs_join_in_any_order():
    runs = [(0, 0, 1), (20 * MINUTE, 20 * MINUTE, 2), (50 * MINUTE, 50 * MINUTE, 4), (79 * MINUTE, 90 * MINUTE, 8)]
    for seed in range(5):
        some = runs[:]
        random.Random(seed).shuffle(some)
        assert quiet.joined(some) == [(0, 20 * MINUTE, 3), (50 * MINUTE, 90 * MINUTE, 12)]


def test_sessions_share_calls_of_python(spark, tmp_path, monkeypatch):
    """Python is called for a share of the sessions, not for each, with what a plain version gives: sessions that grow, pause and stop beside each other, over pieces and batches."""
    monkeypatch.setattr(quiet, "SHARES", 3)
    monkeypatch.setattr(quiet, "ROWS", 8)
    calls, real = spark.sparkContext.accumulator(0), quiet.step

    def counted(key, pieces, state):
        calls.add(1)
        return real(key, pieces, state)

    monkeypatch.setattr(quiet, "step", counted)
    rnd = random.Random(5)
    start = 1_700_000_000_000_000
    rows = sorted(((-s if s % 7 == 0 else s, start + rnd.randrange(0, 1200) * MINUTE, rnd.randrange(1, 9)) for s in range(1, 121) for _ in range(rnd.randrange(1, 12))), key=lambda r: r[1])
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        frame = spark.createDataFrame(part, "session_id long, us long, chars long").select("session_id", F.timestamp_micros("us").alias("at"), "chars")
        frame.repartition(4).write.mode("append").parquet(f"{tmp_path}/in")
        quiet.run_due_sessions(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = [(r.session_id, r.us, r.content_chars) for r in spark.read.parquet(f"{tmp_path}/out").withColumn("us", F.unix_micros("ended_at")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, rows[-1][1] - 60 * MINUTE)
    assert calls.value <= 3 * 4  # shares, and a batch with rows and one without in each run


def test_runs_of_pieces_are_those_of_all_at_once(monkeypatch):
    """One share's rows in pieces of any size leave the runs of each session on its own."""
    rnd = random.Random(6)
    rows = np.array([(rnd.randrange(5), t := rnd.randrange(0, 3000) * MINUTE, t, rnd.randrange(9)) for _ in range(400)]).T
    at_once = quiet.merged(rows)
    some = np.empty((4, 0), np.int64)
    for k in range(0, 400, 37):
        some = quiet.merged(np.concatenate([some, rows[:, k : k + 37]], axis=1))
    assert some.tolist() == at_once.tolist()
    for s in range(5):
        assert quiet.joined([tuple(r) for r in rows[1:, rows[0] == s].T.tolist()]) == [tuple(r) for r in at_once[1:, at_once[0] == s].T.tolist()]
    assert quiet.joined([]) == []
