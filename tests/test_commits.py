"""Manifests, acknowledged spools and kept-up centroids."""

import json
import random
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wharfline.operators import centroids, manifest
from wharfline.streaming.spool import Spool


def one(spark, n):
    return spark.createDataFrame([(n,)], "n long")


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Each writer counts up two tables five times; a reader sees both at the same count all the while."""
    tables = manifest.Tables(spark, f"file://{tmp_path}/t")
    tables.commit(tables.snapshot(), {"a": one(spark, 0), "b": one(spark, 0)})
    value = lambda s, name: s.table(name).first()[0]
    failed, torn = [], []

    def writer():
        try:
            for _ in range(5):
                tables.update(lambda s: {"a": one(spark, value(s, "a") + 1), "b": one(spark, value(s, "b") + 1)})
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=writer) for _ in range(2)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        s = tables.snapshot()
        torn += [s.number] if value(s, "a") != value(s, "b") else []
    for t in threads:
        t.join()
    last = tables.snapshot()
    assert failed == [] and torn == []
    assert (value(last, "a"), value(last, "b"), last.number) == (10, 10, 11)


def test_conflicts_and_unrelated_tables(spark, tmp_path):
    tables = manifest.Tables(spark, f"file://{tmp_path}/t")
    base = tables.commit(tables.snapshot(), {"a": one(spark, 1), "b": one(spark, 1)})
    tables.commit(base, {"a": one(spark, 2)})
    with pytest.raises(manifest.Conflict):
        tables.commit(base, {"a": one(spark, 3)})
    worked = []

    def work(s):
        worked.append(s.number)
        if len(worked) == 1:  # another writer is first
            tables.commit(s, {"a": one(spark, 7)})
        return {"b": s.table("b").select((F.col("n") + 1).alias("n"))}

    now = tables.update(work, reads=["b"])
    assert worked == [2] and (now.table("a").first()[0], now.table("b").first()[0]) == (7, 2)
    assert tables.snapshot(1).table("a").first()[0] == 1
    assert tables.vacuum(keep=1) == 4 and tables.numbers() == [now.number]
    assert now.table("a").first()[0] == 7
    assert not list(Path(tmp_path, "t", "manifests").glob(".??????????????????????????????*"))


def payload(k, messages=2, **more):
    return {"source": "s", "dataClass": "work", "project": {"externalId": "p"}, "session": {"externalId": f"c{k}"}, "messages": [{"externalId": f"m{i}", "role": "user", "content": f"text {k} {i}"} for i in range(messages)]} | more


@pytest.fixture
def spooled(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.json").write_text(json.dumps(payload(k)))
    (folder / "bad.json").write_text("{broken")
    (folder / "lacking.json").write_text(json.dumps(payload(9, project=None)) + "\n" + json.dumps(payload(10)))
    return folder, Spool(spark, f"file:{folder}", f"file:{tmp_path}/tables", f"file:{tmp_path}/archive", "*.json")


def contents(spool):
    return sorted((r.session_id, r.external_id) for r in spool.messages().collect())


WANTED = sorted((f"c{k}", f"m{i}") for k in (*range(6), 10) for i in range(2))


def test_spool_is_emptied(spooled):
    folder, spool = spooled
    done = spool.drain(pass_files=3)
    assert (done.passes, done.files, done.errors) == (3, 8, [])
    assert contents(spool) == WANTED and list(folder.glob("*.json")) == []
    assert sorted((r.stage, r.line_number) for r in spool.letters().collect()) == [("insert", 1), ("parse", 1)]
    assert len([p for p in (folder.parent / "archive").iterdir() if p.suffix == ".json"]) == 8
    (folder / "1.json").write_text(json.dumps(payload(1, 3)))
    assert spool.drain().files == 1 and len(contents(spool)) == len(WANTED) + 1


@pytest.mark.parametrize("step", ["acknowledge", "remove"])
def test_a_run_that_ends_between_two_steps(spooled, monkeypatch, step):
    """After the messages are written, or after the acknowledgement, everything stops. The next run finds each message once, and opens no file that was acknowledged."""
    folder, spool = spooled

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(spool, step, lost if step == "acknowledge" else lambda files: lost() if files.count() else [])
    with pytest.raises(KeyboardInterrupt):
        spool.drain()
    assert contents(spool) == WANTED and len(list(folder.glob("*.json"))) == 8
    monkeypatch.undo()
    if step == "remove":
        monkeypatch.setattr(spool, "store", lost)  # nothing is read
    assert spool.drain().errors == []
    assert contents(spool) == WANTED and list(folder.glob("*.json")) == [] and spool.letters().count() == 2


def test_a_pass_without_progress_is_the_last(spooled, monkeypatch):
    folder, spool = spooled

    def failing(*_):
        raise OSError("table unreachable")

    monkeypatch.setattr(spool, "store", failing)
    done = spool.drain()
    assert (done.passes, done.files, done.errors) == (1, 0, ["table unreachable"]) and len(list(folder.glob("*.json"))) == 8


def test_centroids_after_deltas_equal_a_full_run(spark):
    rnd, rng = random.Random(1), np.random.default_rng(1)
    rows = [(k, rnd.choice([None, "a", "b", "c", "d"]), [float(x) for x in rng.normal(size=5).astype(np.float32)]) for k in range(400)] + [(900, "a", None), (901, "gone", [1.0] * 5)]
    frame = lambda some: spark.createDataFrame(some, "id long, key string, v array<float>").repartition(3)
    state = centroids.state_of(frame(rows), "key", "v")
    gone, new = [r for r in rows if r[0] % 5 == 0 or r[1] in ("gone", "d")], [(k, "e", [float(k), 1.0, 0.0, 2.0, -1.0]) for k in range(3)]
    state = centroids.applied(state, "key", "v", frame(new), frame(gone))
    state = centroids.applied(state, "key", "v", added=frame(gone[:7]))
    kept = [r for r in rows if r not in gone] + new + gone[:7]
    show = lambda df: {r.key: (r.n, [round(x, 9) for x in r.centroid]) for r in df.collect()}
    full = show(centroids.centroids(frame(kept), "key", "v"))
    assert show(centroids.final(state, "key")) == full and "gone" not in full
    by = {}
    for _, key, v in kept:
        if v is not None:
            by.setdefault(key, []).append(v)
    for key, (n, centroid) in full.items():
        mean = np.mean(np.array(by[key]), axis=0)
        assert n == len(by[key]) and np.allclose(centroid, mean / np.linalg.norm(mean))


def test_a_delta_reads_its_own_keys_alone(spark, capsys):
    state = spark.createDataFrame([("a", 2, [1.0, 2.0]), ("b", 1, [3.0, 4.0])], "key string, n long, sums array<double>")
    delta = spark.createDataFrame([("a", [1.0, 1.0])], "key string, v array<float>")
    assert sorted(map(tuple, centroids.applied(state, "key", "v", delta).collect())) == [("a", 3, [2.0, 3.0]), ("b", 1, [3.0, 4.0])]
    with pytest.raises(Exception, match="dimensions"):
        centroids.applied(state, "key", "v", spark.createDataFrame([("a", [1.0])], "key string, v array<float>")).collect()
