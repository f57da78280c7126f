"""Whole syncs, control of jobs, rendering, registered functions."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import line, transcript  # noqa: F401

from wharfline import render, sync
from wharfline.functions.register import register
from wharfline.operators import reports
from wharfline.sources import transcripts
from wharfline.streaming import control

NOW = datetime(2024, 6, 1, 12)


def test_sync_twice(spark, transcript):  # noqa: F811
    now = F.expr("timestamp '2024-06-01 00:00:00'")
    tables, report = sync.sync(spark, str(transcript), sync.Tables.empty(spark), now)
    assert (report.files, report.lines, report.messages, report.bad) == (2, 7, 4, 1)
    assert sorted((r.session_id, r.message_count) for r in tables.sessions.collect()) == [("S", 3), ("agent-7", 1)]
    again, report = sync.sync(spark, str(transcript), tables, now)
    assert report.files == 0 and again.messages.count() == 4 and again.letters.first().attempts == 1
    with (transcript / "deep" / "S.jsonl").open("a") as f:
        f.write("\n" + line(uuid="u9"))
    os.utime(transcript / "deep" / "S.jsonl", (2_000_000_000, 2_000_000_000))
    grown, report = sync.sync(spark, str(transcript), again, now)
    assert report.files == 1 and grown.messages.count() == 5
    assert grown.letters.first().attempts == 2


def test_unchanged_files_are_not_opened(spark, transcript, monkeypatch):  # noqa: F811
    """After a sync every file's bytes are others, of the same length and time: nothing is noticed, since nothing is read."""
    now = F.expr("timestamp '2024-06-01 00:00:00'")
    tables, _ = sync.sync(spark, str(transcript), sync.Tables.empty(spark), now)
    for path in transcript.rglob("*.jsonl"):
        stat = path.stat()
        path.write_bytes(b"x" * stat.st_size)
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    asked = []
    real = spark.read.__class__.text
    monkeypatch.setattr(spark.read.__class__, "text", lambda self, paths, *a, **b: asked.append(paths) or real(self, paths, *a, **b))
    again, report = sync.sync(spark, str(transcript), tables, now)
    assert (report.files, report.lines, report.bad, asked) == (0, 0, 0, [])
    assert again.messages.count() == 4 and report.errors == []


def test_listing_asks_for_no_content(spark, transcript, capsys):  # noqa: F811
    found, errors = transcripts.discover(spark, [str(transcript)])
    assert errors == [] and sorted((r.file_path.rsplit("/", 1)[1], r.size) for r in found.collect()) == [(p.name, p.stat().st_size) for p in sorted(transcript.rglob("*.jsonl"), key=lambda p: p.name)]
    found.explain("formatted")
    assert "content" not in capsys.readouterr().out


def test_folders_that_fail_are_named(spark, transcript, monkeypatch):  # noqa: F811
    """One folder cannot be listed: its error is kept, the files of the others are found."""
    gone = str(transcript / "gone")
    found, errors = transcripts.discover(spark, [str(transcript / "deep"), gone, str(transcript)])
    assert found.select("file_path").distinct().count() == 2
    assert [e[0] for e in errors] == [gone] and "gone" in errors[0][1]
    real = transcripts.discover
    monkeypatch.setattr(transcripts, "discover", lambda s, roots, glob: real(s, [*roots, gone], glob) if roots == [str(transcript)] else real(s, [*roots, gone], glob))
    _, report = sync.sync(spark, str(transcript), sync.Tables.empty(spark), F.expr("timestamp '2024-06-01 00:00:00'"))
    assert report.files == 1 and [e[0] for e in report.errors] == [gone]


def test_lines_of_byte_ranges_are_numbered(spark, tmp_path):
    """Files read in ranges of some hundred bytes, with names that are patterns and need encoding, blank lines and other line ends."""
    wanted = set()
    for name in ("plain.jsonl", "a b+c%20é.jsonl", "[x]{y}*.jsonl", "empty.jsonl"):
        rows = [] if name.startswith("empty") else [f"{name} line {k} " + "é" * (k % 37) if k % 5 else "" for k in range(300)]
        (tmp_path / name).write_bytes(("\r\n" if name.startswith("plain") else "\n").join(rows).encode())
        wanted |= {(name, k + 1, r) for k, r in enumerate(rows) if r.strip()}
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = [(r.file_path.rsplit("/", 1)[1], r.line_number, r.line) for r in transcripts.lines(spark, str(tmp_path)).collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == len(wanted) and set(got) == wanted


def test_stand_down(spark, tmp_path):
    path = f"file://{tmp_path}/control"
    assert not control.standing_down(spark, path, NOW)
    assert control.stand_down(spark, path, NOW, 999) == NOW + timedelta(minutes=240)
    assert control.standing_down(spark, path, NOW) and not control.standing_down(spark, path, NOW + timedelta(minutes=241))
    control.resume(spark, path)
    assert not control.standing_down(spark, path, NOW)


def test_registered_functions(spark):
    assert set(register(spark)) >= {"cosine_sim", "strip_scaffolding"}
    row = spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 1D)) AS c, simple_terms('A-b c') AS t, strip_scaffolding('<command-args>q</command-args>') AS s, rank_share(1) AS r").first()
    assert (round(row.c, 4), row.t, row.s, row.r) == (0.7071, ["a", "b", "c"], "q", 1 / 61)
    spark.range(1).createOrReplaceTempView("here")
    assert control.present(spark, ["here", "nowhere"]) == {"here": True, "nowhere": False}


def test_render(spark):
    found = spark.createDataFrame([(1, "T", 7, "s", NOW, 0.5, "message", "snip")], "session_id long, title string, project_id long, source_name string, started_at timestamp, score double, matched_tier string, snippet string")
    assert render.hits(found, [7]).startswith("1. T [CURRENT PROJECT]") and render.hits(found.limit(0)) == "No results."
    page = spark.createDataFrame([(2, 1, "user", "b", False), (1, 0, "user", "a", True)], "id long, sequence_num long, role string, content_text string, truncated boolean")
    assert render.page(page, 2) == "[USER] #1 (cut)\na\n\n[USER] #2\nb\n\ncontinue at offset 2"
    drifted = reports.drift(spark.createDataFrame([("f", 5, 3, 3, 0)], "k string, parsed long, stored long, counted long, quarantined long"))
    assert render.drift(drifted) == ("missing-rows: f by 2", 1)
    assert render.counts({"a": 1}, "Health") == "Health\n  a  1"


@pytest.mark.parametrize("minutes", [None, 0, 500])
def test_stand_down_is_clamped(spark, tmp_path, minutes):
    until = control.stand_down(spark, f"file://{tmp_path}/c", NOW, minutes)
    assert timedelta(minutes=1) <= until - NOW <= timedelta(minutes=240)


def test_texts_of_columns(spark):
    one = spark.range(1)
    said = lambda c: one.select(c.alias("t")).first().t
    assert [said(render.age(F.lit(n).cast("long"))) for n in (None, 0, 59, 60, 3599, 3600, 86399, 86400, 200000)] == ["never", "0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago"]
    entry = lambda k, s: F.struct(F.lit(k).alias("chunk_index"), F.lit(10 * k).alias("start_message_id"), F.lit(10 * k + 9).alias("end_message_id"), F.lit(500).alias("content_chars"), F.lit(s).alias("summary"))
    assert said(render.chunk(F.lit(7), entry(1, "About it."))) == "chunk [1] of session 7, messages 10-19, 500 chars\n\nAbout it."
    at = F.expr("timestamp_ntz '2024-05-06 07:00:00'")
    page = render.digest(F.lit(7), F.lit("Parser"), F.lit(2), at, F.lit(40), F.lit("Fixed."), F.lit(None).cast("string"), F.array(entry(2, " two \n lines"), entry(3, "x")), 2, F.lit(6))
    assert said(page) == "# Parser\nsession 7 | project 2 | 2024-05-06 | 40 messages\n\n## Summary\nFixed.\n\n## Chunks 2-3 of 6\n- [2] messages 20-29, 500 chars: two lines\n- [3] messages 30-39, 500 chars: x\nmore chunks from 4"
    bare = render.digest(F.lit(8), F.lit(None).cast("string"), F.lit(2), at, F.lit(1), F.lit(None).cast("string"), F.lit("said"), F.lit(None).cast("array<struct<chunk_index:int,start_message_id:int,end_message_id:int,content_chars:int,summary:string>>"), 0, F.lit(0))
    assert said(bare) == "# Session 8 (no title yet)\nsession 8 | project 2 | 2024-05-06 | 1 messages\n\n## Excerpt (no summary yet)\nsaid\n\nno chunks: read the whole session"
    state = render.health({"sessions": F.lit(9), "coverage": F.lit("88.9%")}, {"loopy": F.lit(0), "refusal": F.lit(2)}, {"newest session vector": F.lit(90), "newest message vector": F.lit(None).cast("long")})
    assert said(state) == "# Health\n- sessions: 9\n- coverage: 88.9%\n- bad summaries:\n  - refusal: 2\n- newest session vector: 1m ago\n- newest message vector: never"
    assert said(render.health({}, {"loopy": F.lit(0)}, {})) == "# Health\n- bad summaries:\n  - none"
    row = {"title": F.lit(""), "session_id": F.lit(3), "source_name": F.lit("s"), "started_at": at, "matched_tier": F.lit("chunk"), "score": F.lit(0.51234), "snippet": F.lit("so")}
    assert said(render.hit(F.lit(1), row, F.lit(True))) == "1. (untitled) [CURRENT PROJECT]\n   session 3, s, 2024-05-06, chunk, score 0.512\n   so"
