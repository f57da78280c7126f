"""Operators on small tables."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharfline.functions import text
from wharfline.operators import links, merge, pending, reading, reports, retrieval
from wharfline.sources import pushed, transcripts
from wharfline.streaming import jobs


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- ranks and search


def arms_of(spark, *lists):
    return spark.createDataFrame([(s, n) for ids in lists for n, s in enumerate(ids, 1)], "session_id long, rank long")


def test_fuse(spark):
    order = lambda *lists: [r[0] for r in retrieval.fuse(arms_of(spark, *lists)).orderBy(F.desc("score"), "session_id").collect()]
    assert order([10, 20, 30]) == [10, 20, 30]
    assert order([1, 2, 3], [2, 4, 5])[0] == 2
    assert order([9, 8, 7, 42], [42, 9])[:2] == [9, 42]
    assert order([100, 200, 300], [300, 100, 400]) == [100, 300, 200, 400]
    assert [r[1] for r in retrieval.fuse(arms_of(spark, [5, 6])).orderBy("session_id").collect()] == [1 / 61, 1 / 62]


def test_first_claim(spark):
    rows = [(1, 10, 1, "raw", None, 0), (1, 11, 1, None, "**head**", 3), (2, 12, 2, None, "h2", 3)]
    df = spark.createDataFrame(rows, "session_id long, message_id long, rank long, raw string, headline string, arm_priority int")
    assert values(retrieval.first_claim(df), "session_id", "message_id", "raw", "headline") == [(1, 10, "raw", "**head**"), (2, 12, None, "h2")]


def test_query_grammar():
    q = retrieval.parse_query('alpha "two words" beta or gamma -bad -"very bad"')
    assert q.any_of == [[["alpha"]], [["two", "words"]], [["beta"], ["gamma"]]]
    assert q.none_of == [["bad"], ["very", "bad"]]


def test_rank_prefers_more_and_rarer(spark):
    docs = spark.createDataFrame([(1, "rare common"), (2, "common common words"), (3, "common"), (4, "other"), (5, "common x")], "id long, t string")
    score = {r[0]: r[1] for r in retrieval.bm25(docs, ["rare", "common"], "t", ["id"]).select("id", "score").collect()}
    assert set(score) == {1, 2, 3, 5}
    assert score[1] == max(score.values())


def corpus(spark):
    sessions = spark.createDataFrame(
        [
            (1, 1, "s", "coding", "/w/a", "Old title", "Summary one. More", "2024-01-01", False, None), (2, 2, "s", "coding", "/w/b", None, "Fixed the parser. Then", "2024-01-02", False, None),
            (3, 3, "s", "personal", "/w/c", None, "Shopping", "2024-01-03", False, None), (4, 1, "s", "coding", "/w/a", None, None, "2024-01-04", False, None),
            (5, 1, "s", "coding", "/w/a", None, "Bot", "2024-01-05", True, None), (6, 1, "s", "coding", "/w/a", None, "Gone", "2024-01-06", False, "2024-01-07"),
        ],
        "session_id long, project_id long, source_name string, data_class string, project_path string, title string, summary string, started_at string, is_automated boolean, deleted_at string",
    ).withColumn("started_at", F.to_timestamp_ntz("started_at"))
    messages = spark.createDataFrame([(s * 10, s, f"the parser of session {s} failed. it was slow") for s in range(1, 7)], "id long, session_id long, content_text string")
    vectors = spark.createDataFrame([(s * 10, s, [float(s == 1), float(s == 2), 0.1], f"raw {s}. x") for s in range(1, 7)], "id long, session_id long, embedding array<double>, raw string")
    centroid = spark.createDataFrame([(2, [0.0, 1.0, 0.0])], "session_id long, centroid array<double>")
    return retrieval.Corpus(sessions, messages, {"session": vectors, "message": vectors}, centroid)


def test_search_filters_and_tiers(spark):
    got = retrieval.search(corpus(spark), retrieval.SearchParams(query="parser", vector=[1.0, 0.0, 0.0])).collect()
    assert [r.session_id for r in got] == [1, 2]
    assert (got[0].title, got[0].title_source, got[0].matched_tier) == ("Old title", "source", "session")
    assert got[1].title == "Fixed the parser."
    assert "**parser**" in got[0].snippet
    everything = retrieval.SearchParams(query="parser", mode="text", classes=["*"], include_automated=True, include_unsummarized=True)
    assert {r.session_id for r in retrieval.search(corpus(spark), everything).collect()} == {1, 2, 3, 4, 5}


def test_search_boost_centroid_and_errors(spark):
    near = retrieval.SearchParams(query="parser", mode="text", cwd="/w/b/deep")
    first = retrieval.search(corpus(spark), near).first()
    assert first.session_id == 2 and first.score > 0.5
    assert retrieval.search(corpus(spark), retrieval.SearchParams(like_session=["2"], mode="semantic")).first().session_id == 2
    assert retrieval.search(corpus(spark), retrieval.SearchParams(query="parser", mode="text", exclude_terms="slow")).count() == 0
    with pytest.raises(ValueError, match="needs a query"):
        retrieval.search(corpus(spark), retrieval.SearchParams())


def test_classes():
    assert retrieval.resolve_classes() == ["coding"]
    assert retrieval.resolve_classes([" Coding ", "X"]) == ["coding", "x"]
    assert retrieval.resolve_classes(["*"]) is None
    assert retrieval.resolve_classes(source="s") is None
    with pytest.raises(ValueError, match="unknown"):
        retrieval.check_classes(["x"], ["coding"])
    retrieval.check_classes(["x"], [])


# --- reading


def pack(lengths: list[int], most: int = reading.CHUNK_CHARS) -> list[list[tuple[int, int, int]]]:
    """Chunks of pieces (message, from, to): in order, filled while they fit; a message over a chunk is cut into pieces. Each piece costs its length and an overhead."""
    piece = most - reading.PIECE_OVERHEAD
    chunks: list[list[tuple[int, int, int]]] = []
    room = 0
    for i, n in enumerate(lengths):
        for a in range(0, max(n, 1), piece):
            b = min(n, a + piece)
            if not chunks or b - a + reading.PIECE_OVERHEAD > room:
                chunks.append([])
                room = most
            chunks[-1].append((i, a, b))
            room -= b - a + reading.PIECE_OVERHEAD
    return chunks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=12), st.integers(11, 60))
def test_pack_covers_everything_in_order(lengths, most):
    chunks = pack(lengths, most)
    pieces = [p for c in chunks for p in c]
    assert [i for i, _, _ in pieces] == sorted(i for i, _, _ in pieces)
    for i, n in enumerate(lengths):
        mine = [(a, b) for j, a, b in pieces if j == i]
        assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
    assert all(sum(b - a + reading.PIECE_OVERHEAD for _, a, b in c) <= most for c in chunks)


def test_budget_page(spark):
    rows = [(1, 10, 0, "u", "a" * 60), (1, 11, 1, "u", "b" * 50), (2, 20, 0, "u", "c" * 500), (2, 21, 1, "u", "d"), (3, 30, 0, "u", None), (3, 31, 1, "u", "e" * 100)]
    df = spark.createDataFrame(rows, "session_id long, id long, sequence_num long, role string, content_text string")
    assert values(reading.budget_page(df, 100), "id", "truncated") == [(10, False), (20, True), (30, False), (31, False)]
    assert values(reading.page_summary(df, 100), "session_id", "shown", "exhausted", "next_offset") == [(1, 1, True, 1), (2, 1, True, 1), (3, 2, False, None)]


# --- merges


def test_merge_rules_and_idempotence(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 7)], "k long, s string, n long")
    new = spark.createDataFrame([(1, None, 1), (2, "b", 2), (3, "c", 3)], "k long, s string, n long")
    assert values(merge.merge_by_key(old, new, ["k"], {"n": merge.add}), "k", "s", "n") == [(1, "a", 6), (2, "b", 9), (3, "c", 3)]
    once = merge.insert_absent(old, new.unionByName(new), ["k"])
    assert values(once, "k", "n") == values(merge.insert_absent(once, new, ["k"]), "k", "n") == [(1, 5), (2, 7), (3, 3)]
    assert values(merge.soft_delete(old.withColumn("deleted_at", F.lit(None).cast("string")), new.where("k = 1"), ["k"], F.lit("now")), "k", "deleted_at") == [(1, "now"), (2, None)]


def test_unembeddable_counts_only_broken(spark):
    schema = "message_id long, collection string, failure_reason string, failure_detail string, retry_count long, updated_at string"
    old = spark.createDataFrame([(1, "c", "nan", None, 1, "a"), (2, "c", "noise", None, 0, "a")], schema)
    new = spark.createDataFrame([(1, "c", "nan", "d", 0, "b"), (2, "c", "noise", "d", 0, "b")], schema)
    assert values(merge.mark_unembeddable(old, new), "message_id", "retry_count", "updated_at") == [(1, 2, "b"), (2, 0, "b")]


def test_swap_and_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    merge.swap(spark.range(3), root)
    merge.swap(merge.current(spark, root).where("id > 0"), root)
    assert values(merge.current(spark, root), "id") == [(1,), (2,)]
    merge.snapshot_once(spark.range(1), f"{root}/snap")
    merge.snapshot_once(spark.range(9), f"{root}/snap")
    assert spark.read.parquet(f"{root}/snap").count() == 1


def payload(source="new", data_class="coding"):
    return {
        "source": source, "dataClass": data_class, "project": {"externalId": "p", "name": "P", "path": None}, "session": {"externalId": "s1", "title": "T", "startedAt": "2024-01-01T00:00:00Z", "endedAt": None},
        "messages": [{"externalId": f"m{i}", "role": "user", "content": "x" * i, "timestamp": "2024-01-01T00:00:00Z", "sequenceNum": i, "metadata": {}} for i in range(3)],
    }


def empty_tables(spark):
    make = lambda schema: spark.createDataFrame([], schema)
    return (make("name string, data_class string"), make("source_name string, project_id string, name string"), make("session_id string, project_id string, title string, message_count long, content_chars long"), make("session_id string, external_id string, role string, content_text string"))


def test_ingest_twice_is_once(spark):
    raw = spark.read.schema(pushed.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(payload(data_class=" Coding "))]))
    after = merge.ingest(pushed.flat(raw), *empty_tables(spark))
    again = merge.ingest(pushed.flat(raw), after["sources"], after["projects"], after["sessions"], after["messages"])
    for name in after:
        assert sorted(map(tuple, after[name].collect()), key=str) == sorted(map(tuple, again[name].collect()), key=str)
    assert values(after["sources"], "name", "data_class") == [("new", "coding")]
    assert values(after["sessions"], "session_id", "message_count", "content_chars") == [("s1", 3, 3)]
    unclassed = spark.read.schema(pushed.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(payload(data_class=None))]))
    with pytest.raises(ValueError, match="no data class"):
        merge.ingest(pushed.flat(unclassed), *empty_tables(spark))
    assert pushed.invalid(unclassed.withColumn("source", F.lit(None).cast("string"))).first().why == "no source"


# --- transcripts


def line(**more):
    return json.dumps({"type": "user", "uuid": "u1", "sessionId": "S", "timestamp": "2024-05-01T10:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "hello"}} | more)


@pytest.fixture
def transcript(tmp_path):
    assistant = {"role": "assistant", "model": "m-1", "usage": {"input_tokens": 3, "output_tokens": 4}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "answer"}, {"type": "tool_use", "name": "Run", "input": {"a": 1}}]}
    result = {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "out"}]}, {"type": "tool_result", "content": "more"}]}
    rows = [line(), "{broken", "", line(type="summary"), line(uuid="u2", type="assistant", timestamp="2024-05-01T09:00:00Z", message=assistant), line(uuid="u3", timestamp="1999-01-01T00:00:00Z"), line(uuid="u4", timestamp="2024-05-01T11:00:00Z", message=result)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "S.jsonl").write_text("\n".join(rows))
    (tmp_path / "agent-7.jsonl").write_text(line(uuid="a1"))
    return tmp_path


def test_transcripts(spark, transcript):
    found = transcripts.lines(spark, str(transcript))
    messages, bad = transcripts.parse(found)
    numbered = transcripts.number(messages)
    mine = [tuple(r) for r in numbered.where("uuid != 'a1'").orderBy("sequence_num").select("uuid", "role", "content_text", "tool_name", "thinking_text", "sequence_num").collect()]
    assert mine == [("u2", "tool", "answer", "Run", "hm", 0), ("u1", "user", "hello", None, None, 1), ("u4", "user", "out\nmore", None, None, 2)]
    assert values(bad, "line_number", "raw") == [(2, "{broken")]
    assert values(transcripts.sessions(messages), "session_id", "parent_session_id", "model", "total_output_tokens", "message_count") == [("S", None, "m-1", 4, 3), ("agent-7", "S", None, 0, 1)]


def test_incremental_quarantine_and_replay(spark, transcript):
    found = transcripts.lines(spark, str(transcript))
    stamps = found.select("file_path", "modified_at").distinct()
    assert transcripts.changed(found, stamps).count() == 0
    _, bad = transcripts.parse(found)
    now = F.expr("timestamp '2024-06-01 00:00:00'")
    letters = transcripts.dead_letters(bad, "t", now)
    twice = merge.quarantine(letters, letters)
    assert values(twice, "record_key", "attempts", "resolved_at") == [("line-2", 2, None)]
    messages, still = transcripts.replay(twice)
    assert (messages.count(), still.count()) == (0, 1)


def test_history(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"display": "x", "timestamp": 1714557600000, "project": "/w"}\nnope\n{"display": "y", "timestamp": 5}\n')
    assert tuple(transcripts.history(spark, str(tmp_path / "h.jsonl")).first()) == (3, 1, 1, 1)


# --- links, pending, reports


def test_parent_links_refuse_cycles(spark):
    links_ = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "session_id long, parent_id long")
    assert values(links.cyclic(links_), "session_id") == [(1,), (2,), (3,)]
    s = spark.createDataFrame([(k, None) for k in range(1, 7)], "session_id long, parent_id long")
    done = links.apply_links(s, links_)
    assert values(done.where("parent_id IS NOT NULL"), "session_id", "parent_id") == [(4, 1), (5, 6)]
    assert done.count() == links.revert_links(done, links_).where("parent_id IS NULL").count()


def test_deep_chains_are_no_cycles(spark):
    chain = [(k, k + 1) for k in range(300)]
    into_cycle = [(1000 + k, 1001 + k) for k in range(300)] + [(1300, 1298)]
    links_ = spark.createDataFrame(chain + into_cycle, "session_id long, parent_id long")
    assert values(links.cyclic(links_), "session_id") == [(1298,), (1299,), (1300,)]
    assert links.cyclic(links_.where("session_id < 1000")).count() == links.cyclic(links_.limit(0)).count() == 0


def test_merge_projects(spark):
    projects = spark.createDataFrame([(1, "s", "d", "D:/w", "m1", True), (2, "s", "e", "/mnt/d/W", "m1", True), (3, "s", "f", "/home", "m1", True), (4, "s", "g", "raw", "m1", True)], "project_id long, source string, external_id string, path string, machine string, windows_host boolean")
    sessions = spark.createDataFrame([(1, 1, "/x"), (2, 2, "/x"), (3, 2, "/x"), (4, 3, "/home")], "session_id long, project_id long, cwd string")
    kept, moved = links.merge_projects(projects, sessions)
    assert values(kept, "project_id") == [(2,), (3,), (4,)]
    assert values(moved, "session_id", "project_id") == [(1, 2), (2, 2), (3, 2), (4, 3)]
    two = projects.withColumn("machine", F.concat(F.lit("m"), F.col("project_id").cast("string"))).withColumn("windows_host", F.col("project_id") != 1)
    with pytest.raises(ValueError, match="cannot merge"):
        links.merge_projects(two, sessions)


def test_repath(spark):
    projects = spark.createDataFrame([(1, "s", "-home-u", None, "m", False), (2, "s", "x", "d:\\p\\", "m", False)], "project_id long, source string, external_id string, path string, machine string, windows_host boolean")
    sessions = spark.createDataFrame([(1, 1, "/home/u"), (2, 1, "/home/u/"), (3, 1, "/other")], "session_id long, project_id long, cwd string")
    assert values(links.repath(projects, sessions), "project_id", "new_path") == [(1, "/home/u"), (2, "D:/p")]


def test_pending_counts_what_it_selects(spark):
    messages = spark.createDataFrame([(1, "user", "long enough text"), (2, "tool", "long enough text"), (3, "user", "short"), (4, "user", "again, long enough")], "id long, role string, content_text string")
    done = spark.createDataFrame([(1, "nan", 1, "2024-01-01"), (4, "nan", 3, "2024-01-01")], "message_id long, failure_reason string, retry_count long, updated_at string").withColumn("updated_at", F.to_timestamp_ntz("updated_at"))
    assert values(pending.pending_messages(messages, done, F.expr("timestamp_ntz '2024-02-01 00:00:00'")), "id") == [(1,)]
    assert pending.pending_messages(messages, done).count() == 0


@pytest.mark.parametrize(
    ("given_", "state", "eta"),
    [((1000, 600, 60, 0, 0), "draining", 6667), ((5, 1, 9, 0, 0), "falling-behind", None), ((5, 3, 3, 0, 0), "holding", None), ((5, 0, 3, 4, 1), "summarizing", None), ((0, 0, 0, 4, 0), "caught-up", 0), ((5, 0, 0, 4, 0), "stalled", None)],
)
def test_queue_state(spark, given_, state, eta):
    made = reports.queue_state(*[F.lit(v) for v in given_], 60)
    assert tuple(spark.range(1).select(made["state"].alias("s"), made["seconds_remaining"].alias("e")).first()) == (state, eta)


@pytest.mark.parametrize(("counts", "wanted"), [((5, 5, 5, 0), "none"), ((5, 3, 3, 1), "missing-rows"), ((5, 3, 3, 2), "none"), ((5, 6, 6, 0), "surplus-rows"), ((5, 5, 4, 0), "stale-stats")])
def test_drift(spark, counts, wanted):
    df = spark.createDataFrame([counts], "parsed long, stored long, counted long, quarantined long")
    assert reports.drift(df).first().drift == wanted


# --- streams


def test_spool_is_idempotent(spark, tmp_path):
    root, spool = f"file://{tmp_path}/messages", tmp_path / "spool"
    spool.mkdir()
    for n in range(2):
        (spool / f"{n}.json").write_text(json.dumps(payload()))
        jobs.spool_messages(spark, str(spool), root, f"{tmp_path}/checkpoint")
    assert jobs.spooled(spark, root).count() == 3


def test_readers_during_swaps(spark, tmp_path):
    """A reader that loops while versions are swapped always finds one of them."""
    import threading

    root, seen, failed, stop = f"file://{tmp_path}/t", set(), [], threading.Event()
    merge.swap(spark.range(1), root)

    def read():
        while not stop.is_set():
            try:
                seen.add(merge.current(spark, root).count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 8):
        merge.swap(spark.range(n), root)
    stop.set()
    reader.join()
    assert not failed and seen <= set(range(1, 8)) and merge.current(spark, root).count() == 7


def test_summary_tree_of_levels(spark):
    """Against packing and cutting text after text in Python."""
    rows = [(s, s * 100 + i, i, "user", f"{s}-{i} " * (7 * s + i)) for s in range(1, 9) for i in range(s * 2)]
    most, whole, keep = 700, 250, lambda t: t[:180]
    df = spark.createDataFrame(rows, "session_id long, id long, sequence_num int, role string, content_text string").repartition(3)
    got = {r.session_id: (r.summary, r.level) for r in reading.summary_tree(df, lambda t: F.substring(t, 1, 180), most, whole).collect()}
    for s in range(1, 9):
        texts, level = [f"[USER]: {r[4]}" for r in rows if r[0] == s], 0
        while len(joined := reading.SEPARATOR.join(texts)) > most:
            chunks = [reading.SEPARATOR.join(texts[i][a:b] for i, a, b in c) for c in pack([len(t) for t in texts], most)]
            texts, level = [c[:5000] if len(keep(c).strip()) < 100 or len(keep(c).strip()) >= len(c) else keep(c) for c in chunks], level + 1
        assert got[s] == (joined if len(joined) <= whole else keep(joined), level)
    with pytest.raises(RuntimeError, match="do not fit"):
        reading.summary_tree(df, lambda t: t, most, whole, levels=3).collect()


def test_clean_json():
    assert text.clean_json({"a\0": 1, "a": [2, "x\0"], "b\0": {"c": "\ud800d"}}) == {"a": [2, "x"], "b": {"c": "d"}}
    assert text.clean_json(["toString", None, True]) == ["toString", None, True]


def test_stream_rates_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = jobs.windowed_rates(stream, late="90 days").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((str(r.start), r.event_type, r.n) for r in spark.table("rates").collect())
    assert got == sorted((str(r.start), r.event_type, r.n) for r in jobs.windowed_rates(events).collect())
