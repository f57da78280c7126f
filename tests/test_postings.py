"""The inverted index against scoring every text."""

import random

import pytest
from pyspark.sql import functions as F

from wharfline.functions.english import analyse
from wharfline.operators import postings, retrieval

WORDS = "king kings spain walks walked the of and castle towers tower river running ran".split()


def texts(rnd, n):
    return [(k, " ".join(rnd.choices(WORDS, [1, 2, 3, 4, 4, 9, 9, 9, 2, 1, 1, 1, 1, 1], k=rnd.randrange(40)))) for k in range(n)]


def brute(spark, docs, query, k, analyser, exclude=None):
    df = spark.createDataFrame(docs, "id long, text string")
    q = retrieval.parse_query(query, analyser)
    scored = retrieval.bm25(df, q.terms, "text", ["id"], q, retrieval.parse_query(exclude, analyser) if exclude else None, analyser).withColumn("score", F.round("score", 9))
    return [(r.id, r.score) for r in scored.orderBy(F.desc("score"), "id").limit(k).collect()]


def found(index, query, k, exclude=None, **more):
    q = retrieval.parse_query(query, index.analyser)
    rows = index.search(q, k, retrieval.parse_query(exclude, index.analyser) if exclude else None, **more).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    return [(r.doc, r.score) for r in rows]


def same(got, wanted):
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert all(abs(g[1] - w[1]) < 2e-9 for g, w in zip(got, wanted, strict=True))


QUERIES = [("king", 7), ("tower or river", 5), ('"king of spain"', 10), ("castle walking -king", 6), ("run", 3), ("nothing", 4), ('river "walk the castle" or tower', 8)]


@pytest.mark.parametrize("analyser", ["english", "simple"])
def test_equals_scoring_every_text(spark, tmp_path, monkeypatch, analyser):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    docs = texts(random.Random(1), 400) + [(900, None), (901, "")]
    index = postings.Index(spark, f"file://{tmp_path}/index", analyser)
    index.extend(spark.createDataFrame(docs, "id long, text string").repartition(3))
    for query, k in QUERIES:
        same(found(index, query, k, first_blocks=2), brute(spark, docs, query, k, analyser))
    same(found(index, "king", 9, "castle"), brute(spark, docs, "king", 9, analyser, "castle"))


def test_deltas_replace_and_delete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    rnd = random.Random(2)
    one, two = dict(texts(rnd, 150)), {k + 100: t for k, t in texts(rnd, 120)}
    index = postings.Index(spark, f"file://{tmp_path}/index")
    assert found(index, "king", 5) == []
    index.extend(spark.createDataFrame(list(one.items()), "id long, text string"))
    index.extend(spark.createDataFrame(list(two.items()), "id long, text string"), gone=spark.createDataFrame([(k,) for k in range(0, 60, 2)] + [(5000,)], "id long"))
    index.extend(spark.createDataFrame([(7, "king of spain"), (150, "")], "id long, text string"))
    now = {k: t for k, t in {**one, **two, 7: "king of spain", 150: ""}.items() if not (k < 60 and k % 2 == 0)}
    for query, k in QUERIES[:4]:
        same(found(index, query, k), brute(spark, sorted(now.items()), query, k, "english"))
    every = {r.doc: r.score for r in index.scores(retrieval.parse_query("king", "english")).collect()}
    assert sorted(every) == sorted(i for i, _ in brute(spark, sorted(now.items()), "king", 1000, "english"))
    allowed = spark.createDataFrame([(k,) for k in range(100, 130)], "doc long")
    assert found(index, "king", 4, allowed=allowed) == [(i, s) for i, s in found(index, "king", 1000) if 100 <= i < 130][:4]


def test_half_written_segments_do_not_exist(spark, tmp_path, monkeypatch):
    index = postings.Index(spark, f"file://{tmp_path}/index")
    index.extend(spark.createDataFrame([(1, "king of spain")], "id long, text string"))
    real = index._add

    def failing(name, rows, segment):
        if name == "totals":
            raise OSError("lost")
        real(name, rows, segment)

    monkeypatch.setattr(index, "_add", failing)
    with pytest.raises(OSError):
        index.extend(spark.createDataFrame([(1, "nothing"), (2, "king")], "id long, text string"))
    assert [d for d, _ in found(index, "king", 5)] == [1]
    monkeypatch.undo()
    index.extend(spark.createDataFrame([(2, "king king")], "id long, text string"))
    assert [d for d, _ in found(index, "king", 5)] == [2, 1]


def test_plan_reads_the_terms_alone(spark, tmp_path, capsys):
    """Folders of other terms are pruned, the term is pushed to the scan, and the bounds are read without the arrays."""
    index = postings.Index(spark, f"file://{tmp_path}/index")
    index.extend(spark.createDataFrame(texts(random.Random(3), 300), "id long, text string"))
    q, segments = retrieval.parse_query("castle", "english"), index.segments()
    heads = index.bounds(q, segments, index.statistics(q.terms, segments))
    heads.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "castl" in plan.split("PushedFilters")[1].split("\n")[0]
    assert "docs" not in plan.split("ReadSchema")[1].split("\n")[0] and "places" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 4)
    docs = [(k, "king " * (20 if k < 10 else 1) + "and the castle " * 5) for k in range(400)]
    index = postings.Index(spark, f"file://{tmp_path}/index")
    index.extend(spark.createDataFrame(docs, "id long, text string"))
    asked = []
    real = index._scored
    monkeypatch.setattr(index, "_scored", lambda q, w, s, t, blocks, a: asked.append(blocks.count()) or real(q, w, s, t, blocks, a))
    same(found(index, "king", 3), brute(spark, docs, "king", 3, "english"))
    assert sum(asked) < 40


def test_documents_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Postings are made from documents dealt out by block: no text is shuffled where ids are single, and no posting after it is made. Of rows of one id the greatest text still counts."""
    plans, shaped = {}, postings.Index._shaped
    monkeypatch.setattr(postings.Index, "_shaped", lambda self, name, rows, segment: plans.setdefault(name, shaped(self, name, rows, segment)))
    docs = spark.createDataFrame(texts(random.Random(4), 60), "id long, text string")
    postings.Index(spark, f"file://{tmp_path}/index").extend(docs)
    plan = plans["postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "RepartitionByExpression [block" in plan and "Exchange" in plans["postings"]._jdf.queryExecution().executedPlan().toString()
    executed = plans["postings"]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert executed.count("Exchange ") == 1
    assert "Aggregate" not in postings.once_each(docs.selectExpr("id AS doc", "text"))._jdf.queryExecution().optimizedPlan().toString()
    twice = spark.createDataFrame([(1, "b"), (1, "c"), (1, None), (2, None), (2, None), (3, "x")], "doc long, text string")
    assert sorted(map(tuple, postings.once_each(twice).collect())) == [(1, "c"), (2, None), (3, "x")]


def test_postings_are_made_block_by_block(spark, tmp_path, monkeypatch):
    """Rows by term come from a block's documents at once, not from grouping every place; a block with many places is several rows a term, with the same matches, in files by bucket and term."""
    plans, shaped = {}, postings.Index._shaped
    monkeypatch.setattr(postings.Index, "_shaped", lambda self, name, rows, segment: plans.setdefault(name, shaped(self, name, rows, segment)))
    monkeypatch.setattr(postings, "BLOCK_DOCS", 40)
    monkeypatch.setattr(postings, "MOST_PLACES", 60)
    docs = texts(random.Random(8), 200) + [(900, None), (901, "the")]
    index = postings.Index(spark, f"file://{tmp_path}/index")
    index.extend(spark.createDataFrame(docs, "id long, text string").repartition(3))
    assert "Aggregate" not in plans["postings"]._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.read.parquet(f"{tmp_path}/index/postings").collect()
    assert len(rows) > len({(r.term, r.block) for r in rows})
    want = {}
    for doc, text in docs:
        for term, place in zip(*analyse(text or "", {}), strict=True):
            want.setdefault((term, doc), []).append(place)
    got = [((r.term, d), p, n) for r in rows for d, p, n in zip(r.docs, r.places, r.times, strict=True)]
    assert len(got) == len(want) and {k: p for k, p, _ in got} == want and all(len(p) == n for _, p, n in got)
    assert all(r.most == max(r.times) and r.least == min(r.lens) and r.docs == sorted(r.docs) for r in rows)
    ordered = [(r.bucket, r.term, r.block) for r in plans["postings"].coalesce(1).collect()]
    runs = 1 + sum(a > b for a, b in zip(ordered, ordered[1:], strict=False))
    assert runs <= plans["postings"].rdd.getNumPartitions()
    for query, k in QUERIES[:3]:
        same(found(index, query, k, first_blocks=2), brute(spark, docs, query, k, "english"))


def test_codes_are_the_terms_of_the_analyser():
    """Words to numbers of terms, also after the dictionary was emptied."""
    words = "the walks walked walking king of kings spain generously 12".split()
    codes = postings.Codes("english")
    for _ in range(2):
        terms = [codes[w] for w in words]
        assert [codes.terms[c] for c in terms if c >= 0] == analyse(" ".join(words), {})[0]
        codes.forget()
        assert not codes and not codes.terms
    plain = postings.Codes("simple")
    assert [plain.terms[plain[w]] for w in words] == words
