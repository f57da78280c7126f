"""The vector index against comparing with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wharfline.operators import cells, retrieval


def clouds(n, dimension=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimension))
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dimension)) * 0.6


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(k * 7 % 3001, [float(x) for x in v], k % 50) for k, v in enumerate(clouds(3000))]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, part int").repartition(4)
    return df, cells.VectorIndex.build(df, f"file://{tmp_path_factory.mktemp('cells')}/index")


def brute(df, query, n, where=None):
    rows = retrieval.knn(df.where("NOT exists(embedding, x -> isnan(x))"), query, n, where=where).collect()
    return [(r.id, round(r.score, 6)) for r in sorted(rows, key=lambda r: r.rank)]


def got(rows, query=0):
    return [(r.id, round(r.score, 6)) for r in rows.where(F.col("query") == query).orderBy("rank").collect()]


def test_exact_search(stored):
    df, index = stored
    queries = clouds(4, seed=2).tolist()
    found = index.search(queries, 10, exact=True, probes=2)
    for q, v in enumerate(queries):
        assert got(found, q) == brute(df, v, 10)


def test_recall_is_measured(spark, stored):
    """Every vector whose id is divisible by 20 as a query: at least nine tenths of the true neighbours are found, with a part of the cells."""
    df, index = stored
    assert 1 <= index.probes < len(index.centroids)
    queries = [(r.id, list(r.embedding)) for r in df.where("id % 20 = 0 AND id < 5000").collect()]
    vectors = [v for _, v in queries]
    key = lambda rows: {(r.query, r.id) for r in rows.collect()}
    true, found = key(index.search(vectors, 10, probes=len(index.centroids))), key(index.search(vectors, 10))
    assert len(true) == 10 * len(vectors)
    assert len(true & found) / len(true) >= 0.9


def test_filters_apply_before_the_choice(stored):
    df, index = stored
    query = clouds(1, seed=3).tolist()
    for where, n in ((F.col("part") == 3, 10), (F.col("part") == 3, 500), (F.col("id") == 14, 5)):
        exact = got(index.search(query, n, exact=True, where=where))
        assert exact == brute(df, query[0], n, where)
    assert len(got(index.search(query, 70, where=F.col("part") == 3))) == 60  # all there are


def test_only_opened_cells_are_read(stored, capsys):
    _, index = stored
    index.rows([3, 5]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert {r[0].split("cell=")[1].split("/")[0] for r in index.rows([3, 5]).select(F.input_file_name()).distinct().collect()} <= {"-1", "3", "5"}
    query = clouds(1, seed=4)
    near = (cells.unit(query) @ index.centroids.T)[0]
    rows = index.rows().where("cell >= 0").select("cell", "embedding").collect()
    score = np.array([float((cells.unit(np.array([r.embedding], float)) @ cells.unit(query).T)[0, 0]) for r in rows])
    assert (score <= index.bounds(near)[[r.cell for r in rows]] + 1e-6).all()


def test_every_vector_is_stored(stored):
    df, index = stored
    assert index.rows().count() == df.count()
    assert sorted(r.id for r in index.rows([]).collect()) == [5000, 5001, 5002]


def test_empty_table_and_other_dimensions(spark, tmp_path):
    empty = cells.VectorIndex.build(spark.createDataFrame([], "id long, embedding array<float>"), f"file://{tmp_path}/empty")
    assert empty.search([[1.0, 2.0]], 3).collect() == []
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions|inhomogeneous"):
        cells.VectorIndex.build(mixed, f"file://{tmp_path}/mixed")


def test_many_queries_are_ranked_in_one_place(stored, monkeypatch):
    """Queries of several groups: the same neighbours, and the plan sorts as often as for one group, so a task's buffers do not grow with the number of queries."""
    df, index = stored
    queries = clouds(7, seed=6).tolist()
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    one = index.search(queries, 6, exact=True)
    monkeypatch.setattr(cells, "QUERY_ROWS", 2)
    many = index.search(queries, 6, exact=True, probes=1)
    for q, v in enumerate(queries):
        assert got(many, q) == got(one, q) == brute(df, v, 6)
    assert plan(many).count("Window [") == plan(one).count("Window [") == 2
