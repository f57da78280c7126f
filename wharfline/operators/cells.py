"""Vector index: vectors stored by k-means cell, searched cell by cell, exactly or with a measured recall.

`build` trains unit centroids on a bounded sample (at most SAMPLE_ROWS vectors, by hash of the id: the only bound, and every vector is stored), assigns each vector to the centroid of highest cosine
and writes the vectors in folders by cell. It then measures recall: the true neighbours of PROBES_ROWS sampled vectors, by comparing them with all
vectors, tell how many cells a search must open for RECALL of them; that number is kept with the index.

`search` opens the folders of the cells nearest to each query, as many as asked for or as measured. With exact, the cells opened first give a threshold; a cell's radius
(the least cosine of its vectors to the centroid) bounds what its vectors can score, and every other cell whose bound reaches the threshold is opened too, so the result is that of
comparing with all vectors. A filter applies before the choice, so a narrow one returns as many as there are in the cells opened; where those do not
hold n, all are opened.

Scale: texts or payloads stay where they are; a cell that holds a third of all vectors is many files (rebalanced by size). Broadcast are centroids (at most MOST_CELLS) and the queries at hand,
QUERY_ROWS at a time; each task returns n rows a query, ranked in two steps.

Defined results: null vectors, and those without length or with NaN, are in cell -1, are opened by every search and score 0 (NaN: left out); a query without length scores 0 with all. Ties by id. Vectors of
another dimension than the first sampled one raise. An empty table is an index without cells, in which nothing is found. Other columns are stored and may be filtered on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.storage import written

SAMPLE_ROWS = 20_000
MOST_CELLS = 2048
ROUNDS = 12
PROBES_ROWS = 100
NEAREST = 10
RECALL = 0.95
QUERY_ROWS = 256
SALTS = 64
SEED = 5
#: A score may exceed its bound by rounding.
SLACK = 1e-9
NO_CELL = -1


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    sizes = column.value_lengths().to_numpy()
    if len(sizes) and (sizes != dimension).any():
        raise ValueError(f"vectors of {int(sizes[sizes != dimension][0])} and {dimension} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows, by cosine; a centroid without rows starts again at the row that is furthest from its own."""
    rng = np.random.default_rng(SEED)
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([rows[a : a + 4096] @ centres.T for a in range(0, len(rows), 4096)])
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        furthest = iter(np.argsort(near.max(axis=1), kind="stable"))
        for c in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            sums[c] = rows[next(furthest)]
        centres = unit(sums)
    return centres


def cells_for(rows: int) -> int:
    """The square root of the number of rows, up to MOST_CELLS."""
    return max(1, min(MOST_CELLS, math.isqrt(rows)))


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        meta = spark.read.parquet(f"{self.root}/meta").first()
        self.id_col, self.vector_col, self.probes, self.dimension = meta["id_col"], meta["vector_col"], meta["probes"], meta["dimension"]
        self.schema = T.StructType.fromJson(json.loads(meta["schema"]))
        made = spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()  # at most MOST_CELLS rows
        self.centroids = np.array([r["centroid"] for r in made], float).reshape(len(made), self.dimension)
        self.radius = np.array([r["radius"] for r in made])

    @classmethod
    def build(cls, vectors: DataFrame, root: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Writes the index below root, which must not exist, and opens it."""
        spark, root = vectors.sparkSession, root.rstrip("/")
        good = F.coalesce(F.exists(vector_col, lambda x: x != 0) & F.forall(vector_col, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        marked = vectors.withColumn("cell", F.when(good, F.lit(0)).otherwise(F.lit(NO_CELL)))
        n = marked.where("cell = 0").count()
        share = 1.5 * SAMPLE_ROWS / max(1, n)
        drawn = marked.where("cell = 0").where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select(vector_col).limit(SAMPLE_ROWS)
        sample = [np.array(r[0], float) for r in drawn.toLocalIterator()]
        dimension = len(sample[0]) if sample else 0
        centres = kmeans(unit(np.array(sample)), min(cells or cells_for(n), len(sample))) if sample else np.empty((0, 0))
        sent, place = spark.sparkContext.broadcast(centres), vectors.columns.index(vector_col)
        schema = T.StructType([*marked.schema.fields, T.StructField("own", T.DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, own = batch.column(batch.num_columns - 1).to_numpy().copy(), np.zeros(batch.num_rows)
                some = np.flatnonzero(cell == 0)
                for a in range(0, len(some), 1024):
                    mine = some[a : a + 1024]
                    near = unit(matrix(batch.column(place).take(pa.array(mine)), dimension)) @ sent.value.T
                    cell[mine], own[mine] = near.argmax(axis=1), near.max(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell, pa.int32()), pa.array(own)], names=[*batch.schema.names[:-1], "cell", "own"])

        marked.mapInArrow(assign, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/vectors")
        reach = dict(spark.read.parquet(f"{root}/vectors").where(F.col("cell") >= 0).groupBy("cell").agg(F.min("own")).collect()) if n else {}
        rows = [(c, [float(x) for x in v], float(reach.get(c, 1.0))) for c, v in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{root}/centroids")
        meta = "id_col string, vector_col string, probes int, dimension int, schema string"
        stored = T.StructType([*vectors.schema.fields, T.StructField("own", T.DoubleType()), T.StructField("cell", T.IntegerType())]).json()
        spark.createDataFrame([(id_col, vector_col, len(centres), dimension, stored)], meta).write.parquet(f"{root}/meta")
        index = cls(spark, root)
        probes = index.measured_probes(vectors.where(good)) if n else 0
        spark.createDataFrame([(id_col, vector_col, probes, dimension, stored)], meta).write.mode("overwrite").parquet(f"{root}/meta")
        return cls(spark, root)

    def measured_probes(self, vectors: DataFrame) -> int:
        """How many cells hold RECALL of the true neighbours of sampled vectors."""
        drawn = vectors.orderBy(F.xxhash64(F.col(self.id_col)), self.id_col).limit(PROBES_ROWS).select(self.id_col, self.vector_col).collect()
        queries = np.array([list(r[1]) for r in drawn], float)
        true = self._best([(queries, list(range(len(queries))), None)], NEAREST, None, with_cell=True).select("query", "cell").collect()
        order = np.argsort(-(unit(queries) @ self.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        needed = np.sort([place[r["query"], r["cell"]] + 1 for r in true if r["cell"] >= 0])
        return int(needed[math.ceil(RECALL * len(needed)) - 1]) if len(needed) else len(self.centroids)

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """What is stored, in these cells."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.root}/vectors")
        return found if cells is None else found.where(F.col("cell").isin([NO_CELL, *cells]))

    def _best(self, groups: Sequence[tuple[np.ndarray, list[int], np.ndarray | None]], n: int, where: Column | None, with_cell: bool = False) -> DataFrame:
        """(query, id_col, score, rank, cell): each query's n best, of groups (queries, names, cells opened for each). All groups are ranked in the same two steps:
        a task that ranked each group by itself would hold the buffers of all of them."""
        found = reduce(DataFrame.unionByName, [self._near(*group, n, where) for group in groups])
        order = [F.desc("score"), F.col(self.id_col)]
        for by in (["query", "salt"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)
        return found.select("query", self.id_col, "score", "rank", *(["cell"] if with_cell else []))

    def _near(self, queries: np.ndarray, names: list[int], opened: np.ndarray | None, n: int, where: Column | None) -> DataFrame:
        """(query, id_col, score, cell, salt): each task's n best of each query in the cells opened for it (a row of booleans; null: all)."""
        cells = None if opened is None else np.flatnonzero(opened.any(axis=0)).tolist()
        stored = self.rows(cells)
        stored = (stored.where(where) if where is not None else stored).where(F.col(self.vector_col).isNotNull())
        id_type = stored.schema[self.id_col].dataType.simpleString()
        sent, dimension, id_col = self.spark.sparkContext.broadcast((queries, unit(queries), opened, names)), self.dimension, self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, directions, opened, names = sent.value
            kept: list[tuple[np.ndarray, pa.Array, np.ndarray] | None] = [None] * len(names)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    block = batch.slice(at, 1024)
                    ids, cell = block.column(0), block.column(2).to_numpy()
                    score = unit(matrix(block.column(1), dimension)) @ directions.T
                    for q in range(len(names)):
                        mine = score[:, q]
                        some = ~np.isnan(mine) & ((cell == NO_CELL) | (opened is None or opened[q, cell]))
                        if (had := kept[q]) is not None and len(had[0]) == n:
                            some &= mine >= had[0][-1]
                        found = np.flatnonzero(some)
                        if not len(found):
                            continue
                        s, i, c = mine[found], ids.take(pa.array(found)), cell[found]
                        if had is not None:
                            s, i, c = np.r_[had[0], s], pa.concat_arrays([had[1], i]), np.r_[had[2], c]
                        order = np.lexsort((i.to_numpy(zero_copy_only=False), -s))[:n]
                        kept[q] = s[order], i.take(pa.array(order)), c[order]
            for name, had in zip(names, kept, strict=True):
                if had is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(had[0]), pa.int64()), had[1], pa.array(had[0]), pa.array(had[2], pa.int32())], names=["query", id_col, "score", "cell"])

        return stored.select(self.id_col, self.vector_col, "cell").mapInArrow(run, f"query long, `{self.id_col}` {id_type}, score double, cell int").withColumn("salt", F.spark_partition_id() % SALTS)

    def search(self, queries: Sequence[Sequence[float]], n: int = NEAREST, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
        """(query, id_col, score, rank): the n best of each query, numbered from 0."""
        if not len(self.centroids) or not len(queries):
            kind = self.rows().schema[self.id_col].dataType.simpleString()
            return self.spark.createDataFrame([], f"query long, `{self.id_col}` {kind}, score double, rank long")
        groups, near = [], []
        for start in range(0, len(queries), QUERY_ROWS):
            some = np.array(queries[start : start + QUERY_ROWS], float).reshape(-1, self.dimension)
            near.append(unit(some) @ self.centroids.T)
            order = np.argsort(-near[-1], axis=1, kind="stable")
            opened = np.zeros(near[-1].shape, bool)
            np.put_along_axis(opened, order[:, : max(1, min(probes or self.probes, opened.shape[1]))], True, axis=1)
            groups.append((some, list(range(start, start + len(some))), opened))
        first = written(self._best(groups, n, where), "nearest")
        least = {r["query"]: (r["n"], r["s"]) for r in first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()}
        if not exact and all(least.get(name, (0, 0))[0] >= n for name in range(len(queries))):
            return first
        for (_, names, opened), close in zip(groups, near, strict=True):
            for q, name in enumerate(names):
                have, score = least.get(name, (0, 0.0))
                if have < n:
                    opened[q] = True
                elif exact:
                    opened[q] |= self.bounds(close[q]) >= score - SLACK
        return self._best(groups, n, where)

    def bounds(self, near: np.ndarray) -> np.ndarray:
        """The highest cosine to a query that a cell's vectors can have, from the query's to the centroid and the cell's radius: angles add up."""
        angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(self.radius, -1, 1))
        return np.cos(np.maximum(angle, 0))
