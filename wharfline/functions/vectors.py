"""Vectors as arrays: expressions for single vectors, numpy batches for many against few."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a vector to move away from counts for, against one to move towards.
DAMPENING = 0.2


def _paired(a: Column, b: Column, f) -> Column:
    """zip_with that raises on different dimensions instead of padding with nulls."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different dimensions"))
    return F.when(same.isNull(), F.zip_with(a, b, f))


def add(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def is_broken(a: Column) -> Column:
    """Some component is NaN or infinite."""
    return F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def compose(
    query: Sequence[float] | None = None, negative: Sequence[float] | None = None, like: Sequence[tuple[Sequence[float], float]] = (), unlike: Sequence[tuple[Sequence[float], float]] = (), dimension: int | None = None
) -> list[float]:
    """The query's vector, moved away from negative, towards like and a little away from unlike (vector, weight), of length one."""
    given = [v for v in (query, negative) if v is not None] + [v for v, _ in (*like, *unlike)]
    size = dimension or len(given[0])
    out = np.zeros(size) if query is None else np.array(query, float)
    if negative is not None:
        out = out - np.array(negative, float)
    for vector, weight in like:
        out = out + np.array(vector, float) * weight
    for vector, weight in unlike:
        out = out - np.array(vector, float) * (weight * DAMPENING)
    length = float(np.sqrt((out * out).sum()))
    return (out / length if length else out).tolist()


def weighted_ids(given: Sequence[str]) -> list[tuple[str, float]]:
    """'id' or 'id:weight'; what follows the last colon must be a number to count as a weight."""
    out = []
    for item in map(str.strip, given):
        name, colon, weight = item.rpartition(":")
        try:
            out.append((name, float(weight)) if colon and name else (item, 1.0))
        except ValueError:
            out.append((item, 1.0))
    return [(name, w) for name, w in out if name]


def cosine_scores(vectors: DataFrame, queries: Sequence[Sequence[float]], id_col: str, vector_col: str, names: Sequence | None = None) -> DataFrame:
    """(id_col, query, score) for every vector and query: one matrix product for each Arrow batch. The queries travel with the task."""
    q = np.array(queries, np.float64).reshape(len(queries), -1)
    lengths = np.linalg.norm(q, axis=1)
    label = list(names if names is not None else range(len(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            m = np.stack([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)])
            size = np.linalg.norm(m, axis=1)[:, None] * lengths
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(size > 0, (m @ q.T) / size, 0.0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(label))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(label * batch.num_rows, pa.int64()), pa.array(score.ravel())], names=[id_col, "query", "score"])

    source = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    schema = T.StructType([source.schema[id_col], T.StructField("query", T.LongType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)
