"""Centroids that are kept up to date: a state (key, n, sums) that merges, so a delta touches its own keys alone.

`state_of` sums vectors in Arrow batches, a row for each key and task; rows of a key are then added up as they stream by in order of key. `applied` adds what came and takes away what
went: only states of keys in the delta meet it, the others pass. A vector that changes is removed as it was and added as it is.

Defined results: null vectors count nothing; a null key is a key. A key whose last vector goes leaves the state. Vectors of different dimensions under one key raise. Sums are
doubles: after many changes they may differ from a full run in the last digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.functions.vectors import normalise

#: Keys that a task holds sums of at a time.
MOST_KEYS = 4096


def _state_type(df: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])


def _rows(found: dict, key_type: pa.DataType, key: str) -> pa.RecordBatch:
    sums = pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(list(found), key_type), pa.array([n for n, _ in found.values()], pa.int64()), sums], names=[key, "n", "sums"])


def _put(found: dict, name, n: int, sums: np.ndarray) -> None:
    if name in found:
        had, total = found[name]
        if len(total) != len(sums):
            raise ValueError(f"vectors of {len(total)} and {len(sums)} dimensions under {name}")
        found[name] = (had + n, total + sums)
    else:
        found[name] = (n, sums)


def _partial(df: DataFrame, key: str, vector_col: str, sign: int) -> DataFrame:
    """(key, n, sums) of each task's vectors, times sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            sizes = batch.column(1).value_lengths().to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for size in np.unique(sizes):  # one, unless dimensions differ
                mine = np.flatnonzero(sizes == size)
                vectors = flat[np.repeat(sizes == size, sizes)].reshape(-1, size)
                order = np.argsort(code[mine], kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(code[mine][order]) != 0])
                sums, counts = np.add.reduceat(vectors[order], starts, axis=0), np.diff(np.r_[starts, len(mine)])
                for c, n, s in zip(code[mine][order][starts], counts, sums, strict=True):
                    _put(found, names[c], sign * int(n), sign * s)
            if len(found) > MOST_KEYS:
                yield _rows(found, batch.column(0).type, key)
                found = {}
        if found:
            yield _rows(found, batch.column(0).type, key)

    return df.where(F.col(vector_col).isNotNull()).select(key, vector_col).mapInArrow(run, _state_type(df, key))


def merged(states: DataFrame, key: str) -> DataFrame:
    """States of the same key added up; keys of no vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            kind = batch.column(0).type
            for name, n, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if name not in found and len(found) >= MOST_KEYS:  # rows of a key follow each other
                    yield _rows(found, kind, key)
                    found = {}
                _put(found, name, n, sums.values.to_numpy())
        if found:
            yield _rows(found, kind, key)

    return states.repartition(key).sortWithinPartitions(key).mapInArrow(run, _state_type(states, key)).where("n != 0")


def state_of(df: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(key, n, sums) of all vectors."""
    return merged(_partial(df, key, vector_col, 1), key)


def applied(state: DataFrame, key: str, vector_col: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The state after vectors (key, vector_col) came and went."""
    parts = [_partial(df, key, vector_col, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not parts:
        return state
    delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    keys = delta.select(key).distinct().withColumnRenamed(key, "__key")
    same = state[key].eqNullSafe(keys["__key"])
    return state.join(keys, same, "left_anti").unionByName(merged(state.join(keys, same, "left_semi").unionByName(delta), key))


def final(state: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid): the mean of each key's vectors, of length one."""
    return state.select(key, "n", normalise(F.transform("sums", lambda x: x / F.col("n"))).alias("centroid"))


def centroids(df: DataFrame, key: str, vector_col: str) -> DataFrame:
    """`final` of all vectors."""
    return final(state_of(df, key, vector_col), key)
