"""Text to vectors without a model server: hashed bags of words, signed, of length one. Swap in another embedder by its function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.functions.text import sanitise

DIMENSION = 64
Embedder = Callable[[list[str]], np.ndarray]


def hashed_bag(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Each word adds one or minus one to a place that its digest names; a text without words is a zero vector."""
    out = np.zeros((len(texts), dimension))
    for k, t in enumerate(texts):
        marks = np.array([int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4]) for w in t.lower().split()], np.int64)
        np.add.at(out[k], marks % dimension, np.where(marks >> 31 & 1, 1.0, -1.0))
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder = hashed_bag) -> DataFrame:
    """(id_col, embedding, failure_reason): 'nan' where the embedder gives no finite vector. Batches of rows, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = embedder([t or "" for t in batch.column(1).to_pylist()])
            good = np.isfinite(made).all(axis=1)
            values = [v.tolist() if ok else None for v, ok in zip(made, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64())), pa.array([None if ok else "nan" for ok in good], pa.string())], names=[id_col, "embedding", "failure_reason"])

    source = df.select(id_col, sanitise(F.col(text_col)).alias("text"))
    schema = T.StructType([source.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("failure_reason", T.StringType())])
    return source.mapInArrow(run, schema)
