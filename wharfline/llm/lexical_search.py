"""Ranked lexical search of all documents for each item of a query set, by dense blocked matrix multiplication.

1. The items' distinct terms are the vocabulary. It is cut into tiles of items (`tiles_of`): consecutive items with at most TILE_TERMS distinct terms together, so
   a tile's vocabulary is compact. An item with more terms than that is cut over several tiles, whose scores are added up.
2. `counted`: one pass over the texts cuts them into terms and keeps of each document its id, its number of terms and (term, times) of
   the terms of the vocabulary; written, so texts are read once. Numbers of documents and terms, and documents by term, are aggregates of that.
3. `scored`: for each tile a block of documents becomes a dense matrix of impacts, documents by terms, and the tile one of weights, items by terms;
   their product by BLAS, in float64, is the scores. Both hold whole numbers, and a tile is as narrow as it takes to keep every partial sum below 2^53
   (`exact_terms`), so the product is exact in whatever order BLAS adds.
4. Each task keeps the best `top` documents of each item, ties by id: a block's scores are cut at the worst score kept, which stays in, and then ordered by score and
   id. The tasks' lists are ranked in two steps, first within salts of tasks, so no task gets more than a share of them.

Scale: texts are never shuffled. What leaves a task is `top` rows an item. The vocabulary is broadcast in groups of items of at most GROUP_TERMS terms, one group
after another over the written table, so what a task holds does not grow with the query set.

Defined results: null text has no terms; documents without terms do not count and are never found. Rows of one item_id are one item with the terms of
all; items without an id are left out. Documents without an id count in the statistics but cannot be returned; rows that repeat an id are documents of their own and rank
side by side. Ties: ascending doc_id. A very long text is cut PIECE_BYTES at a time. An empty table, or an item whose terms no document has, gives no rows.
Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, written

TOP = 50
#: Terms of a tile, documents of a block, terms and items broadcast at once.
TILE_TERMS = 512
BLOCK_ROWS = 1024
GROUP_TERMS, GROUP_ITEMS = 1 << 18, 4096
EXACT = 1 << 53
#: The contract's constants: scale of a weight, of an impact, and what its parts are divided by.
WEIGHT_SCALE, IMPACT_SCALE, TIMES_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 20
BASE, SLOPE = 100 - 50, 50
SALTS = 64
PIECE_BYTES = 1 << 20
#: ASCII other than digits and letters separates terms; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, some size bytes at a time."""
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and FOLD[text[stop]] != 32:
            stop += 1
        yield text[at:stop].translate(FOLD).split()
        at = stop


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = {t for piece in terms_of(text.as_py() or b"") for t in piece}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary())], schema=schema)

    known = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return map_arrow(known, run, "item long, term binary").distinct()


def weight(n_docs: int, holders: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def exact_terms(n_docs: int) -> int:
    """How many terms' products of weight and impact can be added up below 2^53, whatever they are."""
    return (EXACT - 1) // max(1, weight(n_docs, 0) * (IMPACT_SCALE // TIMES_SCALE))


def impacts(times: np.ndarray, terms: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1e9 tf) div (1000 tf + 20 m) of a term that occurs so many times in a document of so many terms."""
    m = BASE + SLOPE * terms * n_docs // max(1, n_terms)
    return IMPACT_SCALE * times // (TIMES_SCALE * times + LENGTH_SCALE * m)


def counted(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, terms, times) of documents with a term: n counts all their terms, terms are the numbers of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(sent.value)}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                n, found = 0, Counter()
                for piece in terms_of(text.as_py() or b""):
                    n += len(piece)
                    found.update(map(number.get, piece))
                found.pop(None, None)
                if n:
                    rows.append((doc, n, list(found), list(found.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_arrow(texts, run, "doc long, n long, terms array<int>, times array<long>")


#: A tile: the numbers of its terms, its items' places in the group, and its items' terms as (row, column).
Tile = tuple[list[int], list[int], list[tuple[int, int]]]


def tiles_of(items: list[tuple[int, list[int]]], most: int) -> list[Tile]:
    """From (place, terms) of items: tiles of at most most terms."""
    tiles: list[Tile] = []
    column: dict[int, int] = {}
    rows: list[int] = []
    cells: list[tuple[int, int]] = []

    def close() -> None:
        nonlocal column, rows, cells
        if cells:
            tiles.append((list(column), rows, cells))
        column, rows, cells = {}, [], []

    for place, terms in items:
        for at in range(0, len(terms), most):
            part = terms[at : at + most]
            if len(column) + sum(t not in column for t in part) > most:
                close()
            rows.append(place)
            cells += [(len(rows) - 1, column.setdefault(t, len(column))) for t in part]
    close()
    return tiles


def best(scores: np.ndarray, docs: np.ndarray, top: int) -> np.ndarray:
    """Places of the top scores above 0, ties by document; all if fewer."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        some = np.flatnonzero(scores >= max(least, 1))
    else:
        some = np.flatnonzero(scores > 0)
    return some[np.lexsort((docs[some], -scores[some]))[:top]]


def scored(held: DataFrame, tiles: list[Tile], items: list[int], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc, score, task): of each task the top documents of each item."""
    sent = held.sparkSession.sparkContext.broadcast((tiles, items, weights))
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, items, weights = sent.value
        dense = []
        for terms, rows, cells in tiles:
            w = np.zeros((len(rows), len(terms)))
            at = np.array(cells)
            w[at[:, 0], at[:, 1]] = weights[np.array(terms)[at[:, 1]]]
            dense.append(w)
        column = np.full(len(weights), -1, np.int32)  # of a term in the tile at hand
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                docs, n = block.column(0).to_numpy(), block.column(1).to_numpy()
                owner = np.repeat(np.arange(len(docs)), block.column(2).value_lengths().to_numpy())
                term, times = block.column(2).flatten().to_numpy(), block.column(3).flatten().to_numpy()
                impact = impacts(times, n[owner], n_docs, n_terms)
                total = np.zeros((len(items), len(docs)), np.int64)
                for (terms, rows, _), w in zip(tiles, dense, strict=True):
                    column[terms] = np.arange(len(terms))
                    mine = column[term]
                    use = mine >= 0
                    d = np.zeros((len(docs), len(terms)))
                    d[owner[use], mine[use]] = impact[use]
                    np.add.at(total, rows, (w @ d.T).astype(np.int64))
                    column[terms] = -1
                for k, scores in enumerate(total):
                    had, ids = kept[k]
                    if len(had) == top:
                        some = np.flatnonzero(scores >= had[-1])
                        if not len(some):
                            continue
                        scores, found = scores[some], docs[some]
                    else:
                        found = docs
                    both, all_ids = np.r_[had, scores], np.r_[ids, found]
                    order = best(both, all_ids, top)
                    kept[k] = both[order], all_ids[order]
        size = [len(s) for s, _ in kept]
        if sum(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(items, np.int64), size)), pa.array(np.concatenate([i for _, i in kept])), pa.array(np.concatenate([s for s, _ in kept]))], schema=schema)

    return map_arrow(held, run, "item long, doc long, score long").withColumn("task", F.spark_partition_id())


def ranked(found: DataFrame, top: int) -> DataFrame:
    """(item, rank, doc, score): the top rows of each item over all tasks, in two steps."""
    order = [F.desc("score"), F.asc("doc")]
    some = found.withColumn("salt", F.col("task") % SALTS).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", group_terms: int = GROUP_TERMS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """(item_col, rank, id_col, score): each item's top documents."""
    found = [docs.sparkSession.createDataFrame([], "item long, rank int, doc long, score long")]
    terms = written(item_terms(items, item_col, text_col), "item_terms")
    for group in groups_of(terms, group_terms):
        vocabulary = sorted({t for _, mine in group for t in mine})
        number = {t: k for k, t in enumerate(vocabulary)}
        held = written(counted(docs, vocabulary, id_col, text_col), "counted")
        n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weights = np.full(len(vocabulary), weight(n_docs, 0))
        for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[row["term"]] = weight(n_docs, row["count"])
        tiles = tiles_of([(k, [number[t] for t in mine]) for k, (_, mine) in enumerate(group)], min(tile_terms, exact_terms(n_docs)))
        best_of_tasks = scored(held.where("doc is not null and size(terms) > 0"), tiles, [item for item, _ in group], weights, n_docs, n_terms, top)
        found.append(written(ranked(best_of_tasks, top), "ranked"))
    return reduce(DataFrame.unionByName, found).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def groups_of(terms: DataFrame, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with their terms, in order of item, at most most terms at a time (an item with more is a group of its own)."""
    group: list[tuple[int, list[bytes]]] = []
    size = 0
    rows = terms.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item")
    for row in rows.toLocalIterator():
        mine = [bytes(t) for t in row["terms"]]
        if group and (size + len(mine) > most or len(group) == GROUP_ITEMS):
            yield group
            group, size = [], 0
        group.append((row["item"], mine))
        size += len(mine)
    if group:
        yield group
