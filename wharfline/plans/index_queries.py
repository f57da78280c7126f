"""Searches through indexes that the query writes itself: the same rows as without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.data import messages, table
from wharfline.operators import cells, postings, retrieval
from wharfline.plans.registry import query
from wharfline.plans.retrieval_queries import BM25_SQL, COSINE
from wharfline.plans.search_queries import _corpus, _ranked_sql, search_text_sql
from wharfline.storage import shared_folder


def _index(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str, analyser: str) -> postings.Index:
    index = postings.Index(spark, shared_folder(spark, "postings"), analyser)
    index.extend(rows, id_col, text_col)
    return index


@query("RET-04 SRC-13", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def indexed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by the index: blocks whose bound is too low are not read."""
    found = _index(spark, table(spark, sf_dir, "documents"), "doc_id", "text", "simple").search(retrieval.parse_query("this or with"), 20, digits=6)
    return found.select(F.col("doc").alias("doc_id"), "score", "rank")


def _places(term: str, more: int) -> str:
    return f"list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{term}'), lambda i: places[i] + {more})"


@query("RET-03 RET-04 RET-09", f"""WITH {_ranked_sql("documents", "doc_id", "text", ["attion", "thanedbl", "ornd"],
    f"(list_has_any({_places('attion', 2)}, {_places('thanedbl', 0)}) OR list_contains(t, 'ornd')) AND NOT list_contains(t, 'reli')", 30, "doc_id")} SELECT * FROM ranked""")
def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase over a word that is left out, or a word, without texts that hold another; the index is written in two parts, and the second part's documents are sent twice."""
    docs = table(spark, sf_dir, "documents")
    index = postings.Index(spark, shared_folder(spark, "postings"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    index.extend(docs.select("doc_id", F.when(part == 0, F.col("text")).otherwise("attion the thanedbl").alias("text")), "doc_id")
    index.extend(docs.where(part == 1), "doc_id")
    found = index.search(retrieval.parse_query('"attion the thanedbl" or ornd', "english"), 30, retrieval.parse_query("reli", "english"))
    return found.select(F.col("doc").alias("doc_id"), "score", "rank")


@query("RET-04 RET-13 SRC-13", search_text_sql())
def search_text_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text arm of a search by an index of all messages."""
    corpus = _corpus(spark, sf_dir)
    corpus.text_index = _index(spark, messages(spark, sf_dir), "id", "content_text", "english")
    hits = retrieval.search(corpus, retrieval.SearchParams(query="tion or onan", mode="text", limit=5, source="source1", exclude_terms="wh"))
    return hits.select("session_id", "project_id", "data_class", F.round("score", 6).alias("score"), "matched_tier", "message_id", F.col("snippet").isNotNull().alias("has_headline"))


def _cells(spark: SparkSession, sf_dir: str) -> cells.VectorIndex:
    return cells.VectorIndex.build(table(spark, sf_dir, "embeddings"), shared_folder(spark, "cells") + "/index", "vec_id")


@query("RET-01 VEC-04 SRC-19", f"SELECT vec_id, round({COSINE.format(0)}, 6) AS score, row_number() OVER (ORDER BY {COSINE.format(0)} DESC, vec_id) AS rank FROM embeddings ORDER BY {COSINE.format(0)} DESC, vec_id LIMIT 10")
def indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by cell: those opened first set the threshold, and only cells that can hold better ones are opened after."""
    vector = retrieval.vector_of(table(spark, sf_dir, "embeddings"), 0, "vec_id")
    return _cells(spark, sf_dir).search([vector], 10, exact=True).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("RET-01 SRC-11", f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM q, embeddings WHERE label <> 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) <= 5""")
def indexed_nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query, against all vectors but those of one label."""
    asked = [(r["vec_id"], list(r["embedding"])) for r in table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select("vec_id", "embedding").toLocalIterator()]
    found = _cells(spark, sf_dir).search([v for _, v in asked], 5, exact=True, where=F.col("label") != 3)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(asked)], "query long, query_id long")
    return found.join(F.broadcast(names), "query").select("query_id", "vec_id", F.round("score", 6).alias("score"))
