"""The conversation model over the given tables.

messages are `conversations`; sessions are grouped from them; projects and sources are dealt from the session id, as the tables
carry neither. Texts of `documents`, vectors of `embeddings` and flows of `events` stand for the other collections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECTS = 10
SOURCES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session_id, sequence_num, role, content_text)."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence_num"), "role", F.col("text").alias("content_text")
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, project_id, source_name, started_at, title, summary, message_count, content_chars)."""
    said = lambda role: F.min(F.when(F.col("role") == role, F.struct("sequence_num", "content_text")))["content_text"]
    grouped = messages(spark, sf_dir).groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.sum(F.length("content_text")).alias("content_chars"), said("user").alias("opening"), said("assistant").alias("summary")
    )
    return grouped.select(
        "session_id", (F.col("session_id") % PROJECTS).alias("project_id"), F.concat(F.lit("source"), (F.col("session_id") % SOURCES).cast("string")).alias("source_name"),
        F.timestamp_add("hour", (F.col("session_id") % 720).cast("int"), F.expr("timestamp_ntz '2024-01-01 00:00:00'")).alias("started_at"),
        F.when(F.col("session_id") % 4 == 0, F.substring("opening", 1, 40)).alias("title"), "summary", "message_count", "content_chars",
    )


#: The same in DuckDB, as common table expressions.
MESSAGES_SQL = "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS sequence_num, role, text AS content_text FROM conversations)"
SESSIONS_SQL = (
    MESSAGES_SQL
    + """, grouped AS (SELECT session_id, count(*) AS message_count, sum(length(content_text))::BIGINT AS content_chars,
  arg_min(content_text, sequence_num) FILTER (role = 'user') AS opening, arg_min(content_text, sequence_num) FILTER (role = 'assistant') AS summary FROM messages GROUP BY session_id),
sessions AS (SELECT session_id, session_id % 10 AS project_id, 'source' || (session_id % 3)::VARCHAR AS source_name,
  TIMESTAMP '2024-01-01' + to_hours((session_id % 720)::BIGINT) AS started_at, CASE WHEN session_id % 4 = 0 THEN substr(opening, 1, 40) END AS title, summary, message_count, content_chars FROM grouped)"""
)
