"""Upserts on plain Parquet: post-images computed by joins, written as new versions.

Every function returns the table as it is afterwards. `swap` writes such a table as a new version and then adds a pointer to it, so readers see the
old one or the new one. Keys must be unique on both sides; `latest` makes them so.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "number long, path string"
Rule = Callable[[Column, Column], Column]
overwrite: Rule = lambda old, new: new
keep_old: Rule = lambda old, new: F.coalesce(old, new)
keep_known: Rule = lambda old, new: F.coalesce(new, old)
add: Rule = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
greatest: Rule = lambda old, new: F.greatest(old, new)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the last by order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule] | None = None, default: Rule = keep_known) -> DataFrame:
    """old with new merged in: unmatched rows of either stay, matched ones are settled column by column. One full outer join."""
    rules = rules or {}
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"), F.lit(True).alias("__o"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in keys]).alias("n"), F.lit(True).alias("__n"))
    both = F.col("__o").isNotNull() & F.col("__n").isNotNull()
    settle = lambda c: F.when(both, rules.get(c, default)(F.col(f"o.{c}"), F.col(f"n.{c}"))).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")))
    return o.join(n, list(keys), "full_outer").select(*keys, *[settle(c).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in keys]).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks, each once. Doing it twice changes nothing."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def delete_where(old: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(doomed.select(*keys), list(keys), "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """All rows of the groups that new names are new's; others stay."""
    return delete_where(old, new.select(*group).distinct(), group).unionByName(new.select(*old.columns))


def soft_delete(old: DataFrame, doomed: DataFrame, keys: Sequence[str], at: Column, column: str = "deleted_at") -> DataFrame:
    hit = old.join(doomed.select(*keys, F.lit(True).alias("__hit")).dropDuplicates(list(keys)), list(keys), "left")
    return hit.withColumn(column, F.when(F.col("__hit") & F.col(column).isNull(), at).otherwise(F.col(column))).select(*old.columns)


def session_stats(messages: DataFrame) -> DataFrame:
    """(session_id, message_count, content_chars, input and output tokens, first and last time) as far as the columns are there."""
    has = set(messages.columns)
    made = [F.count("*").alias("message_count"), F.coalesce(F.sum(F.length("content_text")), F.lit(0)).alias("content_chars")]
    made += [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("input_tokens", "output_tokens") if c in has]
    made += [F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at")] if "timestamp" in has else []
    return messages.groupBy("session_id").agg(*made)


def mark_unembeddable(old: DataFrame, failed: DataFrame) -> DataFrame:
    """old and failed: (message_id, collection, failure_reason, failure_detail, retry_count, updated_at). Retries count for 'nan' only."""
    rules = {"retry_count": lambda o, n: F.coalesce(o, F.lit(0)) + F.when(F.col("n.failure_reason") == "nan", 1).otherwise(0)}
    return merge_by_key(old, failed, ["message_id", "collection"], rules, overwrite)


def quarantine(old: DataFrame, bad: DataFrame) -> DataFrame:
    """Dead letters (source, file_path, record_key, .., attempts, first_seen_at, last_attempt_at, resolved_at): a repeat adds an attempt, keeps when it was
    first seen, and is open again; what cannot be recovered (NULs and white space) is closed at once."""
    rules = {
        "attempts": lambda o, n: F.coalesce(o, F.lit(0)) + 1,
        "first_seen_at": keep_old,
        "resolved_at": lambda o, n: F.when(F.regexp_like(F.decode(F.unbase64(F.col("n.payload_base64")), "UTF-8"), F.lit(r"^[\x00\s]*$")), F.col("n.last_attempt_at")),
    }
    return merge_by_key(old, bad, ["source", "file_path", "record_key"], rules, overwrite)


def prune(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def swap(df: DataFrame, root: str) -> str:
    """Writes a new version below root, then a pointer to it: one more small file, numbered by the clock, which appears whole or not at all. Pointers are never
    replaced, so a reader finds the old version or the new one at any time. Returns the version's path. One writer at a time."""
    base = root.rstrip("/")
    path = f"{base}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(time.time_ns(), path)], POINTER).coalesce(1).write.mode("append").parquet(f"{base}/pointers")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the newest pointer names."""
    newest = spark.read.schema(POINTER).parquet(f"{root.rstrip('/')}/pointers").agg(F.max_by("path", "number")).first()[0]
    return spark.read.parquet(newest)


def snapshot_once(df: DataFrame, path: str) -> None:
    """Kept from the first time on."""
    df.write.mode("ignore").parquet(path)


def ingest(payloads: DataFrame, sources: DataFrame, projects: DataFrame, sessions: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """Pushed conversations (source, data_class, project_id, project_name, session_id, title, messages array) into the four tables.

    A source that is new needs a class; a known one keeps its own. Rows are keyed by outside ids, so a payload may come again.
    """
    unclassed = payloads.join(sources.select(F.col("name").alias("source")), "source", "left_anti").where(F.coalesce(F.trim("data_class"), F.lit("")) == "")
    if row := unclassed.select("source").first():
        raise ValueError(f"source {row[0]} is new and has no data class")
    one = latest(payloads, ["session_id"], [F.desc(F.size("messages")), F.col("title")])
    new_sources = payloads.groupBy(F.col("source").alias("name")).agg(F.min(F.lower(F.trim("data_class"))).alias("data_class"))
    new_projects = payloads.groupBy(F.col("source").alias("source_name"), "project_id").agg(F.max("project_name").alias("name"))
    said = payloads.select("session_id", F.explode("messages").alias("m")).select("session_id", F.col("m.external_id").alias("external_id"), F.col("m.role").alias("role"), F.col("m.content").alias("content_text"))
    after = insert_absent(messages, said, ["session_id", "external_id"])
    merged = merge_by_key(sessions, one.select("session_id", "project_id", "title"), ["session_id"])
    stats = after.groupBy("session_id").agg(F.count("*").alias("message_count"), F.sum(F.length("content_text")).alias("content_chars"))
    return {
        "sources": insert_absent(sources, new_sources, ["name"]), "projects": merge_by_key(projects, new_projects, ["source_name", "project_id"]), "messages": after,
        "sessions": merged.drop("message_count", "content_chars").join(stats, "session_id", "left").select(*sessions.columns),
    }
