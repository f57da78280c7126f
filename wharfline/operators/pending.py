"""What is still to be embedded or summarised: anti-joins, never NOT IN. Selector and counter are the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import not_warmup

#: Retries and rest of a vector that came out broken, the shortest content, and the quiet time before a session counts as over.
MOST_RETRIES, COOLDOWN_DAYS, LEAST_CHARS, QUIET_MINUTES = 3, 7, 10, 30
SHORT_CHARS = 8000


def retry_due(now: Column, retries: int = MOST_RETRIES, days: int = COOLDOWN_DAYS) -> Column:
    """Of bookkeeping rows: broken, with tries left, and rested."""
    return (F.col("failure_reason") == "nan") & (F.col("retry_count") < retries) & (F.col("updated_at") < now - F.make_interval(days=F.lit(days)))


def pending_messages(messages: DataFrame, done: DataFrame, now: Column | None = None) -> DataFrame:
    """Messages with enough text, no tool output, without a bookkeeping row that stands."""
    standing = done if now is None else done.where(~F.coalesce(retry_due(now), F.lit(False)))
    worth = messages.where((F.length("content_text") > LEAST_CHARS) & (F.col("role") != "tool"))
    return worth.join(standing.select(F.col("message_id").alias("id")).distinct(), "id", "left_anti")


def pending_sessions(sessions: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Sessions that are quiet, not warmups, and grown beyond what was embedded (or never were, or have no count)."""
    mark = done.groupBy("session_id").agg(F.max("content_chars_at_embed").alias("mark"))
    quiet = F.col("ended_at").isNull() | (F.col("ended_at") < now - F.expr(f"INTERVAL {QUIET_MINUTES} MINUTES"))
    grown = F.col("mark").isNull() | (F.col("content_chars") > F.col("mark")) | (F.coalesce("content_chars", F.lit(0)) == 0)
    return sessions.where(quiet & not_warmup(F.col("title"))).join(mark, "session_id", "left").where(grown).drop("mark")


def short_first(pending: DataFrame, limit: int) -> DataFrame:
    """The next batch: short texts before long ones, newest first."""
    return pending.orderBy((F.length("content_text") > SHORT_CHARS).asc(), F.desc("id")).limit(limit)


def newest_first(sessions: DataFrame, limit: int) -> DataFrame:
    """The next sessions: those that ended (or began) last, ones without any time at the end."""
    return sessions.orderBy(F.coalesce("ended_at", "started_at").desc_nulls_last(), F.desc("session_id")).limit(limit)


def progress(messages: DataFrame, done: DataFrame) -> DataFrame:
    """(size, done, pending) of short and of long messages."""
    worth = messages.where((F.length("content_text") > LEAST_CHARS) & (F.col("role") != "tool"))
    marked = worth.join(done.select(F.col("message_id").alias("id"), F.lit(True).alias("__done")).distinct(), "id", "left")
    size = F.when(F.length("content_text") <= SHORT_CHARS, "short").otherwise("long")
    return marked.groupBy(size.alias("size")).agg(F.count("__done").alias("done"), (F.count("*") - F.count("__done")).alias("pending"))


def healed(done: DataFrame, collection: str) -> DataFrame:
    """Failure rows of messages that have a good row in the collection by now."""
    good = done.where((F.col("collection") == collection) & F.col("failure_reason").isNull()).select("message_id").distinct()
    return done.where("failure_reason IS NOT NULL").join(good, "message_id", "left_semi")


def orphans(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, kind): in one store only."""
    left = stored.select(key).distinct().join(known.select(key), key, "left_anti").withColumn("kind", F.lit("orphan"))
    right = known.select(key).distinct().join(stored.select(key), key, "left_anti").withColumn("kind", F.lit("missing"))
    return left.unionByName(right)
