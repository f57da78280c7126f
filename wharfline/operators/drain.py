"""One round of the embedding work: what is pending is judged, embedded, and noted; what came out broken is marked for later. Rounds are jobs; calling again goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.scaffolding import classify
from wharfline.operators import merge, pending
from wharfline.operators.embedding import Embedder, embed, hashed_bag
from wharfline.operators.upkeep import UNEMBEDDABLE, drop_healed
from wharfline.storage import written

MESSAGES = "convo-messages"
#: How many are taken at a time, and how many more are fetched since some will be noise.
BATCH, OVER_FETCH = 100, 1.3
ROWS = "message_id long, collection string, failure_reason string, failure_detail string, retry_count int, updated_at timestamp_ntz"


def drain_messages(messages: DataFrame, rows: DataFrame, now: Column, limit: int | None = None, embedder: Embedder = hashed_bag) -> tuple[DataFrame, DataFrame]:
    """messages (id, role, content_text), rows as ROWS: (vectors made, rows afterwards). Short messages first; noise is marked and never tried again, vectors that
    are not finite are marked for a retry, and a good vector clears an earlier failure. Without a limit everything pending is taken."""
    due = pending.pending_messages(messages, rows, now)
    due = pending.short_first(due, round(limit * OVER_FETCH)) if limit is not None else due
    judged = written(due.select("id", "content_text", classify(F.col("content_text")).alias("noise")), "judged")
    good = judged.where("noise IS NULL")
    good = pending.short_first(good, limit) if limit is not None else good
    made = written(embed(good, "id", "content_text", embedder), "embedded")
    note = lambda df, collection, reason, detail: df.select(F.col("id").alias("message_id"), F.lit(collection).alias("collection"), reason.cast("string").alias("failure_reason"), detail.cast("string").alias("failure_detail"))
    none = F.lit(None)
    done = note(made.where("failure_reason IS NULL"), MESSAGES, none, none).select("*", F.lit(0).alias("retry_count"), now.alias("updated_at"))
    failed = note(judged.where("noise IS NOT NULL"), UNEMBEDDABLE, F.lit("noise"), F.col("noise")).unionByName(note(made.where("failure_reason IS NOT NULL"), UNEMBEDDABLE, F.col("failure_reason"), none))
    failed = failed.select("*", F.when(F.col("failure_reason") == "nan", 1).otherwise(0).alias("retry_count"), now.alias("updated_at"))
    after = merge.mark_unembeddable(merge.merge_by_key(rows, done, ["message_id", "collection"], default=merge.overwrite), failed)
    return made.where("failure_reason IS NULL").select("id", "embedding"), drop_healed(after, MESSAGES)


def drain_sessions(sessions: DataFrame, done: DataFrame, stored: DataFrame, now: Column, limit: int = BATCH, embedder: Embedder = hashed_bag) -> tuple[DataFrame, DataFrame]:
    """The newest pending sessions (session_id, title, summary, content_chars, started_at, ended_at): (vectors made, done afterwards). A session whose stored vector (session_id,
    content_chars) already covers its content is only noted."""
    due = pending.newest_first(pending.pending_sessions(sessions, done, now), limit)
    have = stored.groupBy("session_id").agg(F.max("content_chars").alias("__have"))
    taken = written(due.join(have, "session_id", "left"), "due")
    fresh = taken.where("__have IS NULL OR __have < content_chars")
    made = embed(fresh.select("session_id", F.coalesce("summary", F.lit("")).alias("text")), "session_id", "text", embedder).where("failure_reason IS NULL").select("session_id", "embedding")
    marks = taken.select("session_id", F.col("content_chars").alias("content_chars_at_embed"))
    return made, merge.merge_by_key(done, marks, ["session_id"], default=merge.overwrite)
