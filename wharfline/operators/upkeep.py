"""Upkeep of the conversation tables: post-images of what ingest, marking, healing, repair and revert leave behind.

Every function takes tables and returns tables; `merge.swap` writes them. All are equi-joins and aggregates by the tables' own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions import paths, text, vectors
from wharfline.functions.scaffolding import backfill_plan
from wharfline.operators import merge

#: The class of a source that names none, the session counts of the warmup rules, and the collection of failures.
DEFAULT_CLASS = "personal"
SHORT_SESSION, RECURRING = 3, 20
UNEMBEDDABLE = "UNEMBEDDABLE"


# --- get or create, upserts


def get_or_create_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: (name, data_class). A source that is there keeps its class, whatever comes in; a new one without a class is personal."""
    fresh = new.groupBy("name").agg(F.min(F.lower(F.trim("data_class"))).alias("data_class")).withColumn("data_class", F.coalesce(F.nullif("data_class", F.lit("")), F.lit(DEFAULT_CLASS)))
    return merge.insert_absent(old, fresh, ["name"])


def adopted(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(source, external_id, keeper): which stored project each fresh one is, under another name. Both: (source, external_id, path, os).

    A real path is matched by its key, a mere directory name by how a stored path in any of its spellings would be written as one. Case and mounts
    are folded only where a drive letter on either side or the sender's system proves them the same.
    """
    stored = old.select("source", F.col("external_id").alias("keeper"), paths.canonical(F.col("path")).alias("p")).where(F.contains("p", F.lit("/")))
    asked = fresh.select("source", "external_id", paths.canonical(F.col("path")).alias("q"), paths.windows_host(F.col("os")).alias("host"))
    drive = lambda c: F.coalesce(text.like(F.col(c), paths.DRIVE), F.lit(False))
    real = asked.where(F.contains("q", F.lit("/"))).withColumn("key", paths.equivalence_key(F.col("q"), F.lit(True)))
    same = real.join(stored.withColumn("key", paths.equivalence_key(F.col("p"), F.lit(True))), ["source", "key"]).withColumn("hint", F.col("host") | drive("p") | drive("q"))
    by_path = same.where(paths.equivalence_key(F.col("p"), F.col("hint")) == paths.equivalence_key(F.col("q"), F.col("hint")))
    named = asked.where(~F.coalesce(F.contains("q", F.lit("/")), F.lit(False))).withColumn("name", F.lower("external_id"))
    spelled = stored.select("*", F.explode(paths.variants(F.col("p"))).alias("v")).withColumn("code", paths.encoded(F.col("v"))).withColumn("name", F.lower("code"))
    by_name = named.join(spelled, ["source", "name"]).where((F.col("code") == F.col("external_id")) | paths.ignores_case(F.col("p"), F.col("host") | drive("p")))
    found = by_path.select("source", "external_id", "keeper").unionByName(by_name.select("source", "external_id", "keeper"))
    return found.groupBy("source", "external_id").agg(F.min("keeper").alias("keeper"))


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, external_id, path, name, machine, os): a project comes in under its own key, or under that of the stored one it is. A path that is
    only the raw name never replaces a known one, nor does its name; machine and system stay where nothing new is known."""
    keys = ["source", "external_id"]
    new = new.withColumn("path", paths.canonical(F.col("path")))
    fresh = new.join(old.select(*keys), keys, "left_anti")
    mapped = new.join(adopted(old, fresh), keys, "left")
    taken = mapped.where("keeper IS NOT NULL").groupBy("source", F.col("keeper").alias("external_id")).agg(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("name"), F.max("machine").alias("machine"), F.max("os").alias("os"))
    own = mapped.where("keeper IS NULL").drop("keeper")
    raw = F.col("n.path").isNull() | (F.col("n.path") == F.col("external_id"))
    unless_raw = lambda o, n: F.when(raw, F.coalesce(o, n)).otherwise(n)
    merged = merge.merge_by_key(old, own, keys, {"path": unless_raw, "name": unless_raw})
    return merge.merge_by_key(merged, taken, keys)


#: Sessions keep what is known, but these two always take what comes in.
SESSION_RULES = {"is_automated": merge.overwrite, "file_modified_at": merge.overwrite}


def upsert_sessions(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project_id", "external_id")) -> DataFrame:
    return merge.merge_by_key(old, new, list(keys), SESSION_RULES)


def upsert_embedding_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bookkeeping rows by (message_id, collection): a vector made again overwrites, its watermark (content_chars_at_embed) among the rest."""
    return merge.merge_by_key(old, new, ["message_id", "collection"], default=merge.overwrite)


def mark_processed(sessions: DataFrame, rows: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """done: (session_id, summary, content_chars). Sessions keep a summary where none came; rows (session_id, content_chars_at_embed) get the watermark."""
    kept = merge.merge_by_key(sessions, done.select("session_id", "summary"), ["session_id"])
    marks = done.select("session_id", F.col("content_chars").alias("content_chars_at_embed"))
    return kept.join(sessions.select("session_id"), "session_id", "left_semi"), merge.merge_by_key(rows, marks, ["session_id"], default=merge.overwrite)


def mark_repaired(rows: DataFrame, ids: DataFrame, model: str) -> DataFrame:
    """rows (chroma_id, .., summarize_model) with the model of a repaired vector, which tells it from those still to repair."""
    hit = rows.join(ids.select("chroma_id", F.lit(True).alias("__hit")).distinct(), "chroma_id", "left")
    return hit.withColumn("summarize_model", F.when(F.col("__hit"), model).otherwise(F.col("summarize_model"))).select(*rows.columns)


# --- marks


def _first_line(column: str = "title") -> Column:
    return F.split_part(column, F.lit("\n"), F.lit(1))


def recurring_lines(sessions: DataFrame, least: int = RECURRING) -> DataFrame:
    """(line): first lines of titles that so many live sessions share; counted by an aggregation that map tasks combine."""
    return sessions.where("deleted_at IS NULL").groupBy(_first_line().alias("line")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & F.col("line").isNotNull()).select("line")


def mark_warmups(sessions: DataFrame, now: Column, least: int = RECURRING) -> DataFrame:
    """Live sessions become warmups by title, by having few messages, by being empty for a day, or by a recurring first line; warmups are deleted softly."""
    lined = sessions.withColumn("__line", _first_line()).join(recurring_lines(sessions, least).withColumn("__often", F.lit(True)), F.col("__line") == F.col("line"), "left")
    by_rule = (
        F.contains(F.lower("title"), F.lit("warmup")) | F.col("message_count").between(1, SHORT_SESSION) | ((F.col("message_count") == 0) & (F.col("started_at") < now - F.expr("INTERVAL 1 DAY"))) | F.col("__often")
    )
    marked = lined.withColumn("is_warmup", F.col("is_warmup") | (F.col("deleted_at").isNull() & F.coalesce(by_rule, F.lit(False))))
    return marked.withColumn("deleted_at", F.when(F.col("is_warmup") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(*sessions.columns)


def mark_automated(sessions: DataFrame, least: int = RECURRING) -> DataFrame:
    """Live sessions become automated by a persona's opening line or a recurring one."""
    lined = sessions.withColumn("__line", _first_line()).join(recurring_lines(sessions, least).withColumn("__often", F.lit(True)), F.col("__line") == F.col("line"), "left")
    hit = F.col("deleted_at").isNull() & (text.automated_reason(F.col("title")).isNotNull() | F.coalesce("__often", F.lit(False)))
    return lined.withColumn("is_automated", F.col("is_automated") | hit).select(*sessions.columns)


def clear_titles(sessions: DataFrame, source: str) -> DataFrame:
    """The titles of a source whose titles were made up from the first message."""
    return sessions.withColumn("title", F.when(~F.col("source_name").eqNullSafe(F.lit(source)), F.col("title")))


# --- removals


def reset_bad_summaries(sessions: DataFrame, vectors_: DataFrame, rows: DataFrame, chars: str = "content_chars") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions whose summary shows a signal lose it, and their vectors and bookkeeping rows (both by session_id) go, so that they are made anew."""
    bad = F.greatest(*text.summary_signals(F.col("summary"), F.col(chars)).values())
    doomed = sessions.where(F.col("summary").isNotNull() & bad).select("session_id")
    cleared = sessions.join(doomed.withColumn("__bad", F.lit(True)), "session_id", "left").withColumn("summary", F.when(F.col("__bad"), None).otherwise(F.col("summary"))).select(*sessions.columns)
    return cleared, merge.delete_where(vectors_, doomed, ["session_id"]), merge.delete_where(rows, doomed, ["session_id"])


def delete_empty_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.join(messages.select("session_id").distinct(), "session_id", "left_semi")


def purge_zero(collection: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Without vectors that point nowhere, which no cosine can rank."""
    return collection.where(~F.coalesce(vectors.is_zero(F.col(vector_col)), F.lit(False)))


def delete_orphans(stored: DataFrame, known: DataFrame, key: str, execute: bool = False) -> DataFrame:
    """stored without rows that nothing knows; unless execute is set, only those rows, for a report."""
    return stored.join(known.select(key), key, "left_semi" if execute else "left_anti")


def drop_healed(rows: DataFrame, collection: str) -> DataFrame:
    """Bookkeeping rows without the failures of messages that have a good vector by now."""
    good = rows.where((F.col("collection") == collection) & F.col("failure_reason").isNull()).select("message_id").distinct().withColumn("__good", F.lit(True))
    return rows.join(good, "message_id", "left").where("failure_reason IS NULL OR __good IS NULL").select(*rows.columns)


def backup_json(rows: DataFrame, path: str) -> None:
    """JSON lines, before the rows go."""
    rows.write.mode("errorifexists").json(path)


def repair_stats(sessions: DataFrame, messages: DataFrame, drifted: DataFrame) -> DataFrame:
    """Message counts and characters of the drifted sessions (session_id) counted again; others stay as they are."""
    counted = merge.session_stats(messages.join(drifted.select("session_id").distinct(), "session_id", "left_semi")).select("session_id", "message_count", "content_chars")
    asked = drifted.select("session_id").distinct().join(counted, "session_id", "left").fillna(0, ["message_count", "content_chars"])
    return merge.merge_by_key(sessions, asked, ["session_id"], default=merge.keep_known)


# --- journaled rewriting of stored text


def backfill(messages: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages afterwards, backup of the texts that change, vectors to drop as key): the backup is written before anything else is."""
    plan = backfill_plan(messages.select(key, "content_text"))
    changed = plan.where("action != 'skip'")
    rewritten = merge.merge_by_key(messages, changed.where("action = 'rewrite'").select(key, F.col("stripped").alias("content_text")), [key])
    return rewritten, changed.select(key, "content_text"), changed.where("drop_vector").select(key)


def revert_backfill(messages: DataFrame, backup: DataFrame, rows: DataFrame, chunks: DataFrame, chunk_backup: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts as they were; no failure of noise stands for them any more, so they are judged again; chunks of sessions that still exist are back."""
    restored = merge.merge_by_key(messages, backup, ["id"], default=merge.keep_known).join(messages.select("id"), "id", "left_semi")
    noise = (F.col("collection") == UNEMBEDDABLE) & (F.col("failure_reason") == "noise")
    doomed = rows.where(noise).join(backup.select(F.col("id").alias("message_id")), "message_id", "left_semi").select("message_id", "collection")
    alive = chunk_backup.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return restored, merge.delete_where(rows, doomed, ["message_id", "collection"]), merge.insert_absent(chunks, alive, ["session_id", "chunk_index"])
