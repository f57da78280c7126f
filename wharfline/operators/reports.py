"""Dashboards and health reports: grouped, conditional and gap-filled aggregates.

All of them combine in map tasks, so a hot group costs one row a task. Times come in as `now`, never from the clock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.text import SIGNALS, escape_like, not_warmup, round_half_up, summary_signals
from wharfline.functions.times import spine


def flow_series(events: DataFrame, at: str, flows: Mapping[str, Column], start: str, stop: str, minutes: int) -> DataFrame:
    """A row for each bucket from start to stop, a count for each flow, 0 where nothing happened. One pass over the events."""
    step = f"{minutes} minutes"
    width = minutes * 60_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    inside = events.where(F.col(at).between(F.expr(f"timestamp_ntz '{start}'"), F.expr(f"timestamp_ntz '{stop}'")))
    binned = inside.withColumn("at", F.timestamp_micros(F.floor(micros / width) * width).cast("timestamp_ntz"))
    counts = binned.groupBy("at").agg(*[F.count_if(c).alias(n) for n, c in flows.items()])
    frame = spine(events.sparkSession, start, stop, step)
    return frame.join(counts, "at", "left").select("at", *[F.coalesce(n, F.lit(0)).alias(n) for n in flows])


def totals_and_peaks(series: DataFrame, flows: Sequence[str]) -> DataFrame:
    return series.agg(*[F.sum(n).alias(f"total_{n}") for n in flows], *[F.max(n).alias(f"peak_{n}") for n in flows])


def daily_activity(rows: DataFrame, at: str, start: str, stop: str, measures: Mapping[str, Column]) -> DataFrame:
    """Every day from start to stop with its measures, 0 where nothing happened; days meet rows by equality, not by range."""
    days = spine(rows.sparkSession, start, stop, "1 day", "day", "date")
    grouped = rows.where(F.col(at).between(F.expr(f"timestamp_ntz '{start} 00:00:00'"), F.expr(f"timestamp_ntz '{stop} 23:59:59.999999'"))).groupBy(F.to_date(at).alias("day")).agg(*[c.alias(n) for n, c in measures.items()])
    return days.join(grouped, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def queue_state(pending: Column, embedded: Column, arrived: Column, summaries_pending: Column, summarised: Column, minutes: int) -> dict[str, Column]:
    """Rates a minute, the state of the queue, and the seconds until it is empty."""
    per = lambda x: round_half_up(x / minutes)
    net = round_half_up(per(embedded) - per(arrived))
    moving = (embedded > 0) & (pending > 0)
    state = (
        F.when(moving & (net > 0), "draining").when(moving & (net < 0), "falling-behind").when(moving, "holding")
        .when((summarised > 0) & (summaries_pending > 0), "summarizing").when(pending == 0, "caught-up").otherwise("stalled")
    )
    left = F.when(state == "caught-up", 0.0).when(state == "draining", F.floor(pending / net * 60 + 0.5))
    return {"embedded_per_minute": per(embedded), "arrived_per_minute": per(arrived), "net_per_minute": net, "summarized_per_minute": per(summarised), "state": state, "seconds_remaining": left.cast("long")}


def bad_summaries(sessions: DataFrame, summary: str = "summary", chars: str = "content_chars") -> DataFrame:
    """A row: how many summaries show each signal, any of them, and how many there are. Warmups, deleted and unsummarised sessions are left out."""
    rows = sessions.where(F.col(summary).isNotNull())
    rows = rows.where(not_warmup(F.col("title"))) if "title" in rows.columns else rows
    rows = rows.where(F.col("deleted_at").isNull()) if "deleted_at" in rows.columns else rows
    flagged = rows.select(*[c.alias(n) for n, c in summary_signals(F.col(summary), F.col(chars)).items()])
    bad = F.greatest(*[F.col(n) for n in SIGNALS])
    return flagged.agg(F.count("*").alias("total"), *[F.count_if(F.col(n)).alias(n) for n in SIGNALS], F.count_if(bad).alias("any_bad"))


def by_category(counts: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """The one row of bad_summaries turned into (category, n)."""
    return counts.unpivot([], list(names), "category", "n")


def coverage(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(total, covered, missing, percent)."""
    flags = rows.select(key).join(done.select(key).distinct().withColumn("__d", F.lit(True)), key, "left")
    got = F.count_if(F.col("__d"))
    return flags.agg(F.count("*").alias("total"), got.alias("covered"), (F.count("*") - got).alias("missing"), F.round(F.try_divide(got * 100.0, F.count("*")), 2).alias("percent"))


def latest_per(rows: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """Each group's newest row, missing times last, ties to the larger key."""
    w = Window.partitionBy(group).orderBy(F.col(at).desc_nulls_last(), F.col(key).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the number of all rows beside it; counted in an aggregation of its own, so no window holds everything."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def drift(counts: DataFrame) -> DataFrame:
    """counts (.., parsed, stored, counted, quarantined) with drift and by how much."""
    accounted = F.col("stored") + F.col("quarantined")
    kind = F.when(accounted < F.col("parsed"), "missing-rows").when(F.col("stored") > F.col("parsed"), "surplus-rows").when(F.col("counted") != F.col("stored"), "stale-stats").otherwise("none")
    size = F.when(kind == "missing-rows", F.col("parsed") - accounted).when(kind == "surplus-rows", F.col("stored") - F.col("parsed")).otherwise(0)
    return counts.withColumn("drift", kind).withColumn("rows_off", size)


def size_buckets(value: Column, edges: Sequence[int]) -> Column:
    """The label of the half-open bucket that the value lies in."""
    out = F.when(value < edges[0], f"<{edges[0]}")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(value < high, f"{low}-{high - 1}")
    return out.otherwise(f">={edges[-1]}")


def stalls(pending: Column, moved: Column, warn: int, least: int) -> Column:
    """An alert where a backlog stands and too little has moved."""
    return F.when((pending > warn) & (moved < least), F.concat(F.lit("stalled: "), pending.cast("string"), F.lit(" pending")))


# --- status of the whole


def session_filter(rows: DataFrame, source: str | None = None, contains: str | None = None, since: Column | None = None, until: Column | None = None, classes: Sequence[str] | None = None) -> DataFrame:
    """Live sessions that every given condition holds for; page and count both start here."""
    rows = rows.where("deleted_at IS NULL") if "deleted_at" in rows.columns else rows
    given = [
        F.col("source_name") == source if source is not None else None, F.ilike("title", F.lit(f"%{escape_like(contains)}%")) if contains else None,
        F.col("started_at") >= since if since is not None else None, F.col("started_at") < until if until is not None else None, F.col("data_class").isin(*classes) if classes else None,
    ]
    for condition in given:
        rows = rows.where(condition) if condition is not None else rows
    return rows


def session_page(rows: DataFrame, chunks: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of sessions, newest first, each with its number of chunks and with the number of all."""
    shown = page(rows, [F.col("started_at").desc_nulls_last(), F.desc("session_id")], limit, offset)
    counted = chunks.join(F.broadcast(shown.select("session_id")), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("chunk_count"))
    return shown.join(counted, "session_id", "left").fillna(0, ["chunk_count"])


def _section(name: str, rows: DataFrame, key: Column, n: Column, at: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), at.cast("timestamp_ntz").alias("at"))


def summary_status(sessions: DataFrame, pending_rows: DataFrame, vectors_: DataFrame, logs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """(section, key, n, at): totals, what is pending and since when, the five newest summaries (vectors: chroma_id, created_at), and the sessions that
    log lines (machine, service, message, logged_at) of the last minutes name as being summarised."""
    none = F.lit(None)
    live = sessions.where("deleted_at IS NULL") if "deleted_at" in sessions.columns else sessions
    totals = live.agg(F.count("*").alias("total"), F.count("summary").alias("summarized")).unpivot([], ["total", "summarized"], "k", "n")
    waiting = pending_rows.agg(F.count("*").alias("n"), F.min("started_at").alias("at"))
    made = vectors_.withColumn("session_id", F.regexp_extract("chroma_id", "^session-([0-9]+)$", 1).try_cast("long")).where("session_id IS NOT NULL")
    recent = made.orderBy(F.desc("created_at"), F.desc("session_id")).limit(5)
    busy = logs.where(F.col("message").startswith("Summarizing chunk") & (F.col("logged_at") > now - F.make_dt_interval(mins=F.lit(minutes)))).withColumn("s", F.regexp_extract("message", "for session ([0-9]+)", 1))
    active = busy.where("s != ''").groupBy("s").agg(F.count("*").alias("n"), F.max("logged_at").alias("at")).orderBy(F.desc("at"), "s").limit(10)
    parts = [_section("sessions", totals, F.col("k"), F.col("n"), none), _section("pending", waiting, none, F.col("n"), F.col("at")), _section("recent", recent, F.col("session_id"), none, F.col("created_at")), _section("active", active, F.col("s"), F.col("n"), F.col("at"))]
    return reduce(DataFrame.unionByName, parts)


def status(sessions: DataFrame, pending_messages: DataFrame, pending_sessions: DataFrame, letters: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """(section, key, n, at): sessions synced in the last minutes, work that waits, open dead letters, and the newest session that is no briefing."""
    none = F.lit(None)
    count = lambda rows: rows.agg(F.count("*").alias("n"))
    recent = sessions.where(F.col("last_synced_at") > now - F.make_dt_interval(mins=F.lit(minutes))).orderBy(F.desc("last_synced_at"), F.desc("session_id")).limit(10)
    newest = sessions.where(~F.ilike(F.coalesce("title", F.lit("")), F.lit("%briefing%"))).orderBy(F.desc("started_at"), F.desc("session_id")).limit(1)
    waits = [_section("waiting", count(rows), F.lit(k), F.col("n"), none) for k, rows in (("messages", pending_messages), ("sessions", pending_sessions), ("letters", letters.where("resolved_at IS NULL")))]
    return reduce(DataFrame.unionByName, [_section("recent", recent, F.col("session_id"), none, F.col("last_synced_at")), *waits, _section("latest", newest, F.col("session_id"), none, F.col("started_at"))])


def sync_status(states: DataFrame, sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """(source, last_sync_at, files, sessions, messages): each source with its state, if it ever ran, and what it holds."""
    held = sessions.groupBy(F.col("source_name").alias("source")).agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))
    return sources.select("source").join(states, "source", "left").join(held, "source", "left").fillna(0, ["sessions", "messages"])


def queue_eta(pending_n: Column, embedded: Column, last_hour: Column, last_day: Column) -> dict[str, Column]:
    """percent done, rate an hour (of the last hour, else a day's average), which of both, and minutes left; null where nothing moves. Whole numbers, cut off."""
    rate = F.when(last_hour > 0, last_hour).otherwise(F.floor(last_day / 24)).cast("long")
    all_n = embedded + pending_n
    return {
        "percent": F.when(all_n > 0, F.floor(embedded * 100 / all_n)).otherwise(100).cast("long"), "rate": rate, "window": F.when(last_hour > 0, "1h").otherwise("24h avg"),
        "minutes_left": F.when(rate > 0, F.floor(pending_n * 60 / rate)).cast("long"),
    }


def healing(rows: DataFrame, due: Column) -> DataFrame:
    """(reason, n, least_retries, most_retries, eligible) of failures; eligible by `pending.retry_due`."""
    return rows.groupBy(F.coalesce("failure_reason", F.lit("legacy-null")).alias("reason")).agg(F.count("*").alias("n"), F.min("retry_count").alias("least_retries"), F.max("retry_count").alias("most_retries"), F.count_if(F.coalesce(due, F.lit(False))).alias("eligible"))


def health(sessions: DataFrame, messages: DataFrame, vectors_: DataFrame, now: Column) -> DataFrame:
    """One row: coverage of sessions and messages, signals of bad summaries, and how old the newest session and vector are in minutes."""
    age = lambda c: F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(c).cast("timestamp"))) / 60_000_000).cast("long")
    made = vectors_.agg(F.count("*").alias("vectors"), age("created_at").alias("vector_age"))
    live = sessions.agg(F.count("*").alias("sessions"), F.count("summary").alias("summarized"), age("started_at").alias("session_age"))
    covered = coverage(messages.select("id"), vectors_.select(F.col("message_id").alias("id")), "id").select("covered", "percent")
    return live.crossJoin(made).crossJoin(covered).crossJoin(bad_summaries(sessions).select("any_bad"))  # one row each


def diagnostics(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(sessions, without_start, without_messages, wrong_count): what does not fit together."""
    said = messages.groupBy("session_id").agg(F.count("*").alias("__n"))
    rows = sessions.join(said, "session_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return rows.agg(F.count("*").alias("sessions"), F.count_if(F.col("started_at").isNull()).alias("without_start"), F.count_if(F.col("__n") == 0).alias("without_messages"), F.count_if(F.col("__n") != F.col("message_count")).alias("wrong_count"))


def long_sessions(sessions: DataFrame, edges: Sequence[int], longest: int = 20) -> DataFrame:
    """(section, key, n, chars): how many sessions have which size, the longest ones, and how many of each source have a summary."""
    sized = sessions.groupBy(size_buckets(F.col("content_chars"), edges).alias("key")).agg(F.count("*").alias("n"), F.sum("content_chars").alias("chars"))
    top = sessions.orderBy(F.desc("content_chars"), "session_id").limit(longest).select(F.col("session_id").cast("string").alias("key"), F.col("message_count").alias("n"), F.col("content_chars").alias("chars"))
    covered = sessions.groupBy(F.col("source_name").alias("key")).agg(F.count("summary").alias("n"), F.sum("content_chars").alias("chars"))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("section"), "key", "n", "chars") for name, rows in (("size", sized), ("longest", top), ("summarized", covered))])


def overview(messages: DataFrame, sessions: DataFrame, now: Column, days: int = 7, top: int = 10) -> DataFrame:
    """(section, key, n): messages by role, the sessions with most messages, and sessions of the last days."""
    by_role = messages.groupBy(F.col("role").alias("key")).agg(F.count("*").alias("n"))
    most = sessions.orderBy(F.desc("message_count"), "session_id").limit(top).select(F.col("session_id").cast("string").alias("key"), F.col("message_count").alias("n"))
    recent = sessions.where(F.col("started_at") > now - F.make_interval(days=F.lit(days))).groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("section"), "key", "n") for name, rows in (("role", by_role), ("session", most), ("day", recent))])


def by_class(sessions: DataFrame) -> DataFrame:
    """(data_class, source_name, sessions, messages), and for each class a row with a null source that sums it up."""
    return sessions.rollup("data_class", "source_name").agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages")).where("data_class IS NOT NULL")


def known_machines(logs: DataFrame, projects: DataFrame) -> DataFrame:
    return logs.select("machine").union(projects.select("machine")).where("machine IS NOT NULL").distinct()
