"""Queries of dashboards, health, ingest and plain relational work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, SESSIONS_SQL, messages, sessions, table
from wharfline.functions import paths, text, times
from wharfline.functions.scaffolding import backfill_plan
from wharfline.operators import links, merge, pending, reports
from wharfline.plans.registry import query
from wharfline.streaming import jobs

NOW = "2024-01-31 00:00:00"


def _now():
    return F.expr(f"timestamp_ntz '{NOW}'")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- sessions


@query("SNK-05 SNK-06 AGG-01 AGG-03 UDF-01", f"WITH {MESSAGES_SQL} SELECT session_id, count(*) AS message_count, sum(length(content_text))::BIGINT AS content_chars FROM messages GROUP BY 1")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.session_stats(messages(spark, sf_dir))


@query("ANA-16 PRJ-02 DT-02", """WITH e AS (SELECT user_id, ts, value, round(value * 1e6)::HUGEINT AS millionths FROM events), s AS (SELECT user_id, count(*) AS n, count(value) AS given, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, sum(millionths)::HUGEINT AS total FROM e GROUP BY 1)
SELECT user_id, n, ((us + 500000) // 1000000)::BIGINT AS seconds, (sign(total) * ((2 * abs(total) + 1000000::HUGEINT * given) // (2000000::HUGEINT * given)))::BIGINT AS mean_value FROM s""")
def session_duration_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from first to last event, and the mean of values taken in whole millionths; halves go away from zero. All in whole numbers, so halves do not depend on the order of additions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    millionths = F.round(F.col("value") * 1e6).cast("decimal(38,0)")
    sums = events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count("value").cast("decimal(20,0)").alias("given"), (micros(F.max("ts")) - micros(F.min("ts"))).alias("us"), F.sum(millionths).alias("total")
    )
    mean = F.expr("CAST(sign(total) AS INT) * ((2 * abs(total) + 1000000 * given) div nullif(2000000 * given, 0))")
    return sums.select("user_id", "n", F.expr("(us + 500000) div 1000000").alias("seconds"), mean.cast("long").alias("mean_value"))


@query("WIN-02 SRT-01 SRT-02 FIL-01 FIL-02 FIL-04", f"WITH {SESSIONS_SQL} SELECT session_id, project_id, started_at, message_count, count(*) OVER () AS total FROM sessions WHERE summary IS NOT NULL AND source_name = 'source1' ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 10 OFFSET 5")
def session_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir).where("summary IS NOT NULL AND source_name = 'source1'").select("session_id", "project_id", "started_at", "message_count")
    return reports.page(rows, [F.col("started_at").desc_nulls_last(), F.col("session_id").desc()], 10, 5)


@query("WIN-02 SRT-02", "SELECT event_id, ts, event_type, count(*) OVER () AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 20")
def quarantine_style_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'error'").select("event_id", "ts", "event_type")
    return reports.page(rows, [F.col("ts").desc_nulls_last(), F.col("event_id")], 20)


@query("ANA-08 WIN-01 JOIN-09 AGG-11", """SELECT user_id, n, last_seen, event_id AS latest_event, event_type AS latest_type FROM (SELECT user_id, count(*) AS n, max(greatest(ts, ts - INTERVAL 1 DAY)) AS last_seen FROM events GROUP BY 1)
JOIN (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1) USING (user_id)""")
def machine_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    seen = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.greatest("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))).alias("last_seen"))
    newest = reports.latest_per(rows, "user_id", "ts", "event_id").select("user_id", F.col("event_id").alias("latest_event"), F.col("event_type").alias("latest_type"))
    return seen.join(newest, "user_id")


# --- series


@query("ANA-02 JOIN-06 SRC-14 DT-04 JOIN-02", """SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS n, coalesce(sum((event_type = 'purchase')::INT), 0)::BIGINT AS purchases FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) s(d) LEFT JOIN events ON ts >= d AND ts < d + INTERVAL 1 DAY GROUP BY d""")
def activity_daily_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_activity(events(spark, sf_dir), "ts", "2023-12-28", "2024-02-02", {"n": F.count("*"), "purchases": F.count_if(F.col("event_type") == "purchase")})


SERIES_SQL = """spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-14', TIMESTAMP '2024-01-15', INTERVAL 15 MINUTES)) AS "at"),
binned AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01') AS "at", count(*) FILTER (event_type = 'view') AS arrived, count(*) FILTER (event_type = 'click') AS embedded, count(*) FILTER (event_type = 'purchase') AS summarized FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15' GROUP BY 1),
series AS (SELECT "at", coalesce(arrived, 0) AS arrived, coalesce(embedded, 0) AS embedded, coalesce(summarized, 0) AS summarized FROM spine LEFT JOIN binned USING ("at"))"""
FLOWS = {"arrived": "view", "embedded": "click", "summarized": "purchase"}


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = {n: F.col("event_type") == t for n, t in FLOWS.items()}
    return reports.flow_series(events(spark, sf_dir), "ts", flows, "2024-01-14 00:00:00", "2024-01-15 00:00:00", 15)


@query("ANA-01 DT-03 JOIN-08 JOIN-03", f"WITH {SERIES_SQL} SELECT * FROM series")
def flow_series_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir)


@query("AGG-16", f"WITH {SERIES_SQL} SELECT sum(arrived)::BIGINT AS total_arrived, sum(embedded)::BIGINT AS total_embedded, sum(summarized)::BIGINT AS total_summarized, max(arrived) AS peak_arrived, max(embedded) AS peak_embedded, max(summarized) AS peak_summarized FROM series")
def flow_series_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals_and_peaks(_series(spark, sf_dir), list(FLOWS))


@query("AGG-14 AGG-08", "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS GROUP BY 1")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") > _now() - F.expr("INTERVAL 7 DAYS")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("STM-15 DT-03", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_windowed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed_rates(events(spark, sf_dir)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("STM-07", """WITH m AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES AS cut FROM events), s AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jobs.session_gaps(events(spark, sf_dir))
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


# --- throughput


@query("ANA-03 ANA-23 MTH-01 MTH-02 MTH-05 PRJ-01 FIL-17", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click' AND ts > TIMESTAMP '2024-01-24') AS embedded, count(*) FILTER (event_type = 'view' AND ts > TIMESTAMP '2024-01-24') AS arrived, count(*) FILTER (event_type = 'signup') AS sp, count(*) FILTER (event_type = 'purchase' AND ts > TIMESTAMP '2024-01-24') AS summarized FROM events GROUP BY 1),
r AS (SELECT *, floor(embedded / 60.0 * 100 + 0.5) / 100 AS e, floor(arrived / 60.0 * 100 + 0.5) / 100 AS a FROM c), n AS (SELECT *, floor((e - a) * 100 + 0.5) / 100 AS net FROM r),
s AS (SELECT *, CASE WHEN embedded > 0 AND pending > 0 THEN CASE WHEN net > 0 THEN 'draining' WHEN net < 0 THEN 'falling-behind' ELSE 'holding' END WHEN summarized > 0 AND sp > 0 THEN 'summarizing' WHEN pending = 0 THEN 'caught-up' ELSE 'stalled' END AS state FROM n)
SELECT user_id, pending, e::DOUBLE AS embedded_per_minute, net::DOUBLE AS net_per_minute, state, (CASE state WHEN 'caught-up' THEN 0 WHEN 'draining' THEN floor(pending / net * 60 + 0.5) END)::BIGINT AS seconds_remaining, CASE WHEN pending > 10 AND embedded < 2 THEN 'stalled: ' || pending || ' pending' END AS alert FROM s""")
def throughput_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, recent = F.col("event_type"), F.col("ts") > F.expr("timestamp_ntz '2024-01-24 00:00:00'")
    counts = events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(kind == "view").alias("pending"), F.count_if((kind == "click") & recent).alias("embedded"), F.count_if((kind == "view") & recent).alias("arrived"), F.count_if(kind == "signup").alias("owed"), F.count_if((kind == "purchase") & recent).alias("summarized")
    )
    made = reports.queue_state(*[F.col(c) for c in ("pending", "embedded", "arrived", "owed", "summarized")], 60)
    alert = reports.stalls(F.col("pending"), F.col("embedded"), 10, 2)
    return counts.select("user_id", "pending", *[made[n].alias(n) for n in ("embedded_per_minute", "net_per_minute", "state", "seconds_remaining")], alert.alias("alert"))


# --- pending work


@query("STM-04 JOIN-04 FIL-19", "SELECT d.doc_id, length(text)::BIGINT AS chars FROM documents d WHERE length(text) > 10 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("user").alias("role"), F.col("text").alias("content_text"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"))
    return pending.pending_messages(docs, done).select(F.col("id").alias("doc_id"), F.length("content_text").cast("long").alias("chars"))


@query("STM-06 FIL-23 DT-05", """WITH done AS (SELECT event_id AS message_id, CASE WHEN event_type = 'error' THEN 'nan' WHEN event_type = 'signup' THEN 'noise' END AS failure_reason, user_id % 5 AS retry_count, ts AS updated_at FROM events)
SELECT doc_id FROM documents d WHERE length(text) > 10 AND NOT EXISTS (SELECT 1 FROM done e WHERE e.message_id = d.doc_id AND NOT coalesce(failure_reason = 'nan' AND retry_count < 3 AND updated_at < TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS, FALSE))""")
def pending_retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("user").alias("role"), F.col("text").alias("content_text"))
    why = F.when(F.col("event_type") == "error", "nan").when(F.col("event_type") == "signup", "noise")
    done = events(spark, sf_dir).select(F.col("event_id").alias("message_id"), why.alias("failure_reason"), (F.col("user_id") % 5).alias("retry_count"), F.col("ts").alias("updated_at"))
    return pending.pending_messages(docs, done, _now()).select(F.col("id").alias("doc_id"))


@query("STM-05 FIL-21 FIL-22", f"""WITH {SESSIONS_SQL}, done AS (SELECT session_id, max(content_chars - (session_id % 3) * 10) AS mark FROM sessions WHERE session_id % 2 = 0 GROUP BY 1)
SELECT s.session_id, content_chars FROM sessions s LEFT JOIN done d USING (session_id) WHERE started_at < TIMESTAMP '2024-01-31' - INTERVAL 30 MINUTES AND title IS DISTINCT FROM 'Warmup' AND (d.mark IS NULL OR content_chars > d.mark OR coalesce(content_chars, 0) = 0)""")
def growth_reembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir).withColumn("ended_at", F.col("started_at"))
    done = rows.where("session_id % 2 = 0").select("session_id", (F.col("content_chars") - (F.col("session_id") % 3) * 10).alias("content_chars_at_embed"))
    return pending.pending_sessions(rows, done, _now()).select("session_id", "content_chars")


@query("STM-08", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY length(text) > 8000, doc_id DESC LIMIT 100")
def short_first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.col("text").alias("content_text"))
    return pending.short_first(rows, 100).select(F.col("id").alias("doc_id"), F.length("content_text").cast("long").alias("chars"))


# --- health and quality

SIGNALS_SQL = r"""flags AS (SELECT
 coalesce(regexp_matches(s, '^\[(USER|ASSISTANT|SYSTEM|TOOL)\]:') AND c > 8000, FALSE) AS truncated, s IN ('No embeddable content', 'Embedding generation failed') AS marker_only,
 regexp_matches(s, '(?i)^\s*(NO_UPDATE|NO UPDATE|N/A|None)\s*$') AS no_update, regexp_matches(s, '(?i)^\s*(<done>|</?think>|BLOCKED|ERROR:|I cannot|I am unable|I''m unable|I will not)') AS refusal,
 c > 8000 AND (length(s) - length(replace(s, '[USER]:', ''))) + (length(s) - length(replace(s, '[ASSISTANT]:', ''))) > 14 AS raw_message_leak, length(s) < 500 AND c > 8000 AS too_short,
 c > 5000 AND length(s)::DOUBLE / nullif(c, 0) < 0.005 AS over_compressed, length(s) > 2000 AND len(string_split(s, ' ')) > 300 AND len(list_distinct(string_split(s, ' ')))::DOUBLE / len(string_split(s, ' ')) < 0.05 AS loopy,
 regexp_matches(s, '^\s*\{') AND regexp_matches(s, '"file_paths"\s*:') AS json_dump, c > 8000 AND (length(s) - length(replace(s, '```', ''))) // 3 >= 4 AS code_dump, starts_with(s, '[unsummarizable]') AS unsummarizable
 FROM (SELECT text AS s, n_chars * 2 AS c FROM documents))"""
SIGNAL_NAMES = text.SIGNALS


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("summary"), (F.col("n_chars") * 2).alias("content_chars"))
    return reports.bad_summaries(rows)


@query("TXT-14 AGG-06 AGG-12 FIL-13 FIL-14 STR-04 STR-08 STR-10 MTH-03", f"WITH {SIGNALS_SQL} SELECT count(*) AS total, {', '.join(f'count(*) FILTER ({n}) AS {n}' for n in SIGNAL_NAMES)}, count(*) FILTER ({' OR '.join(SIGNAL_NAMES)}) AS any_bad FROM flags")
def summary_quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query("SET-02", f"WITH {SIGNALS_SQL}, c AS (SELECT {', '.join(f'count(*) FILTER ({n}) AS {n}' for n in SIGNAL_NAMES)} FROM flags) UNPIVOT c ON COLUMNS(*) INTO NAME category VALUE n")
def summary_quality_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_category(_signals(spark, sf_dir))


@query("JOIN-02", "SELECT count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing, round(count(l.doc_id) * 100.0 / count(*), 2) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("STR-01", r"SELECT doc_id, CASE WHEN length(text) < 50 THEN 'too-short:' || length(text) WHEN regexp_matches(text, '^Exit code \d') THEN 'pattern:^Exit code \d' END AS reason FROM documents WHERE length(text) < 50 OR regexp_matches(text, '^Exit code \d')")
def noise_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.noise_reason(F.col("text")).alias("reason")).where("reason IS NOT NULL")


@query("TXT-04 STR-07", f"WITH {SESSIONS_SQL} SELECT count(*) AS total, count(title) AS titled, count(*) FILTER (length(title) = 40) AS full_length, count(*) FILTER (regexp_matches(trim(split_part(title, chr(10), 1)), '^(You are (a Slack monitoring assistant|a curiosity curator|an ADHD accessibility assistant|an MCP availability checker|Henchman, the theatrical lab assistant)|Huddle in #)')) AS automated FROM sessions")
def automated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count("title").alias("titled"), F.count_if(F.length("title") == 40).alias("full_length"), F.count_if(text.automated_reason(F.col("title")).isNotNull()).alias("automated")
    )


@query("WIN-08 AGG-09 JOIN-05", "WITH f AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents) SELECT doc_id FROM f WHERE line IN (SELECT line FROM f GROUP BY line HAVING count(*) >= 3)")
def recurring_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring lines by an aggregation that map tasks combine, then a semi-join; a window would gather each line's rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.split_part("text", F.lit("\n"), F.lit(1))).alias("h"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    often = rows.groupBy("line").agg(F.count("*").alias("n")).where("n >= 3").select("line")
    return rows.select("doc_id", "line").join(often, "line", "left_semi").select("doc_id")


WRAPPED_SQL = r"""t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN text ELSE '' END AS x FROM conversations), s AS (SELECT id, x, regexp_replace('/do' || chr(10) || x, '\s+$', '') AS stripped, 138 + length(x) AS n FROM t)"""


@query("TXT-01 TXT-02 TXT-12", rf"""WITH {WRAPPED_SQL}, a AS (SELECT *, CASE WHEN stripped = '/do' THEN 'unembeddable' ELSE 'rewrite' END AS action, 1 - length(stripped) / n::DOUBLE AS removed FROM s)
SELECT id, stripped, action, CASE WHEN action = 'unembeddable' THEN 'scaffolding-only' WHEN removed >= 0.1 THEN 'material-change' ELSE 'minor-change' END AS reason, action = 'unembeddable' OR removed >= 0.1 AS drop_vector FROM a""")
def scaffold_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a tool would have wrapped them, stripped again; half of them say nothing but the command."""
    said = messages(spark, sf_dir)
    wrapped = F.concat(F.lit("<command-name>/do</command-name>\n<command-message>do</command-message>\n<command-args>"), F.when(F.col("id") % 2 == 0, F.col("content_text")).otherwise(F.lit("")), F.lit("</command-args>\n<system-reminder>x</system-reminder>\n"))
    return backfill_plan(said.select("id", wrapped.alias("content_text"))).select("id", "stripped", "action", "reason", "drop_vector")


@query("TXT-13", "SELECT CASE WHEN turn % 2 = 0 AND trim(text) <> '' THEN 'rewrite' ELSE 'unembeddable' END AS action, count(*) AS n FROM conversations GROUP BY 1")
def backfill_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold_strip(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("TXT-16 STR-17", "SELECT doc_id, length(text) < 100 AS short, round(n_chars / nullif(length(text), 0), 3)::DOUBLE AS ratio, length(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'))::BIGINT AS clean_chars FROM documents")
def summary_output_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(text.strip_thinking(t)) < 100).alias("short"), F.round(F.try_divide("n_chars", F.length(t)), 3).alias("ratio"), F.length(text.sanitise(t)).cast("long").alias("clean_chars"))


# --- stats


@query("AGG-02 JOIN-01 AGG-17", "SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are counted by customer before they meet the customers, so nothing fans out and nothing needs to be distinct."""
    by_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(places, "c_nationkey").join(by_customer, "c_custkey", "left")
    return rows.groupBy("r_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 2).alias("revenue"))


@query("ANA-06 SRT-03", f"WITH {SESSIONS_SQL} SELECT project_id, count(*) AS n_sessions, sum(message_count)::BIGINT AS n_messages FROM sessions GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5")
def top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sessions(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n_sessions"), F.sum("message_count").alias("n_messages"))
    return made.orderBy(F.desc("n_messages"), "project_id").limit(5)


@query("AGG-05", "SELECT role, count(*) AS n, round(avg(length(text)))::BIGINT AS mean_chars FROM conversations GROUP BY 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("content_text"))).cast("long").alias("mean_chars"))


@query("ANA-10 FIL-09 SRT-11", "SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('error', 'click') AND user_id = 7 AND props LIKE '%1%' ORDER BY ts DESC, event_id DESC LIMIT 25")
def log_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type").isin("error", "click") & (F.col("user_id") == 7) & F.contains("props", F.lit("1")))
    return rows.select("event_id", "ts", "event_type", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


@query("ANA-10 AGG-18", "SELECT user_id, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2")
def log_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@query("AGG-19 STR-06 JSN-01", r"SELECT nullif(regexp_extract(props, '\"k\": (\d+)', 1), '') AS k, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last_at FROM events GROUP BY 1")
def active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.nullif(F.regexp_extract("props", r'"k": (\d+)', 1), F.lit(""))
    return events(spark, sf_dir).groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_at"))


@query("JSN-01", "SELECT user_id, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY 1")
def json_props_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("k_sum"))


@query("ANA-14 AGG-07", "SELECT event_type, count(*) AS uses, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS high_share FROM events GROUP BY 1")
def tool_stats_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.avg((F.col("value") > 50).cast("double"))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("uses"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(high, 4).alias("high_share"))


@query("ANA-15 AGG-04", f"WITH {SESSIONS_SQL} SELECT project_id, source_name, count(*) AS n_sessions, sum(message_count)::BIGINT AS n_messages, min(started_at) AS first_at, max(started_at) AS last_at FROM sessions GROUP BY 1, 2")
def project_activity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("project_id", "source_name").agg(F.count("*").alias("n_sessions"), F.sum("message_count").alias("n_messages"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))


@query("AGG-13", "SELECT CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 2000 THEN '500-1999' WHEN n_chars < 8000 THEN '2000-7999' ELSE '>=8000' END AS bucket, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(reports.size_buckets(F.col("n_chars"), [500, 2000, 8000]).alias("bucket")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("JOIN-12", "SELECT (SELECT count(*) FROM conversations) AS messages, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00') AS recent")
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").agg(F.count("*").alias("messages"), F.count_distinct("conv_id").alias("sessions"))
    others = [table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors")), events(spark, sf_dir).where("ts > timestamp_ntz '2024-01-29 00:00:00'").agg(F.count("*").alias("recent"))]
    return said.crossJoin(others[0]).crossJoin(others[1])  # one row each


@query("AGG-22", "SELECT coalesce(CASE event_type WHEN 'error' THEN 'nan' WHEN 'signup' THEN 'noise' END, 'ok') AS reason, count(*) AS n, min(user_id % 5) AS least_retries, max(user_id % 5) AS most_retries FROM events GROUP BY 1")
def healing_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = F.when(F.col("event_type") == "error", "nan").when(F.col("event_type") == "signup", "noise")
    retries = F.col("user_id") % 5
    return events(spark, sf_dir).groupBy(F.coalesce(why, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.min(retries).alias("least_retries"), F.max(retries).alias("most_retries"))


# --- stores against each other


@query("ANA-19 AGG-21", """WITH parsed AS (SELECT conv_id, count(DISTINCT turn) AS parsed FROM conversations GROUP BY 1), stored AS (SELECT conv_id, count(*) AS stored FROM conversations WHERE turn <> 1 OR conv_id % 3 <> 0 GROUP BY 1),
c AS (SELECT conv_id, parsed, coalesce(stored, 0) AS stored, parsed - CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS counted, CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS quarantined FROM parsed LEFT JOIN stored USING (conv_id)),
k AS (SELECT *, CASE WHEN stored + quarantined < parsed THEN 'missing-rows' WHEN stored > parsed THEN 'surplus-rows' WHEN counted <> stored THEN 'stale-stats' ELSE 'none' END AS drift FROM c) SELECT conv_id, drift, CASE drift WHEN 'missing-rows' THEN parsed - stored - quarantined WHEN 'surplus-rows' THEN stored - parsed ELSE 0 END AS rows_off FROM k""")
def verify_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    parsed = rows.groupBy("conv_id").agg(F.count_distinct("turn").alias("parsed"))
    stored = rows.where("turn <> 1 OR conv_id % 3 <> 0").groupBy("conv_id").agg(F.count("*").alias("stored"))
    one = lambda n: F.when(F.col("conv_id") % n == 0, 1).otherwise(0)
    counts = parsed.join(stored, "conv_id", "left").select("conv_id", "parsed", F.coalesce("stored", F.lit(0)).alias("stored"), (F.col("parsed") - one(5)).alias("counted"), one(6).alias("quarantined"))
    return reports.drift(counts).select("conv_id", "drift", F.col("rows_off").cast("long").alias("rows_off"))


@query("ANA-24 JOIN-16 SET-04", "SELECT vec_id AS doc_id, 'orphan' AS kind FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT DISTINCT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.orphans(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")


@query("SET-01 SET-03", "SELECT DISTINCT data_class FROM (SELECT lang AS data_class FROM documents UNION SELECT role FROM conversations) WHERE data_class IS NOT NULL")
def dataclass_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wharfline.operators.retrieval import class_vocabulary

    return class_vocabulary(table(spark, sf_dir, "documents").select(F.col("lang").alias("data_class")), table(spark, sf_dir, "conversations").select(F.col("role").alias("data_class")))


@query("FIL-10 FIL-16", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source IS NOT DISTINCT FROM 'src2'")
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr") & F.col("source").eqNullSafe("src2")).select("doc_id", "lang")


@query("JOIN-07 STR-12", "SELECT d.doc_id, label FROM documents d JOIN embeddings e ON 'msg-' || d.doc_id = 'msg-' || e.vec_id")
def computed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.unbase64(F.base64(F.encode(F.concat(F.lit("msg-"), F.col(c).cast("string")), "UTF-8"))).alias("k")
    docs = table(spark, sf_dir, "documents").select("doc_id", key("doc_id"))
    return docs.join(table(spark, sf_dir, "embeddings").select("label", key("vec_id")), "k").select("doc_id", "label")


@query("JOIN-10 AGG-10", "SELECT n_name, customers, segments FROM nation JOIN (SELECT c_nationkey, count(*) AS customers, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def lateral_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ", ").alias("segments"))
    return table(spark, sf_dir, "nation").join(made, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", "segments")


# --- writes


@query("SNK-04 STM-14", "SELECT count(*) AS n, count(DISTINCT (conv_id, turn)) AS keys, sum(length(text))::BIGINT AS chars FROM conversations")
def ingest_merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the messages are there, all come in, twice: each is there once."""
    said = messages(spark, sf_dir).select("id", "session_id", "content_text")
    once = merge.insert_absent(said.where("id % 2 = 0"), said, ["id"])
    twice = merge.insert_absent(once, said, ["id"])
    return twice.agg(F.count("*").alias("n"), F.count_distinct("id").alias("keys"), F.sum(F.length("content_text")).alias("chars"))


@query("SNK-07 JOIN-17", """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(o.n_chars, 0) + coalesce(n.n_chars, 0) AS n_chars FROM (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0) o
FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS source, n_chars FROM documents WHERE doc_id % 5 <> 0) n USING (doc_id)""")
def upsert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 5 <> 0").withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("new")))
    return merge.merge_by_key(docs.where("doc_id % 3 <> 0"), new, ["doc_id"], {"n_chars": merge.add})


@query("SNK-07 JOIN-17", "SELECT user_id AS message_id, (count(*) FILTER (event_type = 'error') + user_id % 4)::BIGINT AS retry_count FROM events GROUP BY 1, user_id % 4")
def unembeddable_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    errors = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    old = errors.select(F.col("user_id").alias("message_id"), (F.col("user_id") % 4).alias("retry_count"))
    return merge.merge_by_key(old, errors.select(F.col("user_id").alias("message_id"), F.col("n").alias("retry_count")), ["message_id"], {"retry_count": merge.add})


@query("SNK-12", "SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE source END AS source FROM documents")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return merge.replace_groups(docs, docs.where("lang = 'de'").withColumn("source", F.lit(None).cast("string")), ["lang"]).select("doc_id", "source")


@query("SNK-15", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN TIMESTAMP '2024-01-31' END AS deleted_at FROM documents")
def soft_delete_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return merge.soft_delete(docs, table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"], _now())


@query("SNK-17 STM-10", "SELECT count(*) AS n, min(ts) AS first_at FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.prune(events(spark, sf_dir), "ts", _now(), 14).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


# --- paths and parents

PATH_SQL = r"CASE doc_id % 5 WHEN 0 THEN 'd:\work\p' || doc_id % 7 || '\' WHEN 1 THEN '/mnt/d/work/p' || doc_id % 7 WHEN 2 THEN '/home/u//p' || doc_id % 7 || '//' WHEN 3 THEN '  ' ELSE 'plain-' || doc_id % 7 END"
CANONICAL_SQL = r"CASE doc_id % 5 WHEN 0 THEN 'D:/work/p' || doc_id % 7 WHEN 1 THEN '/mnt/d/work/p' || doc_id % 7 WHEN 2 THEN '/home/u/p' || doc_id % 7 WHEN 3 THEN NULL ELSE 'plain-' || doc_id % 7 END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 7).cast("string")
    kind = F.col("doc_id") % 5
    raw = F.when(kind == 0, F.concat(F.lit("d:\\work\\p"), n, F.lit("\\"))).when(kind == 1, F.concat(F.lit("/mnt/d/work/p"), n)).when(kind == 2, F.concat(F.lit("/home/u//p"), n, F.lit("//"))).when(kind == 3, "  ").otherwise(F.concat(F.lit("plain-"), n))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("path"))


@query("PTH-01 PTH-02 PTH-06 PTH-08 UDF-06 STR-05 STR-09", f"""WITH c AS (SELECT doc_id, {CANONICAL_SQL} AS canonical FROM documents) SELECT doc_id, canonical, regexp_replace(canonical, '[^A-Za-z0-9]', '-', 'g') AS encoded, regexp_extract(canonical, '[^/]+$') AS name,
CASE WHEN canonical LIKE 'D:/%' THEN lower(canonical) WHEN canonical LIKE '/mnt/%' THEN 'd:' || lower(substr(canonical, 7)) WHEN canonical LIKE '/%' THEN canonical END AS key FROM c""")
def path_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = paths.canonical(F.col("path"))
    return _paths(spark, sf_dir).select("doc_id", c.alias("canonical"), paths.encoded(c).alias("encoded"), paths.basename(c).alias("name"), paths.equivalence_key(F.col("path"), F.lit(True)).alias("key"))


@query("SNK-30", f"""WITH c AS (SELECT doc_id, {CANONICAL_SQL} AS canonical FROM documents), k AS (SELECT doc_id, CASE WHEN canonical LIKE 'D:/%' THEN lower(canonical) WHEN canonical LIKE '/mnt/%' THEN 'd:' || lower(substr(canonical, 7)) WHEN canonical LIKE '/%' THEN canonical ELSE '#' || doc_id END AS key FROM c)
SELECT count(*) AS projects, (SELECT count(*) FROM documents) AS sessions FROM (SELECT DISTINCT key FROM k)""")
def path_equivalence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir)
    projects = rows.select(F.col("doc_id").alias("project_id"), F.lit("s").alias("source"), "path", F.lit("m").alias("machine"), F.lit(True).alias("windows_host"))
    kept, moved = links.merge_projects(projects, rows.select(F.col("doc_id").alias("session_id"), F.col("doc_id").alias("project_id")))
    return kept.agg(F.count("*").alias("projects")).crossJoin(moved.join(kept, "project_id", "left_semi").agg(F.count("*").alias("sessions")))


@query("JOIN-14 ANA-26 SNK-33", """SELECT doc_id AS session_id, doc_id - 1 AS parent_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id - 1 IN (SELECT doc_id FROM documents)""")
def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("session_id"), F.floor(F.col("doc_id") / 10).alias("project_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("external_id"),
        F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("s"), (F.col("doc_id") - 1).cast("string"))).alias("parent_external_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return links.apply_links(s, links.parent_links(s)).where("parent_id IS NOT NULL").select("session_id", "parent_id")


@query("DT-06 DT-01 FIL-17", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAYS GROUP BY 1")
def since_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime, timezone

    floor = times.since("P3D", datetime(2024, 1, 31, tzinfo=timezone.utc))
    return events(spark, sf_dir).where(F.col("ts") >= F.expr(f"timestamp_ntz '{floor:%Y-%m-%d %H:%M:%S}'")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("WIN-06", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_num FROM events")
def sequence_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_id", "user_id", (F.row_number().over(w) - 1).cast("long").alias("sequence_num"))


@query("SRT-04 SRC-10 SRC-16", "SELECT doc_id, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id > 100").select("doc_id", "n_chars").orderBy("doc_id").limit(50)


@query("SRT-09", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) <= 3")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each language, drawn by a seeded hash. Each map task keeps its own three, so a hot language is small before it meets."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))).alias("draw"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where("n <= 3").select("doc_id", "lang")


@query("AGG-01 AGG-03 PRJ-03", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
