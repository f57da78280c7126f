"""Queries of the status of the whole: dashboards of several parts, rounds of embedding work, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, SESSIONS_SQL, messages, sessions, table
from wharfline.functions import scaffolding, text
from wharfline.operators import drain, links, pending, reports
from wharfline.plans.registry import query
from wharfline.sources import transcripts

NOW = "timestamp_ntz '2024-01-31 00:00:00'"
CLASS_SQL = "['coding', 'personal', 'work'][project_id % 3 + 1]"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in ("coding", "personal", "work")])
    return sessions(spark, sf_dir).withColumn("data_class", F.get(names, (F.col("project_id") % 3).cast("int")))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("session_id", F.floor(F.col("sequence_num") / 3).alias("chunk_index")).distinct()


FILTER = "source_name = 'source1' AND title ILIKE '%e%' AND started_at >= TIMESTAMP '2024-01-01 02:00:00' AND started_at < TIMESTAMP '2024-01-20' AND data_class IN ('coding', 'work')"


@query("ANA-07 FIL-08 FIL-12 WIN-02 JOIN-11", f"""WITH {SESSIONS_SQL}, k AS (SELECT *, {CLASS_SQL} AS data_class FROM sessions), p AS (SELECT session_id, title, started_at, count(*) OVER () AS total FROM k WHERE {FILTER}), c AS (SELECT session_id, count(DISTINCT sequence_num // 3) AS chunk_count FROM messages GROUP BY 1)
SELECT session_id, title, started_at, total, coalesce(chunk_count, 0) AS chunk_count FROM p LEFT JOIN c USING (session_id) ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 5""")
def sessions_page_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.session_filter(_classed(spark, sf_dir), "source1", "e", F.expr("timestamp_ntz '2024-01-01 02:00:00'"), F.expr("timestamp_ntz '2024-01-20 00:00:00'"), ["coding", "work"])
    return reports.session_page(rows.select("session_id", "title", "started_at"), _chunks(spark, sf_dir), 5)


@query("ANA-09 SRT-02", f"WITH {SESSIONS_SQL} SELECT session_id, started_at, message_count, count(*) OVER () AS total FROM sessions WHERE source_name = 'source2' ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 7 OFFSET 2")
def machine_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one machine's sessions."""
    rows = reports.session_filter(sessions(spark, sf_dir), "source2").select("session_id", "started_at", "message_count")
    return reports.page(rows, [F.col("started_at").desc_nulls_last(), F.desc("session_id")], 7, 2)


@query("ANA-20", "SELECT event_id AS record_key, ts AS last_attempt_at, count(*) OVER () AS total FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 ORDER BY ts DESC NULLS LAST, event_id LIMIT 15")
def dead_letters_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open dead letters, the last tried first, with how many there are."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    letters = e.select(F.col("event_id").alias("record_key"), F.col("ts").alias("last_attempt_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("resolved_at"))
    return reports.page(letters.where("resolved_at IS NULL").drop("resolved_at"), [F.col("last_attempt_at").desc_nulls_last(), F.col("record_key")], 15)


PENDING_SQL = "d AS (SELECT session_id FROM sessions WHERE session_id % 2 = 0), w AS (SELECT s.* FROM sessions s WHERE started_at < TIMESTAMP '2024-01-31' - INTERVAL 30 MINUTES AND title IS DISTINCT FROM 'Warmup' AND session_id NOT IN (SELECT session_id FROM d))"


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).withColumn("ended_at", F.col("started_at"))
    done = s.where("session_id % 2 = 0").select("session_id", F.col("content_chars").alias("content_chars_at_embed"))
    return pending.pending_sessions(s, done, F.expr(NOW))


@query("ANA-11 FIL-13 JOIN-07", f"""WITH {SESSIONS_SQL}, {PENDING_SQL}, l AS (SELECT user_id::VARCHAR AS s, ts FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 2 DAYS), a AS (SELECT s, count(*) AS n, max(ts) AS m FROM l GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10), r AS (SELECT session_id, started_at + INTERVAL 1 HOUR AS c FROM sessions WHERE session_id % 2 = 0 ORDER BY c DESC, session_id DESC LIMIT 5)
SELECT 'sessions' AS section, 'total' AS key, count(*) AS n, NULL::TIMESTAMP AS "at" FROM sessions UNION ALL SELECT 'sessions', 'summarized', count(summary), NULL FROM sessions UNION ALL SELECT 'pending', NULL, count(*), min(started_at) FROM w UNION ALL SELECT 'recent', session_id::VARCHAR, NULL, c FROM r UNION ALL SELECT 'active', s, n, m FROM a""")
def summary_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    made = s.where("session_id % 2 = 0").select(F.concat(F.lit("session-"), F.col("session_id").cast("string")).alias("chroma_id"), (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    logs = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.concat(F.lit("Summarizing chunk 1 for session "), F.col("user_id").cast("string")).alias("message"), F.col("ts").alias("logged_at"))
    return reports.summary_status(s, _pending(spark, sf_dir), made, logs, F.expr(NOW), 2880)


@query("ANA-12 FIL-17 FIL-20", f"""WITH {SESSIONS_SQL}, {PENDING_SQL}, p AS (SELECT id FROM messages WHERE length(content_text) > 10 AND role <> 'tool' AND id % 4 <> 0)
SELECT 'recent' AS section, session_id::VARCHAR AS key, NULL::BIGINT AS n, started_at AS "at" FROM (SELECT * FROM sessions WHERE started_at > TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS ORDER BY started_at DESC, session_id DESC LIMIT 10)
UNION ALL SELECT 'waiting', 'messages', count(*), NULL FROM p UNION ALL SELECT 'waiting', 'sessions', count(*), NULL FROM w UNION ALL SELECT 'waiting', 'letters', count(*), NULL FROM events WHERE event_type = 'error' AND event_id % 3 <> 0
UNION ALL SELECT 'latest', session_id::VARCHAR, NULL, started_at FROM (SELECT * FROM sessions WHERE coalesce(title, '') NOT ILIKE '%briefing%' AND session_id % 5 <> 4 ORDER BY started_at DESC, session_id DESC LIMIT 1)""")
def status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every fifth number are briefings by title, whatever their case."""
    s = sessions(spark, sf_dir).withColumn("last_synced_at", F.col("started_at")).withColumn("title", F.when(F.col("session_id") % 5 == 4, "Daily BRIEFING").otherwise(F.col("title")))
    done = messages(spark, sf_dir).where("id % 4 = 0").select(F.col("id").alias("message_id"))
    letters = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("resolved_at"))
    return reports.status(s, pending.pending_messages(messages(spark, sf_dir), done), _pending(spark, sf_dir), letters, F.expr(NOW), 30 * 1440)


@query("ANA-13 JOIN-12 JOIN-02", f"WITH {SESSIONS_SQL} SELECT x.source, CASE WHEN x.source <> 'source2' THEN TIMESTAMP '2024-01-30' END AS last_sync_at, count(s.session_id) AS sessions, coalesce(sum(message_count), 0)::BIGINT AS messages FROM (SELECT unnest(['source0', 'source1', 'source2', 'never']) AS source) x LEFT JOIN sessions s ON s.source_name = x.source GROUP BY 1, 2")
def sources_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, ones that never ran or hold nothing among them."""
    s = sessions(spark, sf_dir)
    named = s.select(F.col("source_name").alias("source")).union(s.limit(1).select(F.lit("never"))).distinct()
    states = named.where("source != 'source2'").select("source", F.expr("timestamp_ntz '2024-01-30 00:00:00'").alias("last_sync_at"))
    return reports.sync_status(states, named, s)


@query("ANA-21", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'click') AS e, count(*) FILTER (event_type = 'click' AND ts > TIMESTAMP '2024-01-30') AS h, count(*) FILTER (event_type = 'click' AND ts > TIMESTAMP '2024-01-01') AS d FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN h > 0 THEN h ELSE d // 24 END AS rate FROM c)
SELECT user_id, (CASE WHEN e + p > 0 THEN e * 100 // (e + p) ELSE 100 END)::BIGINT AS percent, rate::BIGINT AS rate, CASE WHEN h > 0 THEN '1h' ELSE '24h avg' END AS "window", (CASE WHEN rate > 0 THEN p * 60 // rate END)::BIGINT AS minutes_left FROM r""")
def queue_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user as a queue: what moved of late, else a longer time's average."""
    kind = F.col("event_type")
    click = lambda since: F.count_if((kind == "click") & (F.col("ts") > F.expr(f"timestamp_ntz '{since} 00:00:00'")))
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "view").alias("p"), F.count_if(kind == "click").alias("e"), click("2024-01-30").alias("h"), click("2024-01-01").alias("d"))
    return c.select("user_id", *[v.alias(k) for k, v in reports.queue_eta(F.col("p"), F.col("e"), F.col("h"), F.col("d")).items()])


@query("ANA-22 AGG-22 FIL-23", "SELECT coalesce(CASE event_type WHEN 'error' THEN 'nan' WHEN 'signup' THEN 'noise' END, 'legacy-null') AS reason, count(*) AS n, min(user_id % 5) AS least_retries, max(user_id % 5) AS most_retries, count(*) FILTER (event_type = 'error' AND user_id % 5 < 3 AND ts < TIMESTAMP '2024-01-24') AS eligible FROM events GROUP BY 1")
def healing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = F.when(F.col("event_type") == "error", "nan").when(F.col("event_type") == "signup", "noise")
    rows = table(spark, sf_dir, "events").select(why.alias("failure_reason"), (F.col("user_id") % 5).alias("retry_count"), F.col("ts").alias("updated_at"))
    return reports.healing(rows, pending.retry_due(F.expr(NOW)))


@query("ANA-04 MTH-03", f"""WITH {SESSIONS_SQL}, v AS (SELECT id AS message_id, session_id FROM messages WHERE id % 3 = 0) SELECT count(*) AS sessions, count(summary) AS summarized, floor(epoch(TIMESTAMP '2024-01-31' - max(started_at)) / 60)::BIGINT AS session_age, (SELECT count(*) FROM v) AS vectors, (SELECT floor(epoch(TIMESTAMP '2024-01-31' - max(s.started_at)) / 60)::BIGINT FROM v JOIN sessions s USING (session_id)) AS vector_age,
(SELECT count(*) FROM v) AS covered, (SELECT round((SELECT count(*) FROM v) * 100.0 / count(*), 2) FROM messages) AS percent, count(*) FILTER (summary IN ('No embeddable content', 'Embedding generation failed') OR regexp_matches(summary, '(?i)^\\s*(NO_UPDATE|NO UPDATE|N/A|None)\\s*$') OR (length(summary) < 500 AND content_chars > 8000) OR (content_chars > 5000 AND length(summary)::DOUBLE / content_chars < 0.005)
 OR (length(summary) > 2000 AND len(string_split(summary, ' ')) > 300 AND len(list_distinct(string_split(summary, ' ')))::DOUBLE / len(string_split(summary, ' ')) < 0.05)) AS any_bad FROM sessions""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, quality and freshness in one row."""
    s, said = sessions(spark, sf_dir), messages(spark, sf_dir)
    made = said.where("id % 3 = 0").select(F.col("id").alias("message_id"), "session_id").join(s.select("session_id", F.col("started_at").alias("created_at")), "session_id")
    return reports.health(s.drop("title"), said, made, F.expr(NOW))


@query("ANA-25 JOIN-04", f"WITH {SESSIONS_SQL} SELECT count(*) AS sessions, count(*) FILTER (session_id % 7 = 0) AS without_start, count(*) FILTER (session_id % 3 = 1) AS without_messages, count(*) FILTER (session_id % 3 = 1 OR session_id % 5 = 0) AS wrong_count FROM sessions")
def session_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("session_id")
    s = sessions(spark, sf_dir).withColumn("started_at", F.when(i % 7 != 0, F.col("started_at"))).withColumn("message_count", F.when(i % 5 == 0, F.col("message_count") + 1).otherwise(F.col("message_count")))
    return reports.diagnostics(s, messages(spark, sf_dir).where("session_id % 3 <> 1"))


@query("ANA-27", f"WITH {MESSAGES_SQL} SELECT CASE WHEN length(content_text) <= 8000 THEN 'short' ELSE 'long' END AS size, count(*) FILTER (id % 3 = 0) AS done, count(*) FILTER (id % 3 <> 0) AS pending FROM messages WHERE length(content_text) > 10 AND role <> 'tool' GROUP BY 1")
def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir)
    return pending.progress(said, said.where("id % 3 = 0").select(F.col("id").alias("message_id")))


@query("ANA-17 AGG-13 SRT-03", f"""WITH {SESSIONS_SQL} SELECT 'size' AS section, CASE WHEN content_chars < 500 THEN '<500' WHEN content_chars < 2000 THEN '500-1999' ELSE '>=2000' END AS key, count(*) AS n, sum(content_chars)::BIGINT AS chars FROM sessions GROUP BY 2
UNION ALL SELECT 'longest', session_id::VARCHAR, message_count, content_chars FROM (SELECT * FROM sessions ORDER BY content_chars DESC, session_id LIMIT 20) UNION ALL SELECT 'summarized', source_name, count(summary), sum(content_chars)::BIGINT FROM sessions GROUP BY 2""")
def longest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_sessions(sessions(spark, sf_dir), [500, 2000])


@query("ANA-18 AGG-14", f"""WITH {SESSIONS_SQL} SELECT 'role' AS section, role AS key, count(*) AS n FROM messages GROUP BY 2 UNION ALL SELECT 'session', session_id::VARCHAR, message_count FROM (SELECT * FROM sessions ORDER BY message_count DESC, session_id LIMIT 10)
UNION ALL SELECT 'day', strftime(started_at, '%Y-%m-%d'), count(*) FROM sessions WHERE started_at > TIMESTAMP '2024-01-31' - INTERVAL 29 DAYS GROUP BY 2""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overview(messages(spark, sf_dir), sessions(spark, sf_dir), F.expr(NOW), 29)


@query("ANA-05 AGG-02 AGG-17", f"WITH {SESSIONS_SQL} SELECT {CLASS_SQL} AS data_class, source_name, count(*) AS sessions, sum(message_count)::BIGINT AS messages FROM sessions GROUP BY ROLLUP (data_class, source_name) HAVING data_class IS NOT NULL")
def stats_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_class(_classed(spark, sf_dir))


@query("SET-05", "SELECT DISTINCT 'm' || user_id % 13 AS machine FROM events UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def machines_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 13).cast("string")).alias("machine"))
    return reports.known_machines(logs, table(spark, sf_dir, "documents").select(F.col("source").alias("machine")))


# --- noise, rounds of embedding

#: A text for each of text.NOISE, in its order.
SAMPLES = (
    "[Request interrupted by user", "[THINKING] so", "No results found", "No files found", "No matches found", "File created successfully", "Updated task #4", "MCP error 3", "To github.com:u/r.git", "Exit code 1", "  CREATE TABLE t", " 3 rows affected",
    '{"ok":false}', "x\n📬 *Slack heads-up", "x\n##  Slack Brief", "x\nAll clear! No urgent items", "ACCESSIBILITY ACCOMMODATION a\nb screen reader", "IMMEDIATE DISMISSAL a\nb dismissed-urls.txt",
)
SAMPLE_SQL = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SAMPLES) + "]"


def noise_sql(column: str) -> str:
    """text.noise_reason for DuckDB, of stripped text."""
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches({column}, {literal(text.NOISE_FLAGS.get(p, '') + p)}) THEN {literal('pattern:' + p)}" for p in text.NOISE)
    return f"CASE WHEN length({column}) < 50 THEN 'too-short:' || length({column}) {cases} END"


@query("TXT-03 STR-01", f"WITH t AS (SELECT doc_id, coalesce(({SAMPLE_SQL})[(doc_id % 21)::BIGINT + 1] || ' ', '') || coalesce(text, '') AS x FROM documents) SELECT doc_id, CASE WHEN doc_id % 21 = 20 THEN 'scaffolding-only' ELSE {noise_sql('x')} END AS reason FROM t")
def noise_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin as each kind of noise does, some wrapped by a hook, which goes first; the last kind is a hook's words alone."""
    k = (F.col("doc_id") % 21).cast("int")
    sample = F.get(F.array(*[F.concat(F.lit(s), F.lit(" ")) for s in SAMPLES]), k)
    said = F.concat(F.coalesce(sample, F.lit("")), F.coalesce("text", F.lit("")))
    hook = F.lit("<system-reminder>by a hook</system-reminder>\n")
    raw = F.when(k == 20, F.concat(hook, F.lit("<command-name>/go</command-name>"))).otherwise(said)
    return table(spark, sf_dir, "documents").select("doc_id", scaffolding.classify(raw).alias("reason"))


@query("STM-18 SNK-09 SNK-10 TXT-03", f"""WITH {MESSAGES_SQL}, p AS (SELECT id, {noise_sql('content_text')} AS noise FROM messages WHERE length(content_text) > 10 AND role <> 'tool' AND id % 5 <> 0)
SELECT id AS message_id, CASE WHEN noise IS NULL THEN 'convo-messages' ELSE 'UNEMBEDDABLE' END AS collection, CASE WHEN noise IS NOT NULL THEN 'noise' END AS failure_reason, noise AS failure_detail, 0 AS retry_count FROM p UNION ALL SELECT id, 'convo-messages', NULL, NULL, 0 FROM messages WHERE id % 5 = 0""")
def messages_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round over all that is pending, and one more, which finds nothing left to do."""
    said, now = messages(spark, sf_dir), F.expr(NOW)
    rows = said.where("id % 5 = 0").select(F.col("id").alias("message_id"), F.lit(drain.MESSAGES).alias("collection"), F.lit(None).cast("string").alias("failure_reason"), F.lit(None).cast("string").alias("failure_detail"), F.lit(0).alias("retry_count"), now.alias("updated_at"))
    _, once = drain.drain_messages(said, rows, now)
    left, twice = drain.drain_messages(said, once, now)
    if not left.isEmpty():
        raise RuntimeError("the second round found work")
    return twice.drop("updated_at")


@query("STM-19 SRT-08 SNK-32", f"""WITH {SESSIONS_SQL}, {PENDING_SQL}, t AS (SELECT * FROM w ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 30) SELECT session_id, session_id % 3 <> 1 AS embedded FROM t""")
def sessions_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thirty; a third of them has a vector that covers its content already, and is only noted."""
    s = sessions(spark, sf_dir).withColumn("ended_at", F.col("started_at"))
    done = s.where("session_id % 2 = 0").select("session_id", F.col("content_chars").alias("content_chars_at_embed"))
    stored = s.where("session_id % 3 = 1").select("session_id", "content_chars")
    made, after = drain.drain_sessions(s, done, stored, F.expr(NOW), 30)
    noted = after.join(done.select("session_id"), "session_id", "left_anti").select("session_id")
    return noted.join(made.select("session_id", F.lit(True).alias("embedded")), "session_id", "left").fillna(False, ["embedded"])


@query("JSN-03", f"WITH {MESSAGES_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'run' END AS tool, CASE WHEN id % 3 = 0 THEN 'first' || chr(10) || id ELSE 'first' END AS thinking FROM messages")
def parts_of_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tool used and all thinking of contents that are arrays of parts."""
    part = lambda **v: F.struct(*[v.get(k, F.lit(None).cast("string")).alias(k) for k in ("type", "text", "thinking", "name", "input", "content")])
    parts = [F.array(part(type=F.lit("thinking"), thinking=F.lit("first"))), F.when(F.col("id") % 2 == 0, F.array(part(type=F.lit("tool_use"), name=F.lit("run")), part(type=F.lit("tool_use"), name=F.lit("other")))).otherwise(F.array(part(type=F.lit("text"), text=F.lit("x")))), F.when(F.col("id") % 3 == 0, F.array(part(type=F.lit("thinking"), thinking=F.col("id").cast("string")))).otherwise(F.array(part(type=F.lit("text"), text=F.lit("y"))))]
    raw = F.to_json(F.concat(*parts))
    return messages(spark, sf_dir).select("id", transcripts.tool_used(raw)["name"].alias("tool"), transcripts.thinking(raw).alias("thinking"))


@query("PTH-12 PTH-03", "SELECT doc_id AS project_id, CASE WHEN doc_id % 3 = 0 THEN '/home/u/p' || doc_id WHEN doc_id % 3 = 1 THEN 'D:/w/' || doc_id ELSE NULL END AS new_path FROM documents")
def projects_repathed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The working directory that proves itself by the directory's name wins, however often another was seen; else the stored path in one spelling; no project is lost."""
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    docs = table(spark, sf_dir, "documents")
    name = F.when(k == 0, F.concat(F.lit("-home-u-p"), d)).otherwise(F.concat(F.lit("x"), d))
    path = F.when(k == 1, F.concat(F.lit("d:\\w\\"), d)).when(k == 2, F.lit(" ")).otherwise(F.lit("old"))
    projects = docs.select(F.col("doc_id").alias("project_id"), F.lit("s").alias("source"), name.alias("external_id"), path.alias("path"), F.lit("m").alias("machine"), F.lit(False).alias("windows_host"))
    seen = docs.select(F.col("doc_id").alias("project_id"), F.explode(F.array(F.concat(F.lit("/home/u/p"), d), F.lit("/tmp/else"), F.lit("/tmp/else"))).alias("cwd"))
    after = links.repath(projects, seen)
    if after.count() != projects.count():
        raise RuntimeError("projects were lost or doubled")
    return after.select("project_id", "new_path")


@query("FIL-09 ANA-10 SRT-11", "SELECT event_id, event_type, ts, (SELECT count(*) FROM events WHERE event_type IN ('error', 'click') AND user_id % 3 = 1 AND contains(props, '1')) AS total FROM events WHERE event_type IN ('error', 'click') AND user_id % 3 = 1 AND contains(props, '1') ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page and count behind one filter."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click") & (F.col("user_id") % 3 == 1) & F.contains("props", F.lit("1")))
    return reports.page(rows.select("event_id", "event_type", "ts"), [F.desc("ts"), F.desc("event_id")], 20)
