"""Queries of ingest, marking, healing, repair and revert: the library's writes over the given tables, and what SQL says they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, SESSIONS_SQL, messages, sessions, table
from wharfline.operators import centroids, links, merge, upkeep
from wharfline.plans.registry import query
from wharfline.storage import shared_folder, written

NOW = "timestamp_ntz '2024-01-31 00:00:00'"


@query("SNK-01", "SELECT source AS name, CASE WHEN min(doc_id) % 2 = 0 THEN 'work' WHEN min(doc_id) % 3 = 0 THEN 'coding' ELSE 'personal' END AS data_class FROM documents WHERE source IS NOT NULL GROUP BY 1")
def sources_keep_their_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("first"))
    old = named.where("first % 2 = 0").select("name", F.lit("work").alias("data_class"))
    return upkeep.get_or_create_sources(old, named.select("name", F.when(F.col("first") % 3 == 0, F.lit(" Coding ")).alias("data_class")))


@query("SNK-02 PTH-07", """WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents), old AS (SELECT 'x' || doc_id AS external_id, 'D:/w/' || doc_id AS path, 'p' || doc_id AS name, k IN (0, 2) OR doc_id + 1 IN (SELECT doc_id FROM d) AS seen FROM d WHERE doc_id % 2 = 0)
SELECT external_id, path, name, CASE WHEN seen THEN 'new' ELSE 'old' END AS machine FROM old UNION ALL SELECT 'y' || doc_id, '/home/u/' || doc_id, 'q' || doc_id, 'new' FROM d WHERE k = 1
UNION ALL SELECT 'D--w-' || (doc_id - 1), 'D--w-' || (doc_id - 1), 'q' || doc_id, 'new' FROM d WHERE k = 3 AND doc_id - 1 NOT IN (SELECT doc_id FROM d)""")
def projects_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the projects are stored under drive paths. The same ones come in without a path, from the other side of the mount, or by directory name only; and new ones."""
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    before = (F.col("doc_id") - 1).cast("string")
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").select(F.lit("s").alias("source"), F.concat(F.lit("x"), d).alias("external_id"), F.concat(F.lit("D:/w/"), d).alias("path"), F.concat(F.lit("p"), d).alias("name"), F.lit("old").alias("machine"), F.lit(None).cast("string").alias("os"))
    outside = F.when(k == 0, F.concat(F.lit("x"), d)).when(k == 1, F.concat(F.lit("y"), d)).when(k == 2, F.concat(F.lit("-mnt-d-w-"), d)).otherwise(F.concat(F.lit("D--w-"), before))
    path = F.when(k == 1, F.concat(F.lit("/home/u/"), d)).when(k == 2, F.concat(F.lit("/mnt/d/w/"), d)).when(k == 3, F.concat(F.lit("D--w-"), before))
    new = docs.select(F.lit("s").alias("source"), outside.alias("external_id"), path.alias("path"), F.concat(F.lit("q"), d).alias("name"), F.lit("new").alias("machine"), F.when(k == 2, "wsl").alias("os"))
    return upkeep.upsert_projects(old, new).select("external_id", "path", "name", "machine")


@query("SNK-03", """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.title, o.title) AS title, CASE WHEN n.doc_id IS NOT NULL THEN n.is_automated ELSE o.is_automated END AS is_automated, CASE WHEN n.doc_id IS NOT NULL THEN n.stamp ELSE o.stamp END AS file_modified_at
FROM (SELECT doc_id, lang AS title, TRUE AS is_automated, n_chars AS stamp FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS title, FALSE AS is_automated, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 END AS stamp FROM documents WHERE doc_id % 5 <> 0) n USING (doc_id)""")
def sessions_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("title"), F.lit(True).alias("is_automated"), F.col("n_chars").alias("file_modified_at"))
    new = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), F.lit(False).alias("is_automated"), F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).alias("file_modified_at"))
    return upkeep.upsert_sessions(old, new, ("doc_id",))


@query("SNK-09 SNK-32", f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN session_id % 2 = 0 THEN summary ELSE 'old' END AS summary, CASE WHEN session_id % 3 = 0 THEN content_chars ELSE 1 END AS content_chars_at_embed FROM sessions")
def processed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third session is made again; a summary comes for the even ones of them, and stays otherwise."""
    s = sessions(spark, sf_dir)
    old = s.select("session_id", F.when((F.col("session_id") % 2 == 0) & (F.col("session_id") % 3 != 0), F.col("summary")).when(F.col("session_id") % 2 == 0, F.lit(None)).otherwise(F.lit("old")).alias("summary"))
    rows = s.select("session_id", F.lit(1).cast("long").alias("content_chars_at_embed"))
    done = s.where("session_id % 3 = 0").select("session_id", F.when(F.col("session_id") % 2 == 0, F.col("summary")).alias("summary"), "content_chars")
    kept, marks = upkeep.mark_processed(old, rows, done)
    return kept.join(marks, "session_id")


@query("SNK-09 SNK-10", f"""WITH {MESSAGES_SQL} SELECT id AS message_id, CASE WHEN id % 3 = 0 THEN 'nan' ELSE 'noise' END AS failure_reason, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 3 WHEN id % 2 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS retry_count FROM messages""")
def unembeddable_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even messages have failed twice before; now all fail, every third without a finite vector, which alone counts as a try."""
    at = F.expr(NOW)
    rows = messages(spark, sf_dir).select(F.col("id").alias("message_id"), F.lit(upkeep.UNEMBEDDABLE).alias("collection"), F.when(F.col("id") % 3 == 0, "nan").otherwise("noise").alias("failure_reason"), F.lit("x").alias("failure_detail"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("retry_count"), at.alias("updated_at"))
    old = rows.where("message_id % 2 = 0").withColumn("retry_count", F.lit(2))
    return merge.mark_unembeddable(old, rows).select("message_id", "failure_reason", "retry_count")


@query("SNK-11", "SELECT event_id AS message_id, event_type AS failure_reason FROM events WHERE event_type IN ('error', 'signup') AND event_id % 4 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0")
def healed_failures_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of events that have a good row by now go; failures of others and good rows stay."""
    e = table(spark, sf_dir, "events")
    failed = e.where("event_type IN ('error', 'signup')").select(F.col("event_id").alias("message_id"), F.lit(upkeep.UNEMBEDDABLE).alias("collection"), F.col("event_type").alias("failure_reason"))
    good = e.where("event_id % 4 = 0").select(F.col("event_id").alias("message_id"), F.lit("convo-messages").alias("collection"), F.lit(None).cast("string").alias("failure_reason"))
    return upkeep.drop_healed(failed.unionByName(good), "convo-messages").select("message_id", "failure_reason")


@query("SNK-12", f"""WITH {MESSAGES_SQL}, c AS (SELECT session_id, sequence_num // 4 AS chunk_index, count(*) AS n FROM messages GROUP BY 1, 2), f AS (SELECT session_id, sequence_num // 2 AS chunk_index, count(*) AS n FROM messages WHERE session_id % 2 = 0 GROUP BY 1, 2) SELECT * FROM f UNION ALL SELECT * FROM c WHERE session_id % 2 <> 0""")
def chunks_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that were packed anew have their new chunks only."""
    said = messages(spark, sf_dir)
    packed = lambda rows, n: rows.groupBy("session_id", F.floor(F.col("sequence_num") / n).alias("chunk_index")).agg(F.count("*").alias("n"))
    return merge.replace_groups(packed(said, 4), packed(said.where("session_id % 2 = 0"), 2), ["session_id"])


LETTER_SQL = f"{MESSAGES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS attempts, id % 5 = 0 AS closed FROM messages"


@query("SNK-13 TXT-15", f"WITH {LETTER_SQL}")
def quarantine_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message had failed before; one that is nothing but NULs and white space is closed at once."""
    at = F.expr(NOW).cast("timestamp")
    payload = F.when(F.col("id") % 5 == 0, F.lit("\x00 \n\x00")).otherwise(F.concat(F.lit("{"), F.coalesce("content_text", F.lit(""))))
    blank = F.regexp_like(payload, F.lit(r"^[\x00\s]*$"))
    letters = messages(spark, sf_dir).select(
        F.lit("s").alias("source"), F.lit("f").alias("file_path"), F.col("id").cast("string").alias("record_key"), F.base64(F.encode(payload, "UTF-8")).alias("payload_base64"),
        F.lit(1).alias("attempts"), at.alias("first_seen_at"), at.alias("last_attempt_at"), F.when(blank, at).alias("resolved_at"),
    )
    after = merge.quarantine(letters.where("cast(record_key AS long) % 3 = 0"), letters)
    return after.select(F.col("record_key").cast("long").alias("id"), "attempts", F.col("resolved_at").isNotNull().alias("closed"))


@query("SNK-18 SNK-19 UDF-05", """WITH flat AS (SELECT vec_id % 5 AS k, 'session' AS kind, unnest(embedding) AS x, unnest(range(1, 65)) AS place FROM embeddings UNION ALL SELECT label, 'project', unnest(embedding), unnest(range(1, 65)) FROM embeddings),
means AS (SELECT kind, k, place, avg(x::DOUBLE) AS m FROM flat GROUP BY ALL), c AS (SELECT kind, k, list(m ORDER BY place) AS v, sqrt(sum(m * m)) AS len FROM means GROUP BY kind, k),
n AS (SELECT 'session' AS kind, vec_id % 5 AS k, count(*) AS n FROM embeddings GROUP BY 2 UNION ALL SELECT 'project', label, count(*) FROM embeddings GROUP BY 2) SELECT kind, k::BIGINT AS k, n, round(v[1] / len, 6) AS first FROM c JOIN n USING (kind, k)""")
def centroids_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of sessions and of projects, written beside their keys and read again."""
    rows = table(spark, sf_dir, "embeddings").withColumn("session", F.col("vec_id") % 5)
    made = [centroids.centroids(rows, key, "embedding").select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("k"), "n", "centroid") for kind, key in (("session", "session"), ("project", "label"))]
    back = written(made[0].unionByName(made[1]), "centroids")
    return back.select("kind", "k", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


@query("SNK-20", "SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0")
def snapshot_kept_from_first_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), shared_folder(spark, "snapshot")
    merge.snapshot_once(docs.where("doc_id % 2 = 0"), path)
    merge.snapshot_once(docs, path)
    return spark.read.parquet(path)


@query("SNK-21 SNK-38", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphans_backed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that no label knows, as JSON lines, read back."""
    path = shared_folder(spark, "orphans")
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    doomed = upkeep.delete_orphans(table(spark, sf_dir, "embeddings"), known, "vec_id")
    upkeep.backup_json(doomed.select("vec_id", "label"), path)
    return spark.read.schema("vec_id long, label int").json(path)


@query("SNK-38 SNK-08", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def orphans_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return upkeep.delete_orphans(table(spark, sf_dir, "embeddings").select("vec_id", "label"), known, "vec_id", execute=True)


@query("SNK-08", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 3 = 0")
def vectors_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is deleted, then every third comes in, new or again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    left = merge.delete_where(rows, rows.where("vec_id % 5 = 0"), ["vec_id"])
    return merge.merge_by_key(left, rows.where("vec_id % 3 = 0").withColumn("label", F.lit(99)), ["vec_id"], default=merge.overwrite)


@query("SNK-22", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'NO_UPDATE' WHEN doc_id % 4 = 1 THEN '[unsummarizable] x' ELSE 'A plain summary of what was said.' END AS summary FROM documents)
SELECT doc_id AS session_id, CASE WHEN doc_id % 4 > 1 THEN summary END AS summary, (CASE WHEN doc_id % 4 > 1 THEN 1 ELSE 0 END)::BIGINT AS vectors, (CASE WHEN doc_id % 4 > 1 THEN 1 ELSE 0 END)::BIGINT AS rows FROM s""")
def bad_summaries_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("session_id") % 4
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id")).withColumn("summary", F.when(k == 0, "NO_UPDATE").when(k == 1, "[unsummarizable] x").otherwise("A plain summary of what was said.")).withColumn("content_chars", F.lit(100).cast("long"))
    cleared, left, marks = upkeep.reset_bad_summaries(s, s.select("session_id"), s.select("session_id"))
    count = lambda rows, name: rows.groupBy("session_id").agg(F.count("*").alias(name))
    return cleared.select("session_id", "summary").join(count(left, "vectors"), "session_id", "left").join(count(marks, "rows"), "session_id", "left").fillna(0, ["vectors", "rows"])


@query("SNK-23", f"""WITH {MESSAGES_SQL}, t AS (SELECT id, coalesce(content_text, '') AS x FROM messages) SELECT id, CASE WHEN id % 3 = 0 AND trim(x) <> '' THEN regexp_replace(x, '^\\s+|\\s+$', '', 'g') WHEN id % 3 = 0 THEN '<system-reminder>' || repeat('noise ', 20) || '</system-reminder>' || chr(10) || x ELSE x END AS content_text, id % 3 = 0 AS backed_up, id % 3 = 0 AND 1 - length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) / (156 + length(x))::DOUBLE >= 0.1 AS drop_vector FROM t""")
def backfill_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message as a hook had wrapped it: texts rewritten, what they were kept aside, vectors to drop named."""
    hook = F.concat(F.lit("<system-reminder>"), F.repeat(F.lit("noise "), 20), F.lit("</system-reminder>\n"))
    said = messages(spark, sf_dir).select("id", F.coalesce("content_text", F.lit("")).alias("content_text"))
    wrapped = said.withColumn("content_text", F.when(F.col("id") % 3 == 0, F.concat(hook, "content_text")).otherwise(F.col("content_text")))
    after, backup, doomed = upkeep.backfill(wrapped)
    flag = lambda rows, name: rows.select("id", F.lit(True).alias(name))
    return after.join(flag(backup, "backed_up"), "id", "left").join(flag(doomed, "drop_vector"), "id", "left").fillna(False, ["backed_up", "drop_vector"])


@query("SNK-23 SNK-35", f"""WITH {MESSAGES_SQL}, c AS (SELECT DISTINCT session_id FROM messages) SELECT id, content_text, NOT (id % 2 = 0 AND id % 3 = 0) AS marked, session_id % 2 = 0 OR session_id % 4 = 1 AS chunk FROM messages""")
def backfill_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even messages had been rewritten: their texts are back, and no failure of noise stands for them; chunks of sessions that still exist are back too."""
    said = messages(spark, sf_dir).select("id", "session_id", "content_text")
    broken = said.withColumn("content_text", F.when(F.col("id") % 2 == 0, "gone").otherwise(F.col("content_text")))
    rows = said.select(F.col("id").alias("message_id"), F.lit(upkeep.UNEMBEDDABLE).alias("collection"), F.when(F.col("id") % 3 == 0, "noise").otherwise("nan").alias("failure_reason"))
    chunks = said.select("session_id", F.lit(0).alias("chunk_index")).distinct()
    alive = said.where("session_id % 4 <> 3").select("session_id").distinct()
    texts, marks, whole = upkeep.revert_backfill(broken, said.where("id % 2 = 0").select("id", "content_text"), rows, chunks.where("session_id % 2 = 0"), chunks, alive)
    marked = marks.select(F.col("message_id").alias("id"), F.lit(True).alias("marked"))
    there = whole.select("session_id", F.lit(True).alias("chunk"))
    return texts.join(marked, "id", "left").join(there, "session_id", "left").fillna(False, ["marked", "chunk"]).drop("session_id")


@query("SNK-25", f"WITH {SESSIONS_SQL} SELECT session_id, message_count FROM sessions")
def empty_sessions_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).select("session_id", "message_count")
    empty = s.select((-F.col("session_id") - 1).alias("session_id"), F.lit(0).cast("long").alias("message_count"))
    return upkeep.delete_empty_sessions(s.unionByName(empty), messages(spark, sf_dir))


MARK_SQL = f"""{SESSIONS_SQL}, m AS (SELECT session_id, started_at, CASE WHEN session_id % 11 = 0 THEN 'A Warmup run' WHEN session_id % 4 = 0 THEN 'Nightly' || chr(10) || session_id WHEN session_id % 4 = 1 THEN 'You are a curiosity curator of ' || session_id WHEN session_id % 4 = 2 THEN 'Own title ' || session_id END AS title,
 CASE WHEN session_id % 6 = 0 THEN 0 WHEN session_id % 6 = 1 THEN 2 ELSE 40 END AS message_count, session_id % 13 = 0 AS gone FROM sessions), often AS (SELECT split_part(title, chr(10), 1) AS line FROM m WHERE NOT gone GROUP BY 1 HAVING count(*) >= 5)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with warmup titles, recurring first lines, personas and own titles; few, no or many messages; some deleted."""
    i = F.col("session_id")
    title = F.when(i % 11 == 0, "A Warmup run").when(i % 4 == 0, F.concat(F.lit("Nightly\n"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("You are a curiosity curator of "), i.cast("string"))).when(i % 4 == 2, F.concat(F.lit("Own title "), i.cast("string")))
    rows = sessions(spark, sf_dir).select("session_id", "started_at", title.alias("title"), F.when(i % 6 == 0, 0).when(i % 6 == 1, 2).otherwise(40).alias("message_count"))
    return rows.select("*", F.lit(False).alias("is_warmup"), F.lit(False).alias("is_automated"), F.when(i % 13 == 0, F.expr("timestamp_ntz '2020-01-01 00:00:00'")).alias("deleted_at"))


@query("SNK-26 SNK-15", f"""WITH {MARK_SQL} SELECT session_id, w AS is_warmup, CASE WHEN gone THEN TIMESTAMP '2020-01-01' WHEN w THEN TIMESTAMP '2024-01-31' END AS deleted_at FROM (SELECT session_id, gone, NOT gone AND coalesce(lower(title) LIKE '%warmup%' OR message_count BETWEEN 1 AND 3 OR (message_count = 0 AND started_at < TIMESTAMP '2024-01-30') OR split_part(title, chr(10), 1) IN (SELECT line FROM often WHERE line IS NOT NULL), FALSE) AS w FROM m)""")
def warmups_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.mark_warmups(_marked(spark, sf_dir), F.expr(NOW), 5).select("session_id", "is_warmup", "deleted_at")


@query("SNK-27 ANA-30", f"WITH {MARK_SQL} SELECT a AS is_automated, count(*) AS n FROM (SELECT NOT gone AND coalesce(starts_with(title, 'You are a curiosity curator') OR split_part(title, chr(10), 1) IN (SELECT line FROM often WHERE line IS NOT NULL), FALSE) AS a FROM m WHERE NOT gone) GROUP BY 1")
def automated_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.mark_automated(_marked(spark, sf_dir), 5).where("deleted_at IS NULL").groupBy("is_automated").agg(F.count("*").alias("n"))


@query("SNK-28", f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN source_name <> 'source1' THEN title END AS title FROM sessions")
def made_up_titles_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.clear_titles(sessions(spark, sf_dir), "source1").select("session_id", "title")


@query("SNK-29", f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN session_id % 5 = 1 THEN 0 ELSE message_count END AS message_count, content_chars FROM sessions")
def stats_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are wrong for every fifth session and for another fifth; the first are named as drifted."""
    s = sessions(spark, sf_dir).select("session_id", "message_count", "content_chars")
    wrong = s.withColumn("message_count", F.when(F.col("session_id") % 5 < 2, 0).otherwise(F.col("message_count")))
    return upkeep.repair_stats(wrong, messages(spark, sf_dir), s.where("session_id % 5 = 0"))


@query("SNK-31 UDF-01", f"WITH {SESSIONS_SQL} SELECT s.session_id::VARCHAR AS session_id, 'p' || project_id AS project_id, coalesce(title, CASE WHEN s.session_id % 2 = 0 THEN 'old' END) AS title, n AS message_count, c AS content_chars FROM sessions s JOIN (SELECT session_id, count(*) AS n, sum(length(content_text))::BIGINT AS c FROM messages GROUP BY 1) USING (session_id)")
def conversations_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions as pushed payloads, twice, over tables that know the even ones and half of their messages."""
    said, s = messages(spark, sf_dir), sessions(spark, sf_dir)
    key = F.col("session_id").cast("string").alias("session_id")
    item = F.struct(F.col("id").cast("string").alias("external_id"), "role", F.col("content_text").alias("content"))
    grouped = said.groupBy("session_id").agg(F.collect_list(item).alias("messages"))
    payloads = s.join(grouped, "session_id").select(F.col("source_name").alias("source"), F.lit(" Work ").alias("data_class"), F.concat(F.lit("p"), F.col("project_id").cast("string")).alias("project_id"), F.lit("n").alias("project_name"), key, "title", "messages")
    none = lambda *names: payloads.limit(0).select(*[F.lit("").alias(n) for n in names])
    known = s.where("session_id % 2 = 0").select(key, F.lit(None).cast("string").alias("project_id"), F.lit("old").alias("title"), F.lit(0).cast("long").alias("message_count"), F.lit(0).cast("long").alias("content_chars"))
    half = said.where("session_id % 2 = 0 AND sequence_num % 2 = 0").select(key, F.col("id").cast("string").alias("external_id"), "role", "content_text")
    once = merge.ingest(payloads, none("name", "data_class"), none("source_name", "project_id", "name"), known, half)
    twice = merge.ingest(payloads, once["sources"], once["projects"], written(once["sessions"], "sessions"), written(once["messages"], "messages"))
    return twice["sessions"]


@query("SNK-34", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def versions_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions written one after the other; the pointer names the second."""
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), shared_folder(spark, "versions")
    merge.swap(docs.where("doc_id % 2 = 0"), root)
    merge.swap(docs, root)
    return merge.current(spark, root).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SNK-36", "SELECT vec_id, CASE WHEN label = 3 THEN 'repair-1' ELSE 'first' END AS summarize_model FROM embeddings")
def repaired_vectors_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("session-"), F.col("vec_id").cast("string")).alias("chroma_id"), F.lit("first").alias("summarize_model"), "label")
    return upkeep.mark_repaired(rows, rows.where("label = 3"), "repair-1").select("vec_id", "summarize_model")


@query("SNK-37 ARR-02", "SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0")
def zero_vectors_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("embedding"))
    return upkeep.purge_zero(rows).select("vec_id")


@query("SNK-33 ANA-26", """SELECT doc_id AS session_id, CASE WHEN doc_id % 4 = 1 THEN 7 END AS parent_id FROM documents WHERE doc_id % 2 = 1""")
def links_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of odd sessions are taken back where they are still what the journal wrote."""
    odd = table(spark, sf_dir, "documents").where("doc_id % 2 = 1").select(F.col("doc_id").alias("session_id"))
    journal = odd.withColumn("parent_id", F.col("session_id") - 1)
    now = journal.withColumn("parent_id", F.when(F.col("session_id") % 4 == 1, F.lit(7)).otherwise(F.col("parent_id")))
    return links.revert_links(now, journal)
