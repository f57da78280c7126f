"""Queries of the conversation model: sources, JSON content, paths of requests, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, SESSIONS_SQL, messages, sessions, table
from wharfline.functions import paths, text, times, vectors
from wharfline.operators import retrieval
from wharfline.plans.registry import query
from wharfline.sources import transcripts


@query("SRC-08 SRC-16", "SELECT r_regionkey, r_name FROM region")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region")


@query("SRC-13 UDF-03", f"WITH {SESSIONS_SQL} SELECT s.session_id, s.message_count, m.id, m.role, length(m.content_text)::BIGINT AS chars FROM sessions s LEFT JOIN messages m USING (session_id) WHERE s.session_id IN (3, 12)")
def session_with_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("session_id").isin(3, 12)
    said = messages(spark, sf_dir).where(keep).select("session_id", "id", "role", F.length("content_text").cast("long").alias("chars"))
    return sessions(spark, sf_dir).where(keep).select("session_id", "message_count").join(said, "session_id", "left")


@query("RET-03", f"WITH {SESSIONS_SQL} SELECT session_id FROM sessions WHERE list_contains(string_split_regex(lower(summary), '[^a-z0-9]+'), 'the')")
def session_summary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.text_match(sessions(spark, sf_dir), retrieval.parse_query("the"), "summary", ["session_id"]).select("session_id")


@query("SRC-15", "SELECT doc_id, word, count(*) AS n, sum(chars)::BIGINT AS chars FROM (SELECT doc_id, unnest(w) AS word, unnest(list_transform(w, lambda x: length(x))) AS chars FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE chars > 18 GROUP BY 1, 2")
def parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.arrays_zip(w.alias("word"), F.transform(w, F.length).alias("chars"))))
    return rows.where("chars > 18").groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("SRC-19 SRC-09", "SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length FROM embeddings WHERE vec_id IN (1, 5, 9)")
def vector_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(1, 5, 9)).select("vec_id", "label", F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


@query("FIL-03 FIL-25", f"WITH {SESSIONS_SQL} SELECT session_id, source_name FROM sessions WHERE project_id <> 4 AND contains(source_name, 'ce1') AND summary IS NOT NULL AND started_at >= TIMESTAMP '2024-01-01 05:00:00'")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    automated = F.col("project_id") == 4
    include_automated = False
    kept = sessions(spark, sf_dir).where((F.lit(include_automated) | ~automated) & F.contains("source_name", F.lit("ce1")) & F.col("summary").isNotNull())
    return kept.where("started_at >= timestamp_ntz '2024-01-01 05:00:00'").select("session_id", "source_name")


@query("FIL-24 STR-01 MTH-04 TXT-15", r"SELECT doc_id, length(text)::BIGINT AS chars, greatest(n_chars, 500) AS size FROM documents WHERE regexp_matches(text, '(Licensed|licensed|License|mail)') AND NOT regexp_matches(text, '^\s*$')")
def many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").where(text.like(t, "(Licensed|licensed|License|mail)") & ~text.unrecoverable(t))
    return rows.select("doc_id", F.length(t).cast("long").alias("chars"), F.greatest(F.col("n_chars"), F.lit(500).cast("long")).alias("size"))


@query("STR-16", "SELECT doc_id, replace(text, 'e', '') AS clean FROM documents")
def deep_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as deep_clean_all; it once took short texts only."""
    return _cleaned(table(spark, sf_dir, "documents"))


@query("STR-16", "SELECT doc_id, replace(text, 'e', '') AS clean FROM documents")
def deep_clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULs come out again of texts that had one put before every e, which goes with it."""
    return _cleaned(table(spark, sf_dir, "documents"))


def _cleaned(documents: DataFrame) -> DataFrame:
    dirty = F.replace(F.col("text"), F.lit("e"), F.lit("\x00"))
    return documents.select("doc_id", F.regexp_replace(dirty, r"\x00", "").alias("clean"))


@query("DT-07", "SELECT event_id, CASE WHEN year(ts) BETWEEN 2020 AND 2030 AND event_id % 3 <> 0 THEN ts END AS at FROM events")
def sane_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as sane_times_all; it once took the first users' events only."""
    return _sane(table(spark, sf_dir, "events"))


@query("DT-07", "SELECT event_id, CASE WHEN year(ts) BETWEEN 2020 AND 2030 AND event_id % 3 <> 0 THEN ts END AS at FROM events")
def sane_times_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sane(table(spark, sf_dir, "events"))


def _sane(events: DataFrame) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return events.select("event_id", times.sane_timestamp(raw).cast("timestamp_ntz").alias("at"))


@query("JSN-02", f"WITH {MESSAGES_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(content_text, '') WHEN coalesce(content_text, '') = '' THEN 'done' ELSE content_text || chr(10) || 'done' END AS content, CASE WHEN id % 2 = 1 THEN 'run' END AS tool FROM messages")
def json_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content as plain text or as an array of parts, read by the same expression."""
    part = lambda **v: F.struct(*[v.get(k, F.lit(None).cast("string")).alias(k) for k in ("type", "text", "thinking", "name", "input", "content")])
    parts = F.to_json(F.array(part(type=F.lit("text"), text=F.col("content_text")), part(type=F.lit("tool_use"), name=F.lit("run")), part(type=F.lit("tool_result"), content=F.lit("done"))))
    raw = messages(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.col("content_text")).otherwise(parts).alias("raw"))
    tool = F.get(F.filter(transcripts.parts_of(F.col("raw")), lambda p: p["type"] == "tool_use"), F.lit(0))["name"]
    return raw.select("id", transcripts.content_text(F.col("raw")).alias("content"), tool.alias("tool"))


RAW = "CASE doc_id % 3 WHEN 0 THEN 'D:/work/p' || doc_id % 9 WHEN 1 THEN '/mnt/d/work/p' || doc_id % 9 ELSE '/home/u/p' || doc_id % 9 END"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = (F.col("doc_id") % 9).cast("string"), F.col("doc_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("D:/work/p"), n)).when(kind == 1, F.concat(F.lit("/mnt/d/work/p"), n)).otherwise(F.concat(F.lit("/home/u/p"), n))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("path"))


@query("PTH-03 PTH-04 PTH-05", f"""WITH p AS (SELECT doc_id, {RAW} AS path FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN path ELSE 'other' END AS resolved,
CASE WHEN path LIKE 'D:%' THEN '/mnt/d' || substr(path, 3) WHEN path LIKE '/mnt/d/%' THEN 'D:' || substr(path, 7) ELSE path END AS twin FROM p""")
def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    name = F.when(F.col("doc_id") % 2 == 0, paths.encoded(p)).otherwise(F.lit("other"))
    return _raw(spark, sf_dir).select("doc_id", paths.resolved(name, p, F.lit(False)).alias("resolved"), F.element_at(paths.variants(p), -1).alias("twin"))


@query("PTH-09", f"SELECT doc_id, {RAW} AS path FROM documents WHERE {RAW} IN ('/home/u/p5/deep', '/home/u/p5', '/home/u', '/home', '/') OR starts_with({RAW}, '/home/u/p5/deep/')")
def path_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).where(paths.related(F.col("path"), "/home/u/p5/deep"))


@query("PTH-10 SRT-10", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id % 9 END AS parent, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS depth FROM documents")
def path_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("/r/s"), (F.col("doc_id") % 9).cast("string"))
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(s, F.lit("/subagents/a.jsonl"))).otherwise(F.concat(s, F.lit("/a.jsonl")))
    return table(spark, sf_dir, "documents").select("doc_id", paths.parent_id(path).alias("parent"), paths.nesting(path).alias("depth"))
