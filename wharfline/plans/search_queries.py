"""The search itself in its modes, full-text searches, and steps of reading; in SQL too."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline import render
from wharfline.api import Library
from wharfline.data import MESSAGES_SQL, SESSIONS_SQL, messages, sessions, table
from wharfline.functions import english, paths, text
from wharfline.functions.register import register
from wharfline.operators import centroids, reading, retrieval
from wharfline.plans import english_sql
from wharfline.plans.registry import query
from wharfline.plans.retrieval_queries import PACKED_SQL
from wharfline.storage import written

@query("RET-03", f"WITH {english_sql.lexemes('documents', 'doc_id', 'text')} SELECT doc_id, array_to_string(terms, ' ') AS terms, list_sum(places)::BIGINT AS places FROM lexed")
def english_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as English search sees it: stop words out, stems, and the sum of their places."""
    found = table(spark, sf_dir, "documents").select("doc_id", english.lexemes("text").alias("t"))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["place"])
    return found.select("doc_id", F.array_join("t.term", " ").alias("terms"), F.when(F.size("t") > 0, total).alias("places"))


def _ranked_sql(rows: str, key: str, column: str, terms: list[str], match: str, limit: int, keep: str) -> str:
    """Common table expressions up to `ranked` (keep.., score, rank) by BM25 of terms over rows, which has a column of that name."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS f{k}" for k, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{k} > 0)::DOUBLE AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / avg_len))" for k in range(len(terms)))
    hit = " OR ".join(f"f{k} > 0" for k in range(len(terms)))
    return f"""{english_sql.lexemes(rows, key, column)}, cut AS (SELECT {keep}, terms AS t, places FROM {rows} JOIN lexed USING ({key})), counted AS (SELECT *, len(t)::DOUBLE AS len, {tf} FROM cut), stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len, {df} FROM counted),
scored AS (SELECT {keep}, round({score}, 9) AS score FROM counted, stats WHERE ({hit}) AND {match}), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM scored ORDER BY score DESC, {key} LIMIT {limit})"""


@query("RET-16 UDF-02 SRC-13 JOIN-12", f"WITH {SESSIONS_SQL}, m AS (SELECT id, session_id, project_id, source_name, content_text FROM messages JOIN sessions USING (session_id) WHERE source_name = 'source1'), {_ranked_sql('m', 'id', 'content_text', ['tion', 'onan'], "(list_contains(t, 'tion') OR list_contains(t, 'onan')) AND NOT list_contains(t, 'wh')", 20, 'id, session_id, project_id, source_name')} SELECT * FROM ranked")
def search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_messages(messages(spark, sf_dir), sessions(spark, sf_dir), "tion or onan -wh", 20, "source1")


@query("RET-17 UDF-04 SRC-13", f"WITH {SESSIONS_SQL}, m AS (SELECT * FROM sessions WHERE summary IS NOT NULL), {_ranked_sql('m', 'session_id', 'summary', ['tion', 'onan'], "list_contains(t, 'tion') OR list_contains(t, 'onan')", 10, 'session_id, project_id, source_name')} SELECT * FROM ranked")
def search_session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_session_summaries(sessions(spark, sf_dir), "tion or onan", 10)


# --- search(params)

CLASSES = ("coding", "personal", "work")


def _corpus(spark: SparkSession, sf_dir: str, chunks: bool = False) -> retrieval.Corpus:
    """Sessions with classes dealt by project, some automated and some deleted; vectors stand for sessions, ten to a session for messages and, if asked for, five to a session for chunks."""
    rows = table(spark, sf_dir, "embeddings")
    s = sessions(spark, sf_dir)
    named = F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col("project_id") % 3).cast("int"))
    s = s.select(
        "session_id", "project_id", "source_name", named.alias("data_class"), F.concat(F.lit("/w/p"), F.col("project_id").cast("string")).alias("project_path"), "title", "summary", "started_at",
        (F.col("session_id") % 7 == 3).alias("is_automated"), F.when(F.col("session_id") % 13 == 5, F.col("started_at")).alias("deleted_at"),
    )
    tier = lambda session: rows.select(F.col("vec_id").alias("id"), session.alias("session_id"), "embedding", F.lit(None).cast("string").alias("raw"))
    made = centroids.centroids(rows, "label", "embedding").select(F.col("label").alias("session_id"), "centroid")
    arms = {"session": tier(F.col("vec_id")), **({"chunk": tier(F.floor(F.col("vec_id") / 5))} if chunks else {}), "message": tier(F.floor(F.col("vec_id") / 10))}
    return retrieval.Corpus(s, messages(spark, sf_dir), arms, made, made.withColumnRenamed("session_id", "project_id"))


COSINE_OF = "list_cosine_similarity(embedding::DOUBLE[], {0})"
VECTOR_0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _search_sql(where: str, limit: int, wide: int, vector: str | None, terms: list[str] | None, match: str = "TRUE", boost: str = "FALSE", before: str = "", tiers: tuple = ((0, "vec_id", 2), (2, "vec_id // 10", 3))) -> str:
    arms = []
    ctes = [f"""{SESSIONS_SQL}, ok AS (SELECT *, coalesce({boost}, FALSE) AS here FROM (SELECT *, ['coding', 'personal', 'work'][project_id % 3 + 1] AS data_class, '/w/p' || project_id AS project_path FROM sessions WHERE session_id % 13 <> 5) WHERE summary IS NOT NULL AND {where})"""]
    if before:
        ctes.append(before)
    if vector:
        for n, key, factor in tiers:
            cos = COSINE_OF.format(vector)
            ctes.append(f"near{n} AS (SELECT vec_id AS id, ({key})::BIGINT AS session_id, row_number() OVER (ORDER BY {cos} DESC, vec_id) AS r FROM embeddings QUALIFY r <= {limit * factor * wide})")
            ctes.append(f"arm{n} AS (SELECT session_id, id AS message_id, row_number() OVER (ORDER BY r) AS rank, {n} AS arm_priority FROM (SELECT * FROM near{n} WHERE session_id IN (SELECT session_id FROM ok) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY r) = 1))")
            arms.append(f"SELECT * FROM arm{n}")
    if terms:
        ctes.append(_ranked_sql("messages", "id", "content_text", terms, match, 10**9, "id, session_id"))
        ctes.append(f"best AS (SELECT * FROM scored WHERE session_id IN (SELECT session_id FROM ok) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) = 1), arm3 AS (SELECT session_id, id AS message_id, row_number() OVER (ORDER BY score DESC, id) AS rank, 3 AS arm_priority FROM best ORDER BY score DESC, id LIMIT {limit * 2})")
        arms.append("SELECT * FROM arm3")
    ctes.append(f"arms AS ({' UNION ALL '.join(arms)}), fused AS (SELECT session_id, sum(1.0 / (60 + rank)) AS fused, bool_or(arm_priority = 3) AS said FROM arms GROUP BY 1), claimed AS (SELECT * FROM arms QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY arm_priority, rank) = 1)")
    return f"""WITH {', '.join(ctes)} SELECT session_id, project_id, data_class, round(fused + CASE WHEN here THEN 0.5 ELSE 0 END, 6) AS score, ['session', 'chunk', 'message', 'message'][arm_priority + 1] AS matched_tier, message_id, said AS has_headline
FROM claimed JOIN fused USING (session_id) JOIN ok USING (session_id) ORDER BY fused + CASE WHEN here THEN 0.5 ELSE 0 END DESC, arm_priority, rank, session_id LIMIT {limit}"""


def _found(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    hits = retrieval.search(_corpus(spark, sf_dir), retrieval.SearchParams(**params))
    return hits.select("session_id", "project_id", "data_class", F.round("score", 6).alias("score"), "matched_tier", "message_id", F.col("snippet").isNotNull().alias("has_headline"))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return retrieval.vector_of(table(spark, sf_dir, "embeddings"), 0, "vec_id")


SAID = "(list_contains(t, 'tion') OR list_contains(t, 'onan'))"


@query("RET-13 RET-11 RET-12 WIN-04 WIN-05 SRT-06 SRT-07 FIL-01 FIL-03 FIL-04 FIL-05 FIL-07 PTH-09 JOIN-13", _search_sql("session_id % 7 <> 3 AND data_class IN ('coding', 'work')", 8, 5, VECTOR_0, ["tion", "onan"], SAID, "project_path IN ('/w/p2', '/w', '/')"))
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms, two classes, the caller's project first."""
    return _found(spark, sf_dir, query="tion or onan", vector=_vector(spark, sf_dir), classes=[" Coding ", "work"], cwd="/w/p2")


def search_text_sql() -> str:
    return _search_sql("session_id % 7 <> 3 AND source_name = 'source1'", 5, 1, None, ["tion", "onan"], f"{SAID} AND NOT list_contains(t, 'wh')")


@query("RET-13 RET-09 RET-04 WIN-03", search_text_sql())
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text arm alone, in one source, which switches the classes off, without texts that hold a word."""
    return _found(spark, sf_dir, query="tion or onan", mode="text", limit=5, source="source1", exclude_terms="wh")


TIERS = ((0, "vec_id", 2), (1, "vec_id // 5", 3), (2, "vec_id // 10", 3))


@query("RET-13 SRT-07 RET-11 WIN-05", _search_sql("session_id % 7 <> 3", 12, 1, VECTOR_0, ["tion", "onan"], SAID, tiers=TIERS))
def search_all_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, chunks, messages and text: a session that only a chunk of it speaks for is found as such."""
    hits = retrieval.search(_corpus(spark, sf_dir, chunks=True), retrieval.SearchParams(query="tion or onan", vector=_vector(spark, sf_dir), classes=["*"], limit=12))
    return hits.select("session_id", "project_id", "data_class", F.round("score", 6).alias("score"), "matched_tier", "message_id", F.col("snippet").isNotNull().alias("has_headline"))


CENTROID = """flat AS (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS place FROM embeddings), means AS (SELECT label, place, avg(x::DOUBLE) AS m FROM flat GROUP BY ALL), cent AS (SELECT label, list(m ORDER BY place) AS v, sqrt(sum(m * m)) AS len FROM means GROUP BY label),
q AS (SELECT list_transform(range(1, 65), lambda i: 0.5 * a.v[i] / a.len - 0.2 * b.v[i] / b.len) AS v FROM cent a, cent b WHERE a.label = 1 AND b.label = 2)"""


@query("RET-13 VEC-05 VEC-06 VEC-07 FIL-02 DT-01 SRT-07", _search_sql("started_at >= TIMESTAMP '2024-01-01 03:00:00'", 6, 1, "(SELECT v FROM q)", None, before=CENTROID))
def search_semantic_steered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text at all: towards one session's centroid, away from another project's; every class, automated sessions too, from a time on."""
    return _found(spark, sf_dir, mode="semantic", limit=6, like_session=["1:0.5", "x"], unlike_project=["2"], classes=["*"], include_automated=True, since=datetime(2024, 1, 1, 3))


@query("FIL-05 FIL-06 SET-01", "SELECT DISTINCT lang AS data_class FROM documents WHERE lang IN ('en', 'de')")
def classes_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a request, trimmed and lower-cased, checked against the vocabulary and kept."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("data_class"))
    known = retrieval.class_vocabulary(docs, docs)
    wanted = retrieval.resolve_classes([" EN", "de "])
    retrieval.check_classes(wanted, [r[0] for r in known.collect()])
    return known.where(F.col("data_class").isin(*wanted))


@query("FIL-07 FIL-03 FIL-25", f"WITH {SESSIONS_SQL} SELECT session_id, project_id % 2 = 0 AND project_id = 4 AS in_project FROM sessions WHERE session_id % 13 <> 5 AND source_name = 'source1' AND summary IS NOT NULL AND started_at >= TIMESTAMP '2024-01-01 02:00:00'")
def eligible_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = retrieval.SearchParams(source="source1", since=datetime(2024, 1, 1, 2), include_automated=True, cwd="/w/p4/src")
    return retrieval.eligible(_corpus(spark, sf_dir), params).select("session_id", "in_project")


@query("FIL-11 SRT-05 ARR-01 PTH-09", "SELECT DISTINCT 'p' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN '%' ELSE '_' END AS name, 2 + length('p0_') AS length FROM documents WHERE (doc_id % 9 = 3 AND doc_id % 2 = 0) OR doc_id % 9 = 5")
def paths_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold LIKE's own characters, matched literally against any of several patterns; most specific paths first."""
    n = F.concat(F.lit("p"), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 2 == 0, "%").otherwise("_"))
    wanted = [f"{text.escape_like(p)}%" for p in ("p3%", "p5")]
    rows = table(spark, sf_dir, "documents").select(n.alias("name")).distinct()
    hit = F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: F.like(F.col("name"), w))
    return paths.most_specific(rows.where(hit).select("name", F.concat(F.lit("/w"), F.col("name")).alias("path")), "path").select("name", F.length("path").alias("length"))


# --- reading

DIGEST_SQL = f"""{SESSIONS_SQL}, chunks AS (SELECT session_id, sequence_num // 3 AS chunk_index, min(id) AS a, max(id) AS b, sum(length(content_text))::BIGINT AS content_chars FROM messages GROUP BY 1, 2)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("session_id", F.floor(F.col("sequence_num") / 3).alias("chunk_index")).agg(
        F.min("id").alias("start_message_id"), F.max("id").alias("end_message_id"), F.sum(F.length("content_text")).alias("content_chars"), F.min_by("content_text", "sequence_num").alias("text")
    )


@query("RET-18 SRT-02", f"WITH {DIGEST_SQL} SELECT session_id, chunk_index, a AS start_message_id, b AS end_message_id, content_chars, total AS total_chunks, CASE WHEN total > 3 THEN 3 END AS next_offset FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS total FROM chunks) WHERE chunk_index BETWEEN 1 AND 2")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.manifest(_chunks(spark, sf_dir), 1, 2)


@query("RET-18 JOIN-11", f"""WITH {DIGEST_SQL}, f AS (SELECT session_id, arg_min(content_text, sequence_num) AS m FROM messages GROUP BY 1), n AS (SELECT session_id, count(*) AS n FROM chunks WHERE session_id % 2 = 0 GROUP BY 1), x AS (SELECT session_id, message_count, coalesce(n, 0) AS chunk_count, trim(regexp_replace(CASE WHEN session_id % 3 = 0 THEN coalesce(summary, m) ELSE m END, '\\s+', ' ', 'g')) AS t FROM sessions JOIN f USING (session_id) LEFT JOIN n USING (session_id))
SELECT session_id, message_count, chunk_count, CASE WHEN t = '' THEN NULL WHEN length(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 299)) || '…' END AS excerpt FROM x""")
def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts from the summary, else the first chunk, else the first message: a third of the sessions has a summary, the even ones have chunks."""
    s = sessions(spark, sf_dir).withColumn("summary", F.when(F.col("session_id") % 3 == 0, F.col("summary")))
    return reading.digest(s, messages(spark, sf_dir), _chunks(spark, sf_dir).where("session_id % 2 = 0"))


@query("RET-20 WIN-07 TXT-07", f"""WITH {MESSAGES_SQL}, i AS (SELECT * FROM messages WHERE id BETWEEN 2001 AND 9002), r AS (SELECT *, row_number() OVER w AS n, sum(length(content_text)) OVER w AS upto FROM i WINDOW w AS (PARTITION BY session_id ORDER BY sequence_num, id ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, upto <= 900 OR (n = 1 AND length(content_text) > 900) AS fits FROM r)
SELECT session_id, id, sequence_num, role, CASE WHEN n = 1 AND length(content_text) > 900 THEN substr(content_text, 1, 900) ELSE content_text END AS content_text, n = 1 AND length(content_text) > 900 AS truncated, next_id FROM f LEFT JOIN (SELECT session_id, min(id) AS next_id FROM f WHERE NOT fits GROUP BY 1) USING (session_id) WHERE fits""")
def messages_range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.range_page(messages(spark, sf_dir), 2001, 9002, 900)


@query("RET-20", f"""WITH {MESSAGES_SQL}, r AS (SELECT session_id, row_number() OVER w AS n, length(content_text) AS size, sum(length(content_text)) OVER w AS upto FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY sequence_num, id ROWS UNBOUNDED PRECEDING)), c AS (SELECT session_id, count(*) AS fetched, count(*) FILTER (upto <= 2500 OR (n = 1 AND size > 2500)) AS shown, bool_or(n = 1 AND size > 2500) AS cut FROM r GROUP BY 1)
SELECT session_id, fetched, shown, shown < fetched OR cut AS exhausted, CASE WHEN shown < fetched OR cut THEN shown END AS next_offset FROM c""")
def messages_page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.page_summary(messages(spark, sf_dir), 2500)


@query("RET-19", f"WITH {SESSIONS_SQL} SELECT session_id, started_at FROM sessions WHERE session_id = 7 OR 's' || session_id = '7' OR title ILIKE '%7%' ORDER BY started_at DESC, session_id LIMIT 1")
def session_by_any_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number, by outside id, or by a part of the title."""
    return _library(spark, sf_dir).session("7").select("session_id", "started_at")


@query("RET-19", f"WITH {SESSIONS_SQL} SELECT session_id, started_at FROM sessions WHERE 's' || session_id = 's9'")
def session_by_outside_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).session("s9").select("session_id", "started_at")


def _library(spark: SparkSession, sf_dir: str) -> Library:
    corpus = _corpus(spark, sf_dir)
    corpus.sessions = corpus.sessions.withColumn("external_id", F.concat(F.lit("s"), F.col("session_id").cast("string"))).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return Library(corpus, _chunks(spark, sf_dir))


@query("RET-21", f"WITH {DIGEST_SQL} SELECT 'message' AS what, id, content_text AS text FROM messages WHERE id = 3002 UNION ALL SELECT 'chunk', a, arg_min(content_text, sequence_num) FROM chunks c JOIN messages m ON m.session_id = c.session_id AND m.id BETWEEN a AND b WHERE c.session_id = 4 AND chunk_index = 1 GROUP BY a")
def one_message_one_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _library(spark, sf_dir)
    one = library.message(3002).select(F.lit("message").alias("what"), "id", F.col("content_text").alias("text"))
    return one.unionByName(library.chunk(4, 1).select(F.lit("chunk").alias("what"), F.col("start_message_id").alias("id"), "text"))


@query("RET-22 PTH-09 FIL-08", f"WITH {SESSIONS_SQL} SELECT session_id, project_id, started_at FROM sessions WHERE project_id = 2 ORDER BY started_at DESC NULLS LAST, session_id LIMIT 10")
def context_of_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sessions of the projects that hold the caller's directory."""
    return _library(spark, sf_dir).context("/w/p2/src").select("session_id", "project_id", "started_at")


@query("RET-15 TXT-18 PRJ-03", f"""WITH {SESSIONS_SQL} SELECT session_id, '#' || session_id || ' ' || coalesce(title, '(untitled)') || CASE WHEN project_id = 2 THEN ' [CURRENT PROJECT]' ELSE '' END || ' | ' || source_name || ' | ' || strftime(started_at, '%Y-%m-%d') || ' | ' || message_count || ' messages' AS line FROM sessions""")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wharfline.render import line

    rows = sessions(spark, sf_dir)
    return rows.select("session_id", line(F.col("session_id"), F.col("title"), F.col("project_id") == 2, F.col("source_name"), F.col("started_at"), F.col("message_count")).alias("line"))


SHOWN_SQL = f"""{PACKED_SQL.replace('WITH RECURSIVE ' + MESSAGES_SQL, 'WITH RECURSIVE ' + SESSIONS_SQL)}, c AS (SELECT session_id, string_agg('- [' || chunk_index || '] messages ' || start_message_id || '-' || end_message_id || ', ' || content_chars || ' chars: '
  || trim(regexp_replace(left(text, 60), '\\s+', ' ', 'g')), chr(10) ORDER BY chunk_index) FILTER (chunk_index < 2) AS lines, count(*) AS total FROM packed GROUP BY 1)"""


@query("TXT-18 RET-18 RET-15", f"""{SHOWN_SQL} SELECT session_id, '# ' || coalesce(title, 'Session ' || session_id || ' (no title yet)') || chr(10) || 'session ' || session_id || ' | project ' || project_id || ' | ' || strftime(started_at, '%Y-%m-%d') || ' | ' || message_count || ' messages' || chr(10) || chr(10)
|| CASE WHEN summary <> '' THEN '## Summary' || chr(10) || summary ELSE '## Summary' || chr(10) || 'none' END || chr(10) || chr(10)
|| CASE WHEN total IS NULL THEN 'no chunks: read the whole session' ELSE CASE WHEN total > 2 THEN '## Chunks 0-1 of ' || total ELSE '## Chunks' END || chr(10) || lines || CASE WHEN total > 2 THEN chr(10) || 'more chunks from 2' ELSE '' END END AS shown FROM sessions LEFT JOIN c USING (session_id)""")
def digests_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session as a page of text, with the first two of its chunks."""
    packed = reading.chunk_sessions(messages(spark, sf_dir), most=1000, least=500)
    entry = F.struct("chunk_index", "start_message_id", "end_message_id", "content_chars", F.substring("text", 1, 60).alias("summary"))
    of = packed.groupBy("session_id").agg(F.sort_array(F.collect_list(F.when(F.col("chunk_index") < 2, entry))).alias("chunks"), F.count("*").alias("total"))
    rows = sessions(spark, sf_dir).join(of, "session_id", "left")
    shown = render.digest(F.col("session_id"), F.col("title"), F.col("project_id"), F.col("started_at"), F.col("message_count"), F.col("summary"), F.lit(None).cast("string"), F.col("chunks"), 0, F.coalesce("total", F.lit(0)))
    return rows.select("session_id", shown.alias("shown"))


# --- summaries


@query("TXT-10 TXT-11", """WITH t AS (SELECT doc_id, text, length(text) AS n, CASE doc_id % 4 WHEN 0 THEN '<think>x</think><done>' || substr(text, 1, 200) WHEN 1 THEN substr(text, 1, 60) WHEN 2 THEN text ELSE substr(text, 1, 150) END AS s FROM documents), u AS (SELECT *, regexp_replace(CASE WHEN doc_id % 4 = 0 THEN replace(s, '<think>x</think>', '') ELSE s END, '^\\s+|\\s+$', '', 'g') AS said FROM t)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'truncated' WHEN doc_id % 4 = 0 THEN 'control marker' WHEN length(said) < 100 THEN 'too short' WHEN length(said) >= n THEN 'not shrunk' END AS refused FROM u""")
def summaries_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("doc_id") % 4, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("<think>x</think><done>"), F.substring(t, 1, 200))).when(k == 1, F.substring(t, 1, 60)).when(k == 2, t).otherwise(F.substring(t, 1, 150))
    tokens = F.when(F.col("doc_id") % 5 == 0, 16_384).otherwise(100)
    return table(spark, sf_dir, "documents").select("doc_id", reading.refused(t, said, tokens).alias("refused"))


@query("TXT-09 TXT-08", f"""WITH {MESSAGES_SQL}, p AS (SELECT session_id, sequence_num, id, '[' || upper(role) || ']: ' || content_text AS text FROM messages WHERE length(content_text) > 0), j AS (SELECT session_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY sequence_num, id) AS text FROM p GROUP BY 1)
SELECT session_id, CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, 1, 300) END AS summary, 0 AS level FROM j""")
def summaries_in_one_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sessions are their own summary, others take one call; the stand-in for the model keeps the first 300 characters."""
    return reading.summary_tree(messages(spark, sf_dir), lambda t: F.substring(t, 1, 300), 10**9, 1500)


REFUSED = 300


@query("TXT-17", f"""WITH RECURSIVE p AS (SELECT doc_id, '' AS part, text AS t, 1 AS attempt FROM documents UNION ALL
  SELECT doc_id, CASE WHEN attempt = 1 THEN part ELSE part || side END, CASE WHEN attempt = 1 THEN regexp_replace(t, '[.,]? +', ' ', 'g') WHEN side = '0' THEN left(t, length(t) // 2) ELSE substr(t, length(t) // 2 + 1) END, attempt + 1
  FROM p, (VALUES ('0'), ('1')) x(side) WHERE length(t) > {REFUSED} AND (attempt > 1 OR side = '0')),
n AS (SELECT doc_id, max(attempt) AS attempts FROM p GROUP BY 1) SELECT doc_id, string_agg(left(t, 20), ' ' ORDER BY part) AS summary, any_value(attempts)::INTEGER AS attempts, CASE WHEN any_value(attempts) > 1 THEN 'too long' ELSE '' END AS reasons
FROM p JOIN n USING (doc_id) WHERE length(t) <= {REFUSED} GROUP BY doc_id""")
def summaries_after_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for the model keeps the first 20 characters and refuses long texts: they come again with less punctuation, then in halves, until none is refused."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    refused = lambda t, said: F.when(F.length(t) > REFUSED, "too long")
    done = reading.summarise_with_attempts(texts, lambda t: F.substring(t, 1, 20), refused, lambda t: F.regexp_replace(t, "[.,]? +", " "))
    return done.select(F.col("id").alias("doc_id"), "summary", "attempts", F.array_join("reasons", ",").alias("reasons"))


@query("TXT-09 TXT-05")
def summaries_in_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sessions go through several levels; tests hold it against a plain version."""
    return reading.summary_tree(messages(spark, sf_dir), lambda t: F.substring(t, 1, 200), 1200, 400)


@query("STR-16 JSN-01", """SELECT doc_id, '{"a":"' || (doc_id % 5) || 'x","b":["y"]}' AS clean FROM documents""")
def json_deep_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULs go from the strings of JSON, keys among them; where two keys become one, the clean one stays."""
    n = (F.col("doc_id") % 5).cast("string")
    raw = F.concat(F.lit('{"a\\u0000":"dirty","a":"'), n, F.lit('\\u0000x","b":["\\u0000y"]}'))
    return table(spark, sf_dir, "documents").select("doc_id", text.deep_clean_json(raw).alias("clean"))


@query("AGG-20", f"WITH {MESSAGES_SQL} SELECT session_id, count(*) AS n, sum(id)::BIGINT AS ids, min(role) AS role FROM messages GROUP BY 1")
def messages_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's messages as one JSON array, and read out of it again."""
    packed = reading.as_json(messages(spark, sf_dir), "session_id", ["id", "role"], "sequence_num")
    back = packed.select("session_id", F.explode(F.from_json("json", "array<struct<id:bigint,role:string>>")).alias("m"))
    return back.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("m.id").alias("ids"), F.min("m.role").alias("role"))


@query("PTH-11", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/Users/u' || doc_id || '/my/app' ELSE 'plain-' || doc_id END AS decoded FROM documents")
def directory_names_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-Users-u"), d, F.lit("-my-app"))).otherwise(F.concat(F.lit("plain-"), d))
    return table(spark, sf_dir, "documents").select("doc_id", paths.decoded(name).alias("decoded"))


@query("WIN-04 WIN-01", "SELECT doc_id % 50 AS session_id, doc_id AS id, rank FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id) = 1))")
def best_of_each_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a session of a ranked arm, ranks closed up."""
    place = F.struct((-F.col("n_chars")).alias("n"), "doc_id")  # orders as a rank would, without numbering all documents
    arm = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("session_id"), F.col("doc_id").alias("id"), place.alias("rank"))
    return retrieval.once_per(arm)


@query("UDF-07 TXT-05", f"""{PACKED_SQL}, {english_sql.lexemes("packed_rows", "k", "text").replace("words AS", "packed_rows AS (SELECT *, session_id * 100000 + chunk_index AS k FROM packed), words AS", 1)}
SELECT session_id, chunk_index, start_message_id, end_message_id, content_chars, n_pieces, len(terms)::INTEGER AS n_terms FROM packed_rows JOIN lexed USING (k)""")
def functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions in a statement: messages packed by a table function, and each chunk's English terms counted."""
    register(spark)
    said = messages(spark, sf_dir).where(F.length("content_text") > 0).select("session_id", "sequence_num", "id", F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content_text")).alias("text"))
    long = said.groupBy("session_id").agg(F.sum(F.length("text") + reading.PIECE_OVERHEAD).alias("n")).where("n > 500").select("session_id")
    said.join(long, "session_id", "left_semi").createOrReplaceTempView("said_for_chunks")
    return spark.sql("""SELECT session_id, chunk_index, start_message_id, end_message_id, content_chars, n_pieces, size(english_terms(text)) AS n_terms
FROM chunk_messages(TABLE(said_for_chunks) PARTITION BY session_id ORDER BY (sequence_num, id), 1000)""")
