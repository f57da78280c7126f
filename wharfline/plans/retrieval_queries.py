"""Queries of search and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, SESSIONS_SQL, messages, sessions, table
from wharfline.functions import text, vectors
from wharfline.operators import centroids, reading, retrieval
from wharfline.plans.registry import query
from wharfline.storage import written

WORDS = ("the", "and", "with")
TOKENS_SQL = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
DOC_TERMS_SQL = f"SELECT doc_id, {TOKENS_SQL.format('text')} AS terms FROM documents"
COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0}))"
SQUASH = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _vector(spark: SparkSession, sf_dir: str, key: int) -> list[float]:
    return retrieval.vector_of(table(spark, sf_dir, "embeddings"), key, "vec_id")


@query("RET-01 VEC-04 SRT-03 JOIN-18 SRC-09", f"SELECT vec_id, round({COSINE.format(0)}, 6) AS score, row_number() OVER (ORDER BY {COSINE.format(0)} DESC, vec_id) AS rank FROM embeddings ORDER BY {COSINE.format(0)} DESC, vec_id LIMIT 10")
def knn_cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 10, "vec_id")
    return near.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("SRC-11 RET-01", f"SELECT vec_id, round({COSINE.format(1)}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {COSINE.format(1)} DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 1), 10, "vec_id", where=F.col("label") == 3)
    return near.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "VEC-01 VEC-02 VEC-03 VEC-05 ANA-28",
    """WITH q AS (SELECT list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS v FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS with_negative, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS plain FROM embeddings, q)
SELECT vec_id, round(with_negative, 6) AS score, row_number() OVER (ORDER BY with_negative DESC, vec_id) AS rank, rank_plain FROM (SELECT *, row_number() OVER (ORDER BY plain DESC, vec_id) AS rank_plain FROM s) ORDER BY with_negative DESC, vec_id LIMIT 20""",
)
def knn_negative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a, b = _vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1)
    scored = vectors.cosine_scores(rows, [vectors.compose(a, b), a], "vec_id", "embedding").groupBy("vec_id").agg(F.max(F.when(F.col("query") == 0, F.col("score"))).alias("s"), F.max(F.when(F.col("query") == 1, F.col("score"))).alias("plain"))
    scores = written(scored, "scores")
    top = retrieval.ranked(scores, [F.desc("s"), F.col("vec_id")], ["vec_id", "s", "plain"], 20)
    # the plain rank of those twenty alone: how many score higher, by one aggregation over all with a count for each of them
    shown = top.collect()
    above = scores.agg(*[F.count_if((F.col("plain") > r["plain"]) | ((F.col("plain") == r["plain"]) & (F.col("vec_id") <= r["vec_id"]))).alias(str(r["rank"])) for r in shown]).first()
    return spark.createDataFrame([(r["vec_id"], round(r["s"], 6), r["rank"], above[str(r["rank"])]) for r in shown], "vec_id long, score double, rank long, rank_plain long")


CENTROIDS_SQL = """flat AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings),
means AS (SELECT label, place, avg(x::DOUBLE) AS m FROM flat GROUP BY ALL), c AS (SELECT label, list(m ORDER BY place) AS v, sqrt(sum(m * m)) AS len FROM means GROUP BY label)"""


@query("AGG-15 VEC-03", f"WITH {CENTROIDS_SQL} SELECT c.label::INTEGER AS label, n, round(v[1] / len, 6) AS first, round(v[64] / len, 6) AS last FROM c JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = centroids.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"))


@query(
    "VEC-05 VEC-06 VEC-07 RET-01",
    f"""WITH {CENTROIDS_SQL}, q AS (SELECT list_transform(range(1, 65), lambda i: 0.5 * a.v[i] / a.len - 0.2 * b.v[i] / b.len) AS v FROM c a, c b WHERE a.label = 1 AND b.label = 2)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 10""",
)
def centroid_steered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    made = centroids.centroids(rows, "label", "embedding")
    like, unlike = retrieval.resolve_centroids(made, ["1:0.5", "none"], "label"), retrieval.resolve_centroids(made, ["2"], "label")
    near = retrieval.knn(rows, vectors.compose(like=like, unlike=unlike, dimension=64), 10, "vec_id")
    return near.select("vec_id", F.round("score", 6).alias("score"))


@query("ARR-02 ARR-03 ANA-29", "SELECT count(*) AS n, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS zero, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS broken FROM embeddings")
def zero_nan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.agg(F.count("*").alias("n"), F.count_if(vectors.is_zero(F.col("embedding"))).alias("zero"), F.count_if(vectors.is_broken(F.col("embedding"))).alias("broken"))


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, overlap): how many of WORDS a document holds, weighted by how often."""
    terms = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(terms, lambda t: t.isin(*WORDS))).cast("long").alias("overlap")).where("overlap > 0")


OVERLAP_SQL = f"overlap AS (SELECT doc_id, len(list_filter(terms, lambda t: t IN {WORDS}))::BIGINT AS overlap FROM ({DOC_TERMS_SQL}) WHERE overlap > 0)"
ARMS_SQL = f"""{OVERLAP_SQL}, arms AS (SELECT vec_id AS session_id, row_number() OVER (ORDER BY {COSINE.format(0)} DESC, vec_id) AS rank, 0 AS arm_priority FROM embeddings QUALIFY rank <= 40
UNION ALL SELECT doc_id, row_number() OVER (ORDER BY overlap DESC, doc_id) AS rank, 3 FROM overlap QUALIFY rank <= 40)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 40, "vec_id").select(F.col("vec_id").alias("session_id"), "rank", F.lit(0).alias("arm_priority"))
    said = retrieval.ranked(_overlap(spark, sf_dir), [F.desc("overlap"), F.col("doc_id")], ["doc_id"], 40).select(F.col("doc_id").alias("session_id"), "rank", F.lit(3).alias("arm_priority"))
    return near.unionByName(said)


@query("RET-10 AGG-23", f"WITH {ARMS_SQL} SELECT session_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM arms GROUP BY session_id")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_arms(spark, sf_dir)).select("session_id", F.round("score", 6).alias("score"))


@query(
    "RET-11 WIN-05 SRT-06 JOIN-13 JOIN-01",
    f"""WITH {ARMS_SQL}, fused AS (SELECT session_id, sum(1.0 / (60 + rank)) AS fused FROM arms GROUP BY 1), claimed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arm_priority, rank) AS n FROM arms)
SELECT session_id, lang, round(fused + CASE WHEN source = 'src1' THEN 0.5 ELSE 0 END, 6) AS score, CASE arm_priority WHEN 0 THEN 'session' ELSE 'message' END AS matched_tier FROM claimed JOIN fused USING (session_id) JOIN documents ON doc_id = session_id
WHERE n = 1 ORDER BY fused + CASE WHEN source = 'src1' THEN 0.5 ELSE 0 END DESC, arm_priority, rank, session_id LIMIT 10""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a vector arm and a text arm, fused by rank, the caller's source first."""
    arms = written(_arms(spark, sf_dir).withColumn("headline", F.lit(None).cast("string")), "arms")  # two steps read its few rows
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), "lang", "source")
    hits = retrieval.first_claim(arms).join(retrieval.fuse(arms), "session_id").join(docs, "session_id")
    score = F.col("score") + F.when(F.col("source") == "src1", retrieval.PROJECT_BOOST).otherwise(0.0)
    tier = F.when(F.col("arm_priority") == 0, "session").otherwise("message")
    top = hits.select("session_id", "lang", score.alias("score"), tier.alias("matched_tier"), "arm_priority", "rank").orderBy(F.desc("score"), "arm_priority", "rank", "session_id").limit(10)
    return top.select("session_id", "lang", F.round("score", 6).alias("score"), "matched_tier")


@query("RET-03 STR-02", f"SELECT doc_id, len(terms)::BIGINT AS n_terms FROM ({DOC_TERMS_SQL}) WHERE list_contains(terms, 'the') AND (list_contains(terms, 'this') OR list_contains(terms, 'from')) AND NOT list_contains(terms, 'are') AND contains(' ' || array_to_string(terms, ' ') || ' ', ' of the ')")
def fts_websearch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = retrieval.parse_query('the this or from -are "of the"')
    return retrieval.text_match(table(spark, sf_dir, "documents"), q, "text", ["doc_id"]).select("doc_id", F.size("terms").cast("long").alias("n_terms"))


BM25_SQL = f"""t AS ({DOC_TERMS_SQL}), counted AS (SELECT doc_id, len(terms)::DOUBLE AS len, len(list_filter(terms, lambda x: x = 'this'))::DOUBLE AS a, len(list_filter(terms, lambda x: x = 'with'))::DOUBLE AS b FROM t),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len, count(*) FILTER (a > 0)::DOUBLE AS da, count(*) FILTER (b > 0)::DOUBLE AS db FROM counted),
scored AS (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg_len)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg_len)) AS score FROM counted, stats WHERE a > 0 OR b > 0)"""


@query("RET-04 JOIN-12", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def fts_rank_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(table(spark, sf_dir, "documents"), ["this", "with"], "text", ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


BEST_SQL = f"WITH {MESSAGES_SQL}, t AS (SELECT id, session_id, len(list_filter({TOKENS_SQL.format('content_text')}, lambda x: x IN ('the', 'you')))::BIGINT AS hits FROM messages)"


@query("RET-08 WIN-03", f"{BEST_SQL} SELECT session_id, id AS message_id, hits FROM t WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, id) = 1 ORDER BY hits DESC, id LIMIT 16")
def fts_best_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.size(F.filter(text.tokens(F.col("content_text")), lambda t: t.isin("the", "you"))).cast("long")
    rows = messages(spark, sf_dir).select("session_id", F.col("id").alias("message_id"), hits.alias("hits")).where("hits > 0")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("hits"), "message_id"))).where("n = 1").drop("n")
    return best.orderBy(F.desc("hits"), "message_id").limit(16)


@query("RET-09", f"WITH {MESSAGES_SQL}, t AS (SELECT id, {TOKENS_SQL.format('content_text')} AS terms FROM messages) SELECT id FROM t WHERE list_contains(terms, 'the') AND NOT (list_contains(terms, 'and') AND list_contains(terms, 'of'))")
def fts_exclude_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.simple_terms(F.col("content_text"))
    return messages(spark, sf_dir).where(retrieval.matches(terms, retrieval.parse_query("the")) & ~retrieval.matches(terms, retrieval.parse_query("and of"))).select("id")


WORDS_OF = r"string_split_regex(regexp_replace(content_text, '^\s+|\s+$', '', 'g'), '\s+')"
SCORE_SQL = f"""{MESSAGES_SQL}, t AS (SELECT id, content_text, {TOKENS_SQL.format('content_text')} AS terms FROM messages), counted AS (SELECT *, len(terms)::DOUBLE AS len, len(list_filter(terms, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(terms, lambda x: x = 'and'))::DOUBLE AS b FROM t),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len, count(*) FILTER (a > 0)::DOUBLE AS da, count(*) FILTER (b > 0)::DOUBLE AS db FROM counted),
scored AS (SELECT id, content_text, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg_len)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM counted, stats WHERE a > 0 OR b > 0)"""


@query("RET-05", f"""WITH {SCORE_SQL}, top AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, {WORDS_OF} AS w FROM scored ORDER BY score DESC, id LIMIT 10),
h AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS k FROM top), g AS (SELECT *, list_filter(range(1, len(k) + 1), lambda i: k[i] IN ('the', 'and')) AS places FROM h),
s AS (SELECT *, list_transform(places, lambda i: len(list_distinct(list_filter(k[i:i + 24], lambda x: x IN ('the', 'and'))))) AS found FROM g), b AS (SELECT *, places[list_position(found, list_max(found))] AS best FROM s),
e AS (SELECT *, least(len(w), greatest(list_max(list_filter(places, lambda i: i < best + 25)), best + 9)) AS stop FROM b)
SELECT id, rank, array_to_string(list_transform(range(best, stop + 1), lambda i: CASE WHEN k[i] IN ('the', 'and') THEN '**' || w[i] || '**' ELSE w[i] END), ' ') AS headline FROM e""")
def headline_top_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked first, so the headline is cut for the rows shown alone."""
    scored = retrieval.bm25(messages(spark, sf_dir), ["the", "and"], "content_text", ["id"])
    top = F.broadcast(retrieval.ranked(scored, [F.round("score", 6).desc(), F.col("id")], ["id"], 10)).join(messages(spark, sf_dir).select("id", "content_text"), "id")
    return top.select("id", "rank", retrieval.headline(F.col("content_text"), ["the", "and"]).alias("headline"))


@query(
    "RET-06 RET-07 STR-11 STR-14 STR-15 STR-03",
    f"""WITH flat AS (SELECT doc_id, {SQUASH.format('text')} AS t FROM documents), cut AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^.*?[.!?](\\s|$)') THEN rtrim(regexp_extract(t, '^(.*?[.!?])(\\s|$)', 1)) ELSE t END AS s FROM flat WHERE t <> '')
SELECT doc_id, CASE WHEN length(s) <= 140 THEN s ELSE rtrim(substr(s, 1, 139)) || '…' END AS snippet, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 299)) || '…' END AS excerpt FROM cut""",
)
def snippet_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.excerpt(F.col("text")).alias("excerpt")).where("excerpt IS NOT NULL")


LINE = r"list_filter(list_transform(string_split(trim(summary), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*(?:#{1,6}|[-*+])\s+', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0)[1]"
OPENING = r"""^(.*?[.!?])\s+["''(\[]?[A-Z0-9]"""


@query("RET-14 FIL-15", f"""WITH {SESSIONS_SQL}, t AS (SELECT session_id, nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS stored, {LINE} AS line FROM sessions WHERE title IS DISTINCT FROM 'Warmup'), o AS (SELECT *, coalesce(nullif(regexp_extract(line, '{OPENING}', 1), ''), line) AS opening FROM t)
SELECT session_id, coalesce(stored, opening) AS title, CASE WHEN stored IS NOT NULL THEN 'source' WHEN opening IS NOT NULL THEN 'summary' ELSE 'none' END AS title_source FROM o""")
def title_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, origin = text.resolve_title(F.col("title"), F.col("summary"))
    return sessions(spark, sf_dir).where(text.not_warmup(F.col("title"))).select("session_id", title.alias("title"), origin.alias("title_source"))


@query("JOIN-11", f"""WITH {SESSIONS_SQL}, first AS (SELECT session_id, arg_min(content_text, sequence_num) AS m FROM messages GROUP BY 1), x AS (SELECT session_id, message_count, {SQUASH.format('coalesce(summary, m)')} AS t FROM sessions JOIN first USING (session_id))
SELECT session_id, message_count, 0::BIGINT AS chunk_count, CASE WHEN t = '' THEN NULL WHEN length(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 299)) || '…' END AS excerpt FROM x""")
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir)
    none = said.limit(0).select("session_id", F.lit(0).alias("chunk_index"), F.lit("").alias("text"))
    return reading.digest(sessions(spark, sf_dir), said, none)


@query(
    "RET-20 WIN-07 TXT-07 SRC-17",
    f"""WITH {MESSAGES_SQL}, r AS (SELECT *, length(content_text) AS size, row_number() OVER w AS n, sum(length(content_text)) OVER w AS upto FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY sequence_num, id ROWS UNBOUNDED PRECEDING))
SELECT session_id, id, sequence_num, CASE WHEN n = 1 AND size > 500 THEN substr(content_text, 1, 500) ELSE content_text END AS content_text, n = 1 AND size > 500 AS truncated FROM r WHERE (n = 1 AND size > 500) OR upto <= 500""",
)
def messages_budget_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.budget_page(messages(spark, sf_dir), 500).drop("role")


PACKED_SQL = f"""WITH RECURSIVE {MESSAGES_SQL}, said AS (SELECT session_id, sequence_num, id, '[' || upper(role) || ']: ' || content_text AS t FROM messages WHERE length(content_text) > 0),
long AS (SELECT session_id FROM said GROUP BY 1 HAVING sum(length(t) + 10) > 500), cut AS (SELECT session_id, sequence_num, id, t, unnest(range(0, length(t), 990)) AS a FROM said WHERE session_id IN (SELECT session_id FROM long)),
p AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num, id, a) AS n, least(length(t) - a, 990) AS len, substr(t, a + 1, 990) AS part FROM cut),
walk AS (SELECT session_id, n, 0 AS chunk_index, 1000 - (len + 10) AS room FROM p WHERE n = 1 UNION ALL SELECT p.session_id, p.n, CASE WHEN p.len + 10 > room THEN chunk_index + 1 ELSE chunk_index END, CASE WHEN p.len + 10 > room THEN 1000 ELSE room END - (p.len + 10) FROM walk w JOIN p ON p.session_id = w.session_id AND p.n = w.n + 1),
packed AS (SELECT session_id, chunk_index, arg_min(id, n) AS start_message_id, arg_max(id, n) AS end_message_id, sum(len)::BIGINT AS content_chars, count(*)::INTEGER AS n_pieces, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS text FROM walk JOIN p USING (session_id, n) GROUP BY 1, 2)"""


@query("TXT-05 TXT-06 TXT-08 WIN-09", f"{PACKED_SQL} SELECT session_id, chunk_index, start_message_id, end_message_id, content_chars, n_pieces FROM packed")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.chunk_sessions(messages(spark, sf_dir), most=1000, least=500).drop("text")


@query("TXT-06", f"{PACKED_SQL}, l AS (SELECT session_id, chunk_index, string_split(replace(text, chr(10), ' '), '. ')[1] AS lead FROM packed) SELECT session_id, string_agg(lead, chr(10) ORDER BY chunk_index) AS summary FROM l GROUP BY 1")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.summarise(reading.chunk_sessions(messages(spark, sf_dir), most=1000, least=500))


@query("JOIN-15 FIL-18", f"WITH {MESSAGES_SQL}, chunks AS (SELECT session_id, sequence_num // 3 AS chunk_index, min(id) AS a, max(id) AS b FROM messages GROUP BY 1, 2) SELECT m.session_id, chunk_index, count(*) AS n, sum(length(content_text))::BIGINT AS chars FROM messages m JOIN chunks c ON m.session_id = c.session_id AND m.id BETWEEN a AND b GROUP BY 1, 2")
def chunk_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir)
    chunks = said.groupBy("session_id", F.floor(F.col("sequence_num") / 3).alias("chunk_index")).agg(F.min("id").alias("start_message_id"), F.max("id").alias("end_message_id"))
    return reading.in_range(said, chunks).groupBy("session_id", "chunk_index").agg(F.count("*").alias("n"), F.sum(F.length("content_text")).alias("chars"))


@query("FIL-12 STR-13", f"WITH {SESSIONS_SQL} SELECT session_id, started_at FROM sessions WHERE title ILIKE '%re%' OR session_id = 12 ORDER BY started_at DESC, session_id LIMIT 5")
def session_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = f"%{text.escape_like('re')}%"
    return sessions(spark, sf_dir).where(F.ilike("title", F.lit(pattern)) | (F.col("session_id") == 12)).orderBy(F.desc("started_at"), "session_id").select("session_id", "started_at").limit(5)


@query("SRT-01 SRT-02", f"WITH {SESSIONS_SQL} SELECT session_id, project_id, started_at FROM sessions WHERE project_id IN (2, 3) ORDER BY started_at DESC, session_id LIMIT 10")
def project_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).where(F.col("project_id").isin(2, 3)).orderBy(F.desc("started_at"), "session_id").select("session_id", "project_id", "started_at").limit(10)


@query("RET-02", r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS word FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM w),
v AS (SELECT doc_id, h % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS length, sum(x * (place + 1)) AS moment FROM v GROUP BY 1)
SELECT doc_id, 64 AS dimension, CASE WHEN length > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length, round(coalesce(moment / nullif(length, 0), 0), 4)::DOUBLE AS moment FROM documents LEFT JOIN n USING (doc_id)""")
def text_to_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wharfline.operators.embedding import embed

    return embed(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.size("embedding").alias("dimension"), F.coalesce(F.round(vectors.norm(F.col("embedding")), 4), F.lit(0.0)).alias("length"), F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("moment"))
