"""Commits of several tables, acknowledged spools and kept-up centroids, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, messages, table
from wharfline.operators import centroids, digests, manifest
from wharfline.plans.registry import query
from wharfline.plans.source_queries import PAYLOAD_SQL, _payloads
from wharfline.storage import shared_folder
from wharfline.streaming import quiet
from wharfline.streaming.spool import Spool


@query("SNK-34", f"""WITH {MESSAGES_SQL}, m AS (SELECT * FROM messages WHERE role <> 'system') SELECT session_id, count(*) AS n, sum(length(content_text))::BIGINT AS chars, 3::BIGINT AS manifest FROM m GROUP BY session_id""")
def tables_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and their counts change together: two writers begin at the same snapshot, one drops the system's messages, the other counts characters; the second one finds its number taken
    and works again, so both changes are in the last manifest."""
    tables = manifest.Tables(spark, shared_folder(spark, "tables"))
    said = messages(spark, sf_dir)
    counted = lambda rows: rows.groupBy("session_id").agg(F.count("*").alias("n"))
    first = tables.commit(tables.snapshot(), {"messages": said, "counts": counted(said)})
    late = tables.write({"counts": counted(first.table("messages")).withColumn("chars", F.lit(0).cast("long"))})
    fewer = first.table("messages").where("role != 'system'")
    tables.commit(first, {"messages": fewer, "counts": counted(fewer)})
    try:
        tables.publish(first, late)
    except manifest.Conflict:
        sums = lambda s: s.table("messages").groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("content_text")).alias("chars"))
        tables.update(lambda s: {"counts": sums(s)}, reads=["messages"])
    now = tables.snapshot()
    return now.table("counts").withColumn("manifest", F.lit(now.number).cast("long"))


@query("SRC-07 STM-02 SNK-13 SNK-14", f"""WITH p AS (WITH {PAYLOAD_SQL}) SELECT session_id, n, chars, 0::BIGINT AS waiting, (SELECT count(*) FROM p WHERE session_id::BIGINT % 5 = 0) AS letters FROM p WHERE session_id::BIGINT % 5 <> 0""")
def spool_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads arrive in two lots, the second with all of the first again. Messages are there once, payloads without a project are in the quarantine, and the spool is empty."""
    folder, root, archive = (shared_folder(spark, n) for n in ("spool", "spooled", "archive"))
    made = _payloads(spark, sf_dir)
    spool = Spool(spark, folder, root, archive, "*.txt")
    for rows in (made.where("session_id % 2 = 0"), made):
        rows.select("value").write.mode("append").text(folder)
        spool.drain(F.expr("timestamp '2024-06-01 00:00:00'"))
    letters = spool.letters().select(F.get_json_object("payload", "$.session.externalId").alias("s")).distinct().agg(F.count("*").alias("letters"))
    found = spool.messages().groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("content_text")).alias("chars"))
    return found.withColumn("waiting", F.lit(spool.waiting().count()).cast("long")).crossJoin(F.broadcast(letters))  # one row


MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@query("UDF-05 SNK-18 SNK-19 AGG-15", f"""WITH moved AS (SELECT {MOVED} AS label, embedding FROM embeddings), flat AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS place FROM moved),
means AS (SELECT label, place, avg(x::DOUBLE) AS m FROM flat GROUP BY ALL), c AS (SELECT label, list(m ORDER BY place) AS v, sqrt(sum(m * m)) AS len FROM means GROUP BY label)
SELECT c.label::INTEGER AS label, n, round(v[1] / len, 6) AS first, round(v[64] / len, 6) AS last FROM c JOIN (SELECT label, count(*) AS n FROM moved GROUP BY label) USING (label)""")
def centroids_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector moves to the next label: its old label's state loses it, the new one's gains it, and no vector that stayed is read again."""
    rows = table(spark, sf_dir, "embeddings")
    state = centroids.state_of(rows, "label", "embedding")
    moved = rows.where("vec_id % 7 = 0")
    added = moved.withColumn("label", F.expr("(label + 1) % 10").cast(rows.schema["label"].dataType))
    made = centroids.final(centroids.applied(state, "label", "embedding", added, moved), "label")
    return made.select(F.col("label").cast("int").alias("label"), "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"))


@query("STM-05 STM-07 STM-15", """WITH m AS (SELECT user_id, ts, length(props) AS chars, lead(ts) OVER w AS following, sum(length(props)) OVER w AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, max(ts) OVER (PARTITION BY user_id, ts) AS x, max(so_far) OVER (PARTITION BY user_id, ts) AS total FROM m)
SELECT user_id AS session_id, ts AS ended_at, total::BIGINT AS content_chars FROM e WHERE (following IS NULL OR following - ts >= INTERVAL 30 MINUTES) AND ts + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def sessions_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream that is stopped in the middle and started again: every time that a user has been quiet for half an hour, with the characters until then."""
    source, path, checkpoint = (shared_folder(spark, n) for n in ("said", "due", "due-checkpoint"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), F.length("props").alias("chars"))
    middle = rows.agg(F.percentile_approx(F.unix_micros("at"), 0.5)).first()[0]
    for part in (F.unix_micros("at") <= middle, F.unix_micros("at") > middle):
        rows.where(part).write.mode("append").parquet(source)
        quiet.run_due_sessions(spark.readStream.schema(rows.schema).parquet(source), path, checkpoint)
    return spark.read.schema(quiet.DUE).parquet(path).select("session_id", F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "content_chars")


@query("JOIN-16 SET-04 ANA-24", "SELECT vec_id AS doc_id, 'orphan' AS kind FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT DISTINCT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphans_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a label and labels without a vector, found through the digests of both stores."""
    stores = []
    for rows in (table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, sf_dir, "labels").select("doc_id").distinct()):
        stores.append(digests.Store(spark, shared_folder(spark, "store"), "doc_id"))
        stores[-1].append(rows)
    return digests.differences(*stores)
