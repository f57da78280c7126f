"""Queries of sources and streams: the given tables written as transcripts, payloads and logs into the shared folder, and read as such."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.data import MESSAGES_SQL, messages, table
from wharfline.functions import times
from wharfline.operators import merge
from wharfline.plans.registry import query
from wharfline.sources import pushed, transcripts
from wharfline.storage import shared_folder
from wharfline.streaming import control, jobs
from wharfline.sync import Tables, sync

#: Conversations are dealt to so many transcript files, each of which reads as one session.
FILES = 20
NOW = "timestamp '2024-01-31 00:00:00'"
FILE = "session_id % 20"


def _lines(spark: SparkSession, sf_dir: str, broken: int) -> DataFrame:
    """(file, value): a JSON line for each message, some broken off, and a line of another type for each file's first message."""
    at = F.date_format(F.timestamp_add("second", F.col("id").cast("int"), F.expr(NOW)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("sequence_num") % 2 == 0, "user").otherwise("assistant")
    usage = F.struct(F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    name = F.concat(F.lit("s"), (F.col("session_id") % FILES).cast("string"))
    line = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"), name.alias("sessionId"), at.alias("timestamp"), F.lit("/w").alias("cwd"), F.struct(kind.alias("role"), F.lit("m").alias("model"), F.coalesce("content_text", F.lit("")).alias("content"), usage.alias("usage")).alias("message")))
    said = messages(spark, sf_dir).select("id", (F.col("session_id") % FILES).alias("file"), F.when(F.col("id") % broken == 0, F.substring(line, 1, 45)).otherwise(line).alias("value"))
    other = said.groupBy("file").agg(F.min("id").alias("id")).select("id", "file", F.lit('{"type":"summary","sessionId":"other"}').alias("value"))
    return said.unionByName(other)


def _written(spark: SparkSession, sf_dir: str, broken: int) -> str:
    root = shared_folder(spark, "transcripts")
    _lines(spark, sf_dir, broken).repartition("file").sortWithinPartitions("file", "id", F.desc("value")).select("file", "value").write.partitionBy("file").text(root)
    return root


@query("SRC-01 SRC-02 SRC-03 SRC-04 SNK-39 SNK-04 SNK-06 STM-01 STM-20", f"""WITH {MESSAGES_SQL} SELECT 's' || ({FILE}) AS session_id, count(*) AS message_count, sum(length(coalesce(content_text, '')))::BIGINT AS content_chars, 2::INTEGER AS runs FROM messages WHERE id % 9 <> 0 GROUP BY 1""")
def transcripts_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of transcripts synced twice: the second time no file has changed, so nothing is parsed and nothing grows."""
    root, now = _written(spark, sf_dir, 9), F.expr(NOW)
    once, first = sync(spark, root, Tables.empty(spark), now, glob="*.txt")
    twice, second = sync(spark, root, once, now, glob="*.txt")
    runs = (first.files > 0) + (second.files == 0 and second.messages == 0)
    return twice.sessions.select("session_id", "message_count", "content_chars", F.lit(int(runs)).alias("runs"))


@query("SRC-04 SRC-03 WIN-06", f"WITH {MESSAGES_SQL} SELECT 's' || ({FILE}) AS session, count(*) AS total_input_tokens, (count(*) * 2)::BIGINT AS total_output_tokens, max(n) AS last_number FROM (SELECT *, row_number() OVER (PARTITION BY {FILE} ORDER BY id) - 1 AS n FROM messages WHERE id % 9 <> 0) GROUP BY 1")
def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums of each file and the numbers that its messages get by time."""
    parsed, _ = transcripts.parse(transcripts.lines(spark, _written(spark, sf_dir, 9), "*.txt"))
    numbered = transcripts.number(parsed)
    last = numbered.groupBy("file_path").agg(F.max("sequence_num").cast("long").alias("last_number"))
    return transcripts.sessions(parsed).join(last, "file_path").select("session", "total_input_tokens", "total_output_tokens", "last_number")


@query("SNK-14 STM-03 SNK-13", f"WITH {MESSAGES_SQL} SELECT count(*) AS letters, (count(*) FILTER (id % 2 = 0))::BIGINT AS still_bad, (count(*) FILTER (id % 2 <> 0))::BIGINT AS replayed, 2 AS attempts FROM messages WHERE id % 3 = 0")
def letters_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken lines end in the quarantine, a second time too; payloads of the odd ones are mended there, and all go through the parser again."""
    found = transcripts.lines(spark, _written(spark, sf_dir, 3), "*.txt")
    bad = transcripts.dead_letters(transcripts.parse(found)[1], "transcripts", F.expr(NOW))
    letters = merge.quarantine(merge.quarantine(bad.limit(0), bad), bad)
    whole = F.to_json(F.struct(F.lit("user").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct(F.lit("x").alias("content")).alias("message")))
    number = F.regexp_extract(F.decode(F.unbase64("payload_base64"), "UTF-8"), '"uuid":"u(\\d+)', 1).try_cast("long")
    mended = letters.withColumn("payload_base64", F.when(number % 2 != 0, F.base64(F.encode(whole, "UTF-8"))).otherwise(F.col("payload_base64")))
    good, again = transcripts.replay(mended)
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    return letters.agg(F.count("*").alias("letters"), F.max("attempts").alias("attempts")).crossJoin(one(again, "still_bad")).crossJoin(one(good, "replayed"))


@query("SRC-05", "SELECT count(*) AS lines, count(*) FILTER (event_id % 10 = 0) AS malformed, count(*) FILTER (event_id % 10 = 1) AS bad_times, count(*) FILTER (event_id % 10 > 1) AS entries FROM events")
def history_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a history file: a tenth is broken off, a tenth bears a time before anything was."""
    k, path = F.col("event_id") % 10, shared_folder(spark, "history")
    line = F.to_json(F.struct(F.col("event_type").alias("display"), F.when(k == 1, F.lit(5).cast("long")).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).alias("timestamp"), F.lit("/w").alias("project")))
    table(spark, sf_dir, "events").select(F.when(k == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return transcripts.history(spark, path)


PAYLOAD_SQL = f"{MESSAGES_SQL} SELECT session_id::VARCHAR AS session_id, count(*) AS n, sum(length(coalesce(content_text, '')))::BIGINT AS chars FROM messages GROUP BY 1"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, value): each conversation as a pushed payload; every fifth names no project."""
    item = F.struct(F.col("id").cast("string").alias("externalId"), "role", F.coalesce("content_text", F.lit("")).alias("content"), F.col("sequence_num").cast("int").alias("sequenceNum"))
    grouped = messages(spark, sf_dir).groupBy("session_id").agg(F.sort_array(F.collect_list(item)).alias("messages"))
    name = F.col("session_id").cast("string").alias("externalId")
    project = F.when(F.col("session_id") % 5 != 0, F.struct(F.lit("p").alias("externalId"), F.lit("n").alias("name")))
    return grouped.select("session_id", F.to_json(F.struct(F.lit("push").alias("source"), F.lit(" Work").alias("dataClass"), project.alias("project"), F.struct(name, F.lit("t").alias("title")).alias("session"), "messages")).alias("value"))


@query("SRC-06", f"WITH p AS ({'WITH ' + PAYLOAD_SQL}) SELECT session_id, n, chars, CASE WHEN session_id::BIGINT % 5 = 0 THEN 'no project' END AS why FROM p")
def payloads_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "payloads")
    _payloads(spark, sf_dir).select("value").write.text(path)
    raw = pushed.read(spark, path)
    lacking = pushed.invalid(raw).select(F.col("session.externalId").alias("session_id"), "why")
    flat = pushed.flat(raw).select("session_id", F.explode("messages").alias("m")).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"))
    return flat.join(lacking, "session_id", "left")


@query("SRC-07 STM-02 STM-14", f"WITH {PAYLOAD_SQL}")
def spool_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads arrive in two lots, the second with all of the first again; each message is there once."""
    spool, root, checkpoint = (shared_folder(spark, n) for n in ("spool", "spooled", "checkpoint"))
    made = _payloads(spark, sf_dir)
    for rows in (made.where("session_id % 2 = 0"), made):
        rows.select("value").write.mode("append").text(spool)
        jobs.spool_messages(spark, spool, root, checkpoint)
    return jobs.spooled(spark, root).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("content_text")).alias("chars"))


@query("SNK-16 STM-09", "SELECT event_type AS level, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1")
def logs_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of log rows into a table, in micro-batches, twice: the second run finds nothing new."""
    source, path, checkpoint = (shared_folder(spark, n) for n in ("log-source", "logs", "log-checkpoint"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("level"), F.col("ts").alias("logged_at"))
    rows.write.parquet(source)
    for _ in range(2):
        jobs.stream_logs(spark.readStream.schema(rows.schema).parquet(source), path, checkpoint, None)
    return spark.read.parquet(path).groupBy("level").agg(F.count("*").alias("n"), F.max("logged_at").alias("last_at"))


@query("SNK-24 STM-12 FIL-26", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-15 04:00:00') AS deferred, count(*) FILTER (ts >= TIMESTAMP '2024-01-15 04:00:00') AS taken FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def jobs_stood_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-down of 999 minutes is cut to the most, four hours; what comes in until its deadline waits, and after it is lifted nothing does."""
    path, start = shared_folder(spark, "control"), datetime(2024, 1, 15)
    until = control.stand_down(spark, path, start, 999)
    stands = control.standing_down(spark, path, start)
    control.resume(spark, path)
    if not stands or control.standing_down(spark, path, start):
        raise RuntimeError("the control row does not say what was written")
    rows = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    wait = F.col("ts") < F.lit(until).cast("timestamp_ntz")
    return rows.agg(F.count_if(wait).alias("deferred"), F.count_if(~wait).alias("taken"))


@query("SRC-18 SRC-16", "SELECT 'documents' AS name, TRUE AS present, count(*) AS n FROM documents UNION ALL SELECT 'nowhere', FALSE, 0")
def tables_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("wharfline_documents")
    known = control.present(spark, ["wharfline_documents", "wharfline_nowhere"])
    named = docs.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.struct(F.lit(k.removeprefix("wharfline_")).alias("name"), F.lit(v).alias("present")) for k, v in known.items()])).alias("x"), "n")
    return named.select("x.name", "x.present", F.when(F.col("x.present"), F.col("n")).otherwise(0).alias("n"))


@query("SRC-12", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def view_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view by name, read in SQL."""
    table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("n")).createOrReplaceTempView("wharfline_tool_stats")
    return spark.sql("SELECT event_type, n FROM wharfline_tool_stats WHERE n > 0")


@query("FIL-26 DT-01", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1")
def clamped_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 99,999 minutes is cut to a day."""
    minutes = times.clamp(99_999, 1, 1440, 60)
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.expr(f"timestamp_ntz '2024-01-31 00:00:00' - INTERVAL {minutes} MINUTES")).groupBy("event_type").agg(F.count("*").alias("n"))
