"""Structured Streaming: spool to tables, rates in windows, session gaps. Each job runs to the end of what is there and stops; a scheduler starts it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wharfline.sources.pushed import PAYLOAD


#: Parts of a spooled table: a batch reads the keys of those alone that its rows fall in.
PARTS = 64
SPOOLED = "session_id string, external_id string, role string, content_text string, part int"


def drain(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch through write; the checkpoint moves on only once write has returned, so a failed batch comes again. It ends when nothing is left, so it cannot go round without progress."""
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_absent(batch: DataFrame, root: str, keys: list[str], schema: str, parts: int = PARTS) -> None:
    """Appends the batch's rows whose keys the table below root lacks. The table is split by a hash of the keys; only the parts that the batch falls in are looked at,
    and nothing is written anew. Coming again changes nothing."""
    spark = batch.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(root)
    fresh = batch.dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    met = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most `parts` numbers
    known = spark.read.schema(schema).parquet(root).where(F.col("part").isin(met)).select(*keys, "part")
    fresh.join(known, [*keys, "part"], "left_anti").repartition("part").write.mode("append").partitionBy("part").parquet(root)


def spool_messages(spark: SparkSession, spool: str, table_root: str, checkpoint: str) -> None:
    """New payload files into the message table below table_root; rows are keyed by outside ids, so coming again does no harm."""

    def write(batch: DataFrame, number: int) -> None:
        said = batch.select(F.col("session.externalId").alias("session_id"), F.explode("messages").alias("m")).select("session_id", F.col("m.externalId").alias("external_id"), F.col("m.role").alias("role"), F.col("m.content").alias("content_text"))
        append_absent(said, table_root, ["session_id", "external_id"], SPOOLED)

    drain(spark.readStream.schema(PAYLOAD).json(spool), write, checkpoint)


def spooled(spark: SparkSession, table_root: str) -> DataFrame:
    return spark.read.schema(SPOOLED).parquet(table_root).drop("part")


def stream_logs(source: DataFrame, path: str, checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    """Log rows as they come, in micro-batches; without seconds, what is there, to its end."""
    writer = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if seconds is not None:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_rates(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of each window; works on a stream with a watermark and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def session_gaps(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events with no pause of gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of each key on a stream, remembered for `late`; on a table simply one of each key."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
