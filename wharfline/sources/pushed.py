"""Pushed conversations: nested JSON with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = (
    "source string, sourceDisplayName string, dataClass string, machine string, os string, project struct<externalId:string,name:string,path:string>, "
    "session struct<externalId:string,title:string,startedAt:string,endedAt:string>, "
    "messages array<struct<externalId:string,role:string,content:string,timestamp:string,sequenceNum:int,metadata:map<string,string>>>"
)


def flat(raw: DataFrame) -> DataFrame:
    """Payload rows as `ingest` takes them: class trimmed and lower-cased, messages with snake-case names."""
    messages = F.transform("messages", lambda m: F.struct(m["externalId"].alias("external_id"), m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("timestamp"), m["sequenceNum"].alias("sequence_num")))
    return raw.select(
        "source", F.lower(F.trim("dataClass")).alias("data_class"), F.col("project.externalId").alias("project_id"), F.col("project.name").alias("project_name"), F.col("session.externalId").alias("session_id"),
        F.col("session.title").alias("title"), messages.alias("messages"),
    )


def invalid(raw: DataFrame) -> DataFrame:
    """Payloads that lack a required field, with why."""
    why = F.when(F.col("source").isNull(), "no source").when(F.col("project.externalId").isNull(), "no project").when(F.col("session.externalId").isNull(), "no session")
    why = why.when(F.length("dataClass") > 32, "class too long").when(F.length("machine") > 64, "machine too long").when(F.size("messages") < 1, "no messages")
    return raw.withColumn("why", why).where("why IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files in the order of their names, which is the order of arrival."""
    return spark.read.schema(PAYLOAD).json(path)
