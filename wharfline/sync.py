"""A whole sync: transcripts that changed into messages and sessions, bad lines into the quarantine, stamps moved on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.operators import merge
from wharfline.sources import transcripts
from wharfline.storage import written

MESSAGES = "session_id string, external_id string, sequence_num int, role string, content_text string, tool_name string, at timestamp, input_tokens long, output_tokens long"
SESSIONS = "session_id string, parent_session_id string, file_path string, cwd string, git_branch string, model string, message_count long, content_chars long, first_at timestamp, last_at timestamp"
LETTERS = "source string, file_path string, record_key string, line_number int, stage string, payload_base64 string, error string, attempts int, first_seen_at timestamp, last_attempt_at timestamp, resolved_at timestamp"
STAMPS = "file_path string, modified_at timestamp"


@dataclass
class Tables:
    messages: DataFrame
    sessions: DataFrame
    letters: DataFrame
    stamps: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Tables:
        return Tables(*[spark.createDataFrame([], s) for s in (MESSAGES, SESSIONS, LETTERS, STAMPS)])


@dataclass
class Report:
    files: int
    lines: int
    messages: int
    bad: int
    #: (folder, error) of the folders that could not be listed; the others are synced
    errors: list[tuple[str, str]]


def sync(spark: SparkSession, root: str, tables: Tables, now: Column, source: str = "transcripts", glob: str = "*.jsonl") -> tuple[Tables, Report]:
    """The tables afterwards, and what was done. Files whose time has not changed are not opened; messages are keyed by session and outside id."""
    listed, errors = transcripts.discover(spark, [root], glob)
    if errors and (below := transcripts.folders(spark, root)):
        listed, errors = transcripts.discover(spark, below, glob)
    fresh = written(transcripts.changed(listed, tables.stamps), "files")
    found = written(transcripts.read(spark, fresh), "lines")
    parsed, bad = transcripts.parse(found)
    parsed = written(transcripts.number(parsed), "parsed")
    owner = transcripts.sessions(parsed).select("file_path", "session_id", "parent_session_id")
    new = parsed.join(owner, "file_path").select("session_id", F.col("uuid").alias("external_id"), "sequence_num", "role", "content_text", "tool_name", "at", "input_tokens", "output_tokens")
    messages = written(merge.insert_absent(tables.messages, new.where("external_id IS NOT NULL"), ["session_id", "external_id"]), "messages")
    stats = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.sum(F.length("content_text")).alias("content_chars"))
    facts = transcripts.sessions(parsed).select("session_id", "parent_session_id", "file_path", "cwd", "git_branch", "model", "first_at", "last_at")
    one = merge.latest(facts, ["session_id"], [F.desc("last_at"), F.col("file_path")])
    merged = merge.merge_by_key(tables.sessions, one, ["session_id"]).drop("message_count", "content_chars")
    sessions = written(merged.join(stats, "session_id", "left").select(*tables.sessions.columns), "sessions")
    letters = written(merge.quarantine(tables.letters, transcripts.dead_letters(bad, source, now)), "letters")
    stamps = written(merge.merge_by_key(tables.stamps, fresh.select("file_path", "modified_at"), ["file_path"], default=merge.overwrite), "stamps")
    return Tables(messages, sessions, letters, stamps), Report(fresh.count(), found.count(), parsed.count(), bad.count(), errors)
