"""Transcripts in JSON lines: found by their metadata, read where changed, good and bad lines split, sessions grouped from messages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions.scaffolding import has_scaffolding, strip_scaffolding
from wharfline.functions.times import sane_timestamp
from wharfline.storage import written

FILES = "file_path string, modified_at timestamp, size long"
LINES = "file_path string, modified_at timestamp, line_number int, line string"

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
LINE = f"type string, uuid string, parentUuid string, sessionId string, timestamp string, cwd string, gitBranch string, version string, isSidechain boolean, agentId string, message struct<role:string,model:string,content:string,usage:{USAGE}>, _bad string"
PART = "array<struct<type:string,text:string,thinking:string,name:string,input:string,content:string>>"


def folders(spark: SparkSession, root: str) -> list[str]:
    """root and the folders right below it, each of which is listed on its own if not all can be."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.isDirectory())


def discover(spark: SparkSession, roots: Sequence[str], glob: str = "*.jsonl") -> tuple[DataFrame, list[tuple[str, str]]]:
    """Files below roots as (file_path, modified_at, size), and (folder, error) of the roots that cannot be listed. No file is opened: the reader of binary files
    lists them, and its content column is not asked for. A folder that fails is found by halving, so the others are listed together."""

    def listed(some: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
        try:
            files(some)
            return some, []
        except Exception as error:
            if len(some) == 1:
                return [], [(some[0], str(error).split("\n")[0])]
            half = len(some) // 2
            (a, x), (b, y) = listed(some[:half]), listed(some[half:])
            return a + b, x + y

    def files(some: list[str]) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(some)
        return found.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))

    good, errors = listed(list(roots)) if roots else ([], [])
    return files(good) if good else spark.createDataFrame([], FILES), errors


def path_of(uri: Column) -> Column:
    """The path, as the listing has it, of a file's encoded address."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file_path, modified_at, line_number, line) of files (file_path, modified_at); blank lines count but are left out.

    Files are read in byte ranges, so one may be of any size. Rows of a range follow each other in its task, which numbers them within the range; lines in the
    ranges before, a few sums a file, do the rest. The paths pass the driver, which has them from listing already.
    """
    # what a pattern would mean stands for itself
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["file_path"]) for r in files.select("file_path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], LINES)
    text = spark.read.option("lineSep", "\n").option("ignoreMissingFiles", "true").text(paths)
    # written, so that numbers within a range stay what they are
    rows = written(text.select(path_of(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), "ranges")
    ranges = rows.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("file_path", "block", (before - F.col("first") + 1).alias("shift")).join(files.select("file_path", "modified_at"), "file_path")
    numbered = rows.join(starts, ["file_path", "block"]).withColumn("line", F.regexp_replace("line", "\r$", ""))
    return numbered.where(F.trim("line") != "").select("file_path", "modified_at", (F.col("at") + F.col("shift")).cast("int").alias("line_number"), "line")


def lines(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """`read` of every file below root."""
    return read(spark, discover(spark, [root], glob)[0])


def changed(found: DataFrame, stamps: DataFrame) -> DataFrame:
    """Files, or their lines, whose time is not exactly the one stamped at their last sync (file_path, modified_at)."""
    return found.join(stamps.select("file_path", "modified_at"), ["file_path", "modified_at"], "left_anti")


def parts_of(content: Column) -> Column:
    """The parts of content that is an array; null for plain text."""
    return F.when(content.startswith("["), F.from_json(content, PART))


def content_text(content: Column) -> Column:
    """Plain text, or the text parts and tool results of an array, a line each."""
    nested = lambda c: F.when(c.startswith("["), F.array_join(F.filter(F.transform(F.from_json(c, "array<struct<text:string>>"), lambda r: r["text"]), lambda t: t.isNotNull()), "\n")).otherwise(c)
    said = F.transform(parts_of(content), lambda p: F.when(p["type"] == "text", F.nullif(p["text"], F.lit(""))).when(p["type"] == "tool_result", nested(p["content"])))
    return F.when(content.startswith("["), F.array_join(F.filter(said, lambda t: t.isNotNull()), "\n")).otherwise(F.coalesce(content, F.lit("")))


def tool_used(content: Column) -> Column:
    """The first use of a tool among the parts; null without one."""
    return F.get(F.filter(parts_of(content), lambda p: p["type"] == "tool_use"), F.lit(0))


def thinking(content: Column) -> Column:
    """What all thinking parts say, a line each; null without any."""
    said = F.transform(F.filter(parts_of(content), lambda p: p["type"] == "thinking"), lambda p: F.coalesce(p["thinking"], F.lit("")))
    return F.nullif(F.array_join(said, "\n"), F.lit(""))


def parse(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, bad lines). Lines of other types and messages without a sane time are neither."""
    read = found.withColumn("j", F.from_json("line", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    # permissive parsing gives a row of nulls for text that is no object
    broken = F.col("j._bad").isNotNull() | F.try_parse_json("line").isNull()
    bad = read.where(broken).select("file_path", "line_number", F.col("line").alias("raw"), F.lit("not a JSON object").alias("error"))
    at = sane_timestamp(F.col("j.timestamp"))
    good = read.where(~broken & F.col("j.type").isin("user", "assistant")).withColumn("at", at).where("at IS NOT NULL")
    content = F.col("j.message.content")
    tool = tool_used(content)
    raw = content_text(content)
    messages = good.select(
        "file_path", "modified_at", "line_number", F.col("j.uuid").alias("uuid"), F.col("j.parentUuid").alias("parent_uuid"), F.col("j.sessionId").alias("session"), F.col("j.cwd").alias("cwd"),
        F.col("j.gitBranch").alias("git_branch"), F.col("j.version").alias("version"), F.when(F.col("j.type") == "assistant", F.col("j.message.model")).alias("model"),
        F.when(F.col("j.type") == "user", "user").when(F.nullif(tool["name"], F.lit("")).isNotNull(), "tool").otherwise("assistant").alias("role"),
        F.when(has_scaffolding(raw), strip_scaffolding(raw)).otherwise(raw).alias("content_text"), tool["name"].alias("tool_name"), tool["input"].alias("tool_input"),
        thinking(content).alias("thinking_text"),
        F.coalesce("j.message.usage.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("j.message.usage.output_tokens", F.lit(0)).alias("output_tokens"),
        "at", F.coalesce("j.isSidechain", F.lit(False)).alias("is_sidechain"),
    )
    return messages, bad


def number(messages: DataFrame) -> DataFrame:
    """With sequence_num from 0 by time, ties by line."""
    return messages.withColumn("sequence_num", F.row_number().over(Window.partitionBy("file_path").orderBy("at", "line_number")) - 1)


def sessions(messages: DataFrame) -> DataFrame:
    """A row for each file: its first known facts by line, token sums, first and last time. Agents' files are their own session and name their parent's."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_number"))).alias(c)
    made = messages.groupBy("file_path").agg(
        *[first(c) for c in ("session", "cwd", "git_branch", "version", "model")], F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("message_count"), F.max("modified_at").alias("modified_at"),
    )
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.jsonl$", "")
    agent = stem.startswith("agent-")
    return made.withColumn("is_agent", agent).withColumn("session_id", F.when(agent, stem).otherwise(F.coalesce("session", stem))).withColumn("parent_session_id", F.when(agent, F.col("session")))


def dead_letters(bad: DataFrame, source: str, now: Column) -> DataFrame:
    """Bad lines as rows of the quarantine."""
    return bad.select(
        F.lit(source).alias("source"), "file_path", F.concat(F.lit("line-"), F.col("line_number").cast("string")).alias("record_key"), "line_number", F.lit("parse").alias("stage"),
        F.base64(F.encode("raw", "UTF-8")).alias("payload_base64"), "error", F.lit(1).alias("attempts"), now.alias("first_seen_at"), now.alias("last_attempt_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def replay(letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open dead letters through the same parser again: (messages, still bad)."""
    again = letters.where("resolved_at IS NULL").select("file_path", F.lit(None).cast("timestamp").alias("modified_at"), "line_number", F.decode(F.unbase64("payload_base64"), "UTF-8").alias("line"))
    return parse(again)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(lines, malformed, bad_times, entries) of a history file: display, timestamp, project, pastedContents."""
    text = spark.read.text(path).where(F.trim("value") != "")
    j = F.from_json("value", "display string, timestamp bigint, project string, pastedContents map<string,string>")
    read = text.select(F.try_parse_json("value").isNull().alias("bad"), j.alias("j"))
    late = ~F.coalesce(F.col("j.timestamp").between(1577836800000, 1924991999999), F.lit(False))
    return read.agg(F.count("*").alias("lines"), F.count_if("bad").alias("malformed"), F.count_if(~F.col("bad") & late).alias("bad_times"), F.count_if(~F.col("bad") & ~late).alias("entries"))
