"""Draining a spool with acknowledgement: payload files become messages, and only then leave the spool.

A pass takes the waiting files (listed by metadata, without those acknowledged before), and goes through four steps, each of which may be the last one that happens:
messages are appended that the table lacks; payloads that cannot be used are appended to the quarantine, whole, with stage and reason; the files are acknowledged in a table; they are
moved to an archive, or deleted. A run that ends before the acknowledgement does its pass again, which changes nothing twice, and one that ends after it
finds acknowledged files in the spool, which it removes without opening them. Passes go on while files wait; a pass that acknowledges nothing is the last one, so a file that can be neither
used nor quarantined keeps waiting, and nothing goes round for ever.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.sources import pushed, transcripts
from wharfline.storage import written
from wharfline.streaming.jobs import SPOOLED, append_absent

#: Files of a pass.
PASS_FILES = 10_000
ACKS = "file_path string, modified_at timestamp, acked_at timestamp"
LETTERS = "file_path string, line_number int, stage string, payload string, error string, part int"


@dataclass
class Drained:
    passes: int = 0
    files: int = 0
    errors: list[str] = field(default_factory=list)


class Spool:
    """A folder of payload files (a payload a line) and, below root, the tables messages, letters and acks."""

    def __init__(self, spark: SparkSession, folder: str, root: str, archive: str | None = None, glob: str = "*") -> None:
        self.spark, self.folder, self.root, self.archive, self.glob = spark, folder.rstrip("/"), root.rstrip("/"), archive, glob
        spark.createDataFrame([], ACKS).write.mode("ignore").parquet(f"{self.root}/acks")
        spark.createDataFrame([], SPOOLED).write.mode("ignore").partitionBy("part").parquet(f"{self.root}/messages")
        spark.createDataFrame([], LETTERS).write.mode("ignore").partitionBy("part").parquet(f"{self.root}/letters")

    def messages(self) -> DataFrame:
        return self.spark.read.schema(SPOOLED).parquet(f"{self.root}/messages").drop("part")

    def letters(self) -> DataFrame:
        """The quarantine: (file_path, line_number, stage, payload, error)."""
        return self.spark.read.schema(LETTERS).parquet(f"{self.root}/letters").drop("part")

    def acks(self) -> DataFrame:
        return self.spark.read.schema(ACKS).parquet(f"{self.root}/acks")

    def listed(self) -> DataFrame:
        return transcripts.discover(self.spark, [self.folder], self.glob)[0]

    def waiting(self) -> DataFrame:
        """Files that nothing has acknowledged; one that is written again under its name waits again."""
        return transcripts.changed(self.listed(), self.acks())

    def drain(self, now: Column | None = None, pass_files: int = PASS_FILES) -> Drained:
        done = Drained()
        done.errors += self.remove(transcripts.changed(self.listed(), self.waiting()))
        while True:
            files = written(self.waiting().orderBy("file_path").limit(pass_files), "waiting")
            count = files.count()
            if not count:
                return done
            done.passes += 1
            try:
                self.store(files)
                self.acknowledge(files, now if now is not None else F.current_timestamp())
            except Exception as error:  # what is lost here waits in the spool
                done.errors.append(str(error).split("\n")[0])
                return done
            done.files += count
            done.errors += self.remove(files)

    def store(self, files: DataFrame) -> None:
        """Messages into the table, unusable payloads into the quarantine; coming again changes nothing."""
        lines = written(transcripts.read(self.spark, files), "payloads")
        # a line that is no object is null, and so is one whose fields are of other kinds
        read = lines.withColumn("j", F.from_json("line", f"{pushed.PAYLOAD}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        broken = F.try_parse_json("line").isNull() | F.col("j._bad").isNotNull()
        usable = read.where(~broken).select("file_path", "line_number", "line", "j.*")
        lacking = pushed.invalid(usable)
        letters = read.where(broken).select("file_path", "line_number", F.lit("parse").alias("stage"), F.col("line").alias("payload"), F.lit("not a payload object").alias("error"))
        letters = letters.unionByName(lacking.select("file_path", "line_number", F.lit("insert").alias("stage"), F.col("line").alias("payload"), F.col("why").alias("error")))
        append_absent(letters, f"{self.root}/letters", ["file_path", "line_number", "payload"], LETTERS)
        good = usable.join(lacking.select("file_path", "line_number"), ["file_path", "line_number"], "left_anti")
        said = good.select(F.col("session.externalId").alias("session_id"), F.explode("messages").alias("m"))
        append_absent(said.select("session_id", F.col("m.externalId").alias("external_id"), F.col("m.role").alias("role"), F.col("m.content").alias("content_text")), f"{self.root}/messages", ["session_id", "external_id"], SPOOLED)

    def acknowledge(self, files: DataFrame, now: Column) -> None:
        files.select("file_path", "modified_at", now.cast("timestamp").alias("acked_at")).coalesce(1).write.mode("append").parquet(f"{self.root}/acks")

    def remove(self, files: DataFrame) -> list[str]:
        """Acknowledged files go to the archive, or away; what fails is named and left, and is not read again. At most a pass of paths."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if self.archive:
            store.mkdirs(path(self.archive))
        errors = []
        for row in files.select("file_path").toLocalIterator():
            source = path(row["file_path"])
            try:
                # the folder that the file lies in keeps names apart
                target = path(self.archive, f"{abs(source.getParent().hashCode()):x}-{source.getName()}") if self.archive else None
                done = store.rename(source, target) if target else store.delete(source, False)
                if not done and store.exists(source):
                    errors.append(f"{row['file_path']} could not be removed")
            except Exception as error:
                errors.append(f"{row['file_path']}: {str(error).splitlines()[0]}")
        return errors
