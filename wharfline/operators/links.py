"""Parents of sessions and merging of projects: plans first, writes after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.functions import paths
from wharfline.storage import written


def parent_links(sessions: DataFrame) -> DataFrame:
    """Of sessions (session_id, project_id, external_id, parent_external_id, parent_id, deleted_at): (session_id, parent_id) to set.

    A parent is a session of the same project with that external id; never itself, never a deleted one; only where none is set.
    """
    alive = sessions.where("deleted_at IS NULL")
    wanted = alive.where("parent_id IS NULL AND parent_external_id IS NOT NULL").select("session_id", "project_id", F.col("parent_external_id").alias("external_id"))
    found = alive.groupBy("project_id", "external_id").agg(F.min("session_id").alias("parent_id"))
    return wanted.join(found, ["project_id", "external_id"]).where("session_id != parent_id").select("session_id", "parent_id")


def cyclic(links: DataFrame) -> DataFrame:
    """(session_id) of links (session_id, parent_id) that lie on a cycle. Each round doubles how far every pointer reaches; a pointer that runs off
    the end of its chain is dropped. The sessions pointed at only become fewer, and once a round leaves as many, they are the cycles: in a chain or
    in the branches that lead into a cycle, the last one would have gone. Rounds grow with the logarithm of the longest chain, and of the links at most."""
    reached = written(links.select("session_id", "parent_id"), "links")
    met = reached.select("parent_id").distinct().count()
    for _ in range(reached.count().bit_length() + 1):
        if not met:
            break
        onward = reached.select(F.col("session_id").alias("parent_id"), F.col("parent_id").alias("next"))
        reached = written(reached.join(onward, "parent_id").select("session_id", F.col("next").alias("parent_id")), "links")
        before, met = met, reached.select("parent_id").distinct().count()
        if met == before:
            break
    return reached.select(F.col("parent_id").alias("session_id")).distinct()


def apply_links(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """sessions with parents set where they were null; links that would close a cycle are refused."""
    old = sessions.where("parent_id IS NOT NULL").select("session_id", "parent_id")
    ok = links.join(cyclic(links.unionByName(old)), "session_id", "left_anti").select("session_id", F.col("parent_id").alias("__p"))
    joined = sessions.join(ok, "session_id", "left")
    return joined.withColumn("parent_id", F.coalesce("parent_id", "__p")).select(*sessions.columns)


def revert_links(sessions: DataFrame, journal: DataFrame) -> DataFrame:
    """Takes back links of a journal where they are still what it wrote."""
    j = journal.select("session_id", F.col("parent_id").alias("__p"), F.lit(True).alias("__j"))
    joined = sessions.join(j, "session_id", "left")
    return joined.withColumn("parent_id", F.when(F.col("__j") & F.col("parent_id").eqNullSafe(F.col("__p")), None).otherwise(F.col("parent_id"))).select(*sessions.columns)


def repath(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """projects (project_id, source, external_id, path, machine) with new_path: the most frequent cwd that proves itself, else the stored path made canonical."""
    votes = sessions.where("cwd IS NOT NULL").groupBy("project_id", "cwd").agg(F.count("*").alias("n"))
    hosts = projects.select("project_id", "external_id", F.coalesce("windows_host", F.lit(False)).alias("windows_host"))
    proven = votes.join(hosts, "project_id").where(paths.belongs(F.col("external_id"), F.col("cwd"), F.col("windows_host")))
    best = proven.groupBy("project_id").agg(F.max(F.struct("n", paths.canonical(F.col("cwd")).alias("p")))["p"].alias("proven_path"))
    return projects.join(best, "project_id", "left").withColumn("new_path", F.coalesce("proven_path", paths.canonical(F.col("path")))).drop("proven_path")


def merge_projects(projects: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects of one source with equal keys become the one with most sessions (ties: least id); sessions move to it. Raises where a /mnt path and
    its twin meet on machines of both kinds, since then nothing proves that they are one directory."""
    counted = projects.join(sessions.groupBy("project_id").agg(F.count("*").alias("n")), "project_id", "left").fillna(0, ["n"])
    host = F.coalesce("windows_host", F.lit(False))
    keyed = counted.withColumn("key", F.coalesce(paths.equivalence_key(F.col("path"), host), F.concat(F.lit("#"), F.col("project_id").cast("string"))))
    mixed = keyed.groupBy("source", "key").agg(F.count_distinct(host).alias("hosts"), F.count_distinct("machine").alias("machines"), F.count("*").alias("n")).where("n > 1 AND hosts > 1 AND machines > 1")
    if row := mixed.select("source", "key").first():
        raise ValueError(f"cannot merge {row[1]} of {row[0]}: machines of different kinds hold it")
    keeper = keyed.groupBy("source", "key").agg(F.max_by("project_id", F.struct("n", -F.col("project_id"))).alias("keeper"))
    mapped = keyed.join(keeper, ["source", "key"]).select("project_id", "keeper")
    moved = sessions.join(mapped, "project_id", "left").withColumn("project_id", F.coalesce("keeper", "project_id")).select(*sessions.columns)
    kept = projects.join(mapped.where("project_id = keeper").select("project_id"), "project_id", "left_semi")
    return kept, moved
