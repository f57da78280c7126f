"""Connected components of a table of links, by alternating star contractions.

Each round hangs a node's larger neighbours, then its smaller ones, on the least node next to it; the number of rounds grows with the
logarithm of the longest path. Links stay tables in the shared folder throughout, and rounds are tables too, so a lost
executor costs a round's partition at most. A hub with very many links only joins by its own key, which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import written

MOST_ROUNDS = 60


def _least(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("least"))


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one v, and none is a v itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).where("ups > 1 OR (ups > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reachable. Equal ends are ignored."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(_least(both).select("u", F.least("u", "least").alias("least")), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        hung = hung.where("u != v").distinct()
        down = hung.join(_least(hung), "u")
        edges = written(down.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(down.select("u", F.col("least").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
