"""Two stores compared by digests that are kept with them: only buckets that differ are read.

A store is a table in bucket folders by a hash of the key. Beside it lies a digest of each bucket: how many rows it has, and the exclusive or and the sum of two
hashes of its rows, which do not depend on their order. What is appended adds its own digests, which combine with those before, so no row is read again. Comparing goes down a
tree: the whole, then groups of GROUP buckets, then buckets; equal digests end it there. The rows of the buckets left are compared by key and by hash.

Two different contents of a bucket are taken for equal with a chance of about one in 2^96. Null keys are rows like others. Repeated rows count as often as they are there, so they differ from single ones in the digest,
but not in what `differences` reports, which is by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GROUP = 256, 16
DIGESTS = "bucket int, n long, mixed long, total long"


class Store:
    """Rows (key, columns..) below root, with digests. Stores are compared if they have the same key and columns."""

    def __init__(self, spark: SparkSession, root: str, key: str, columns: Sequence[str] = ()) -> None:
        self.spark, self.root, self.key, self.columns = spark, root.rstrip("/"), key, list(columns)

    def _hash(self, tag: str) -> Column:
        return F.xxhash64(F.lit(tag), F.col(self.key).isNull(), self.key, *[c for name in self.columns for c in (F.col(name).isNull(), F.col(name))])

    def append(self, rows: DataFrame) -> None:
        """Adds rows, then their digests."""
        mine = rows.select(self.key, *self.columns).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int"))
        mine.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/rows")
        one = F.shiftrightunsigned(self._hash("sum"), 32)  # of 32 bits, so that four billion rows add up
        made = mine.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(self._hash("mix")).alias("mixed"), F.sum(one).alias("total"))
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/digests")

    def digests(self, by: Column | None = None) -> DataFrame:
        """(node, n, mixed, total) by bucket, or by what is given."""
        rows = self.spark.read.schema(DIGESTS).parquet(f"{self.root}/digests")
        return rows.groupBy((by if by is not None else F.col("bucket")).alias("node")).agg(F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").alias("total"))

    def rows(self, buckets: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows").where(F.col("bucket").isin(*buckets))


def unequal(a: Store, b: Store) -> list[int]:
    """Buckets whose digests differ; at most BUCKETS numbers, and none where the whole is equal."""

    def differ(x: DataFrame, y: DataFrame) -> list[int]:
        both = x.join(y.withColumnsRenamed({c: f"{c}_b" for c in ("n", "mixed", "total")}), "node", "full")
        same = [F.coalesce(F.col(c), F.lit(0)) == F.coalesce(F.col(f"{c}_b"), F.lit(0)) for c in ("n", "mixed", "total")]
        return sorted(r["node"] for r in both.where(~(same[0] & same[1] & same[2])).select("node").collect())

    if not differ(a.digests(F.lit(0)), b.digests(F.lit(0))):
        return []
    group = F.floor(F.col("bucket") / GROUP).cast("int")
    groups = differ(a.digests(group), b.digests(group))
    inside = lambda s: s.digests().where(F.floor(F.col("node") / GROUP).cast("int").isin(*groups))
    return differ(inside(a), inside(b))


def differences(a: Store, b: Store) -> DataFrame:
    """(key, kind): orphan for keys of a alone, missing for keys of b alone, changed where the columns differ. Only buckets that differ are read."""
    buckets = unequal(a, b)
    kind = a.spark.read.parquet(f"{a.root}/rows").schema[a.key].dataType.simpleString()
    if not buckets:
        return a.spark.createDataFrame([], f"`{a.key}` {kind}, kind string")
    side = lambda s, name: s.rows(buckets).select(F.col(s.key).alias(name), s._hash("row").alias("h")).distinct().groupBy(name).agg(F.count("*").alias(f"{name}_n"), F.bit_xor("h").alias(f"{name}_h"))
    both = side(a, "x").join(side(b, "y"), F.col("x").eqNullSafe(F.col("y")), "full")
    why = F.when(F.col("y_h").isNull(), "orphan").when(F.col("x_h").isNull(), "missing").when((F.col("x_h") != F.col("y_h")) | (F.col("x_n") != F.col("y_n")), "changed")
    return both.select(F.when(F.col("x_h").isNull(), F.col("y")).otherwise(F.col("x")).alias(a.key), why.alias("kind")).where("kind IS NOT NULL")
