"""Control of running jobs: a stand-down row with a deadline, and what the catalog knows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from wharfline.functions.times import clamp

CONTROL = "until timestamp, reason string"
#: The least, most and usual minutes of a stand-down.
STAND_DOWN = (1, 240, 15)


def stand_down(spark: SparkSession, path: str, now: datetime, minutes: int | None = None, reason: str = "") -> datetime:
    """Writes the control row; returns its deadline."""
    until = now + timedelta(minutes=clamp(minutes, *STAND_DOWN))
    spark.createDataFrame([(until, reason)], CONTROL).coalesce(1).write.mode("overwrite").parquet(path)
    return until


def resume(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], CONTROL).coalesce(1).write.mode("overwrite").parquet(path)


def standing_down(spark: SparkSession, path: str, now: datetime) -> bool:
    """Whether a deadline lies ahead; a control table that cannot be read stops nothing."""
    try:
        row = spark.read.schema(CONTROL).parquet(path).first()
    except Exception:  # noqa: BLE001
        return False
    return row is not None and row["until"] is not None and row["until"] > now


def present(spark: SparkSession, names: list[str]) -> dict[str, bool]:
    """Which tables or views the catalog knows."""
    return {n: spark.catalog.tableExists(n) for n in names}
