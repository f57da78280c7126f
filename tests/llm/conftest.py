import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, in several partitions, with extra columns under clashing names."""

    def make(rows, partitions=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        return df.withColumns({"key": F.lit("k"), "id": F.lit("i"), "n": F.lit(1), "spans": F.lit("s"), "node": F.lit(None).cast("string"), "lang": F.lit("en"), "source": F.lit(None).cast("string")})

    return make
