"""The library's own functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wharfline.functions.english import terms_of
from wharfline.functions.scaffolding import scaffolding_only, strip_scaffolding

#: Name, parameters and body of each; bodies are plain SQL, so they are inlined and optimised like any expression.
SQL_FUNCTIONS = {
    "cosine_sim": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"),
    "simple_terms": ("t STRING", "ARRAY<STRING>", "filter(split(lower(t), '[^a-z0-9]+'), x -> x <> '')"),
    "rank_share": ("rank BIGINT", "DOUBLE", "1D / (60 + rank)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers everything for the session; returns the names. chunk_messages is a table function of reading.CHUNKS' columns:
    SELECT * FROM chunk_messages(TABLE(m) PARTITION BY session_id ORDER BY (sequence_num, id), 28000)."""
    from wharfline.operators.reading import CHUNKS, ChunkMessages

    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udf.register("strip_scaffolding", strip_scaffolding)
    spark.udf.register("scaffolding_only", scaffolding_only)
    spark.udf.register("english_terms", terms_of)
    spark.udtf.register("chunk_messages", F.udtf(ChunkMessages, returnType=CHUNKS))
    return [*SQL_FUNCTIONS, "strip_scaffolding", "scaffolding_only", "english_terms", "chunk_messages"]
