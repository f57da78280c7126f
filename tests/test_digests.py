"""Stores compared by their digests against an anti-join of all rows."""

from pyspark.sql import functions as F

from wharfline.operators import digests


def store(spark, root, rows):
    s = digests.Store(spark, root, "id", ["v"])
    for part in (rows[::2], rows[1::2]):
        s.append(spark.createDataFrame(part, "id long, v string"))
    return s


def test_only_buckets_that_differ_are_read(spark, tmp_path):
    rows = [(k, f"v{k}") for k in range(3000)] + [(None, "n"), (7, "again"), (7, "again")]
    a = store(spark, f"file://{tmp_path}/a", [r for r in rows if r[0] not in (11, 500)])
    b = store(spark, f"file://{tmp_path}/b", [(k, "other" if k == 2000 else v) for k, v in reversed(rows) if k != 1234])
    found = digests.differences(a, b)
    assert sorted((r.id, r.kind) for r in found.collect()) == [(11, "missing"), (500, "missing"), (1234, "orphan"), (2000, "changed")]
    met = digests.unequal(a, b)
    assert 1 <= len(met) <= 4
    assert {r.bucket for r in a.rows(met).select("bucket").distinct().collect()} <= set(met)
    read = {r[0].split("bucket=")[1].split("/")[0] for r in a.rows(met).select(F.input_file_name()).distinct().collect()}
    assert read <= {str(m) for m in met}


def test_equal_stores_need_no_rows(spark, tmp_path):
    rows = [(k, None if k % 3 else str(k)) for k in range(400)]
    a, b = store(spark, f"file://{tmp_path}/a", rows), store(spark, f"file://{tmp_path}/b", rows[::-1])
    assert digests.unequal(a, b) == [] and digests.differences(a, b).collect() == []
    b.append(spark.createDataFrame([(5000, "new")], "id long, v string"))
    assert [(r.id, r.kind) for r in digests.differences(a, b).collect()] == [(5000, "missing")]
    a.append(spark.createDataFrame([(5000, "new")], "id long, v string"))
    assert digests.unequal(a, b) == []
