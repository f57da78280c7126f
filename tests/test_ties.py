"""Results that must not hang on the order of additions or on how a clock is cut into doubles."""

import duckdb
import pytest
from oracle import rows

from wharfline.plans.catalog import CATALOG


@pytest.mark.parametrize("turn", [1, -1])
def test_halves_of_durations_and_means(spark, tmp_path, turn):
    """Means and spans that lie on a half or a millionth beside it; the doubles of the last users add up to less than their half in either order."""
    base = 1_704_067_211_172_425
    made = [(1, [49.1, 0.2, 0.3, 50.4], 2_555_602_500_000), (2, [0.1, 0.2, 0.3, 0.1, 0.2, 2.1], 499_999), (3, [0.7, 0.1, 0.3, 0.9], 500_000), (4, [-0.7, -0.1, -0.3, -0.9], 1_499_999), (5, [None, 1.49], 7)]
    made += [(u, [3.66, 4.17, 88.71, 1.46], 500_001) for u in range(6, 40)]
    events = [(u, base + (u if k % 2 == 0 else u + span), v) for u, values, span in made for k, v in enumerate(values[::turn])]
    df = spark.createDataFrame(events, "user_id long, us long, value double").selectExpr("user_id", "CAST(timestamp_micros(us) AS timestamp_ntz) AS ts", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    view = CATALOG["session_duration_view"]
    got = view.run(spark, str(tmp_path))
    seen = {r.user_id: (r.seconds, r.mean_value) for r in got.collect()}
    assert {u: seen[u] for u in range(1, 7)} == {1: (2_555_603, 25), 2: (0, 1), 3: (1, 1), 4: (1, -1), 5: (0, 1), 6: (1, 25)}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(got.toPandas()) == rows(c.sql(view.sql).df())
