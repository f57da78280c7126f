"""The calls of the service, over a small corpus."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from test_operators import corpus

from wharfline.api import Library


@pytest.fixture(scope="module")
def library(spark):
    c = corpus(spark)
    c.sessions = c.sessions.withColumns({"message_count": F.lit(1), "content_chars": F.lit(9000)})
    c.messages = c.messages.withColumns({"sequence_num": F.lit(0), "role": F.lit("user")})
    chunks = spark.createDataFrame([(4, 0, "first chunk. more")], "session_id long, chunk_index int, text string")
    done = spark.createDataFrame([(10,)], "message_id long")
    return Library(c, chunks, done)


def test_calls(library):
    assert library.search("parser", mode="text", since_text="2024-01-02", now=datetime(2024, 2, 1, tzinfo=timezone.utc)).first().session_id == 2
    assert library.session("old").first().session_id == 1
    assert library.session("3").first().session_id == 3
    assert library.digest(4).first().excerpt == "first chunk. more"
    assert library.messages(1, 5).first().truncated
    assert library.message(20).first().session_id == 2
    assert library.chunk(4, 0).count() == 1
    page = library.sessions(limit=2, source_name="s").collect()
    assert [r.session_id for r in page] == [5, 4] and page[0].total == 5
    assert {r.project_id: r.n_sessions for r in library.projects().collect()} == {1: 3, 2: 1, 3: 1}
    assert [r.session_id for r in library.context("/w/b/x").collect()] == [2]
    assert library.health().first().total == 4
    assert [r.n_sessions for r in library.activity("2024-01-01", "2024-01-02").orderBy("day").collect()] == [1, 1]
    assert sorted(r.id for r in library.pending().collect()) == [20, 30, 40, 50, 60]
    assert library.report_useless(1, datetime(2024, 3, 1)).where("deleted_at IS NOT NULL").count() == 2
    with pytest.raises(ValueError, match="needs the table logs"):
        library.log_page()
