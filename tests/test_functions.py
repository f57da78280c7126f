"""Expressions against plain values."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wharfline.functions import paths, scaffolding, text, times, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "headline", "wanted"),
    [
        ("First one. Second one.", None, "First one."), ("no end here", None, "no end here"), ("a  b\n c! d", None, "a b c!"), ("raw.", "the  **head** line", "the **head** line"),
        ("v1.2 is out. Yes", None, "v1.2 is out."), ("x" * 200, None, "x" * 139 + "…"), ("", None, None), (None, None, None), ("raw.", "  ", "raw."), ("\u2003wide\u2003space ", None, "wide space"),
    ],
)
def test_snippet(spark, raw, headline, wanted):
    df = spark.createDataFrame([(raw, headline)], "r string, h string")
    assert df.select(text.snippet(F.col("r"), F.col("h"))).first()[0] == wanted


def test_excerpt_is_longer(spark):
    assert one(spark, text.excerpt(F.col("x")), x="y" * 400) == "y" * 299 + "…"


@pytest.mark.parametrize(
    ("title", "summary", "wanted"),
    [
        ("Given", "S. T", ("Given", "source")), ("  ", "## Heading\nmore", ("Heading", "summary")), (None, "It runs v1.13.0 now. Then more.", ("It runs v1.13.0 now.", "summary")),
        (None, "- bullet one. two", ("bullet one. two", "summary")), (None, None, (None, "none")), (None, " \n ", (None, "none")),
    ],
)
def test_title(spark, title, summary, wanted):
    df = spark.createDataFrame([(title, summary)], "t string, s string")
    assert tuple(df.select(*[c.alias(n) for c, n in zip(text.resolve_title(F.col("t"), F.col("s")), "ab", strict=True)]).first()) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("short", "too-short:5"), ("No results found" + "x" * 60, r"pattern:^No results found"), ("plain words " * 10, None), ("x" * 60 + "\n## Slack Brief", r"pattern:^##\s*Slack Brief")])
def test_noise(spark, value, wanted):
    assert one(spark, text.noise_reason(F.col("x")), x=value) == wanted


def test_automated(spark):
    assert one(spark, text.automated_reason(F.col("x")), x="Huddle in #dev\nmore").startswith("pattern:")
    assert one(spark, text.automated_reason(F.col("x")), x="A talk about Huddle in #dev") is None


def test_round_half_up(spark):
    assert one(spark, text.round_half_up(F.lit(-0.125))) == -0.12
    assert one(spark, text.round_half_up(F.lit(0.125))) == 0.13


NOW = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ("P3D", NOW - timedelta(days=3)), ("PT12H", NOW - timedelta(hours=12)), ("P1Y2M", NOW - timedelta(days=425)), ("7d", NOW - timedelta(days=7)), ("2 hours ago", NOW - timedelta(hours=2)),
        ("yesterday", NOW - timedelta(days=1)), ("last week", NOW - timedelta(days=7)), ("1700000000", datetime.fromtimestamp(1700000000, timezone.utc)),
        ("1700000000000", datetime.fromtimestamp(1700000000, timezone.utc)), ("2024-01-15", datetime(2024, 1, 15, tzinfo=timezone.utc)), (None, None), ("", None),
    ],
)
def test_since(value, wanted):
    assert times.since(value, NOW) == wanted


@pytest.mark.parametrize("value", ["soon", "P", "P-3D", "12 moons ago"])
def test_since_refuses(value):
    with pytest.raises(ValueError, match="no time in"):
        times.since(value, NOW)


def test_clamp_and_buckets():
    assert [times.clamp(v, 1, 10, 5) for v in (None, 0, 11, 3)] == [5, 1, 10, 3]
    assert [times.bucket_minutes(m) for m in (10, 60, 61, 360)] == [1, 1, 2, 6]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("d:\\a\\b\\", "D:/a/b"), ("/x//y/", "/x/y"), ("\\\\srv\\share\\", "//srv/share"), ("///srv/x", "//srv/x"), ("c:", "C:/"), ("/", "/"), ("  ", None), ("plain", "plain"), ("D:/", "D:/"), (None, None), ("D:////", "D:/"),
    ],
)
def test_canonical(spark, raw, wanted):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(paths.canonical(F.col("p"))).first()[0] == wanted


def test_canonical_is_idempotent(spark):
    df = spark.createDataFrame([(p,) for p in ("d:\\a", "//s/x//", "/a/b/", "q")], "p string").select(paths.canonical(F.col("p")).alias("c"))
    assert df.where(~F.col("c").eqNullSafe(paths.canonical(F.col("c")))).count() == 0


def test_path_keys_and_variants(spark):
    df = spark.createDataFrame([("D:/Work",), ("/mnt/d/Work",), ("/home/U",), ("name",)], "p string")
    keys = lambda host: [r[0] for r in df.select(paths.equivalence_key(F.col("p"), F.lit(host))).collect()]
    assert keys(True) == ["d:/work", "d:/work", "/home/U", None]
    assert keys(False) == ["d:/work", "/mnt/d/Work", "/home/U", None]
    assert [r[0] for r in df.select(paths.variants(F.col("p"))).collect()] == [["D:/Work", "/mnt/d/Work"], ["/mnt/d/Work", "D:/Work"], ["/home/U"], ["name"]]


def test_belongs_and_parents(spark):
    df = spark.createDataFrame([("D--mechs", "d:\\Mechs"), ("-home-u", "/home/u"), ("-home-u", "/home/x")], "d string, c string")
    assert [r[0] for r in df.select(paths.belongs(F.col("d"), F.col("c"), F.lit(False))).collect()] == [True, True, False]
    files = spark.createDataFrame([("/p/s1/subagents/agent-1.jsonl",), ("/p/s1/x.jsonl",), ("/a/subagents/b/subagents/c",)], "p string")
    assert [r[0] for r in files.select(paths.parent_id(F.col("p"))).collect()] == ["s1", None, None]
    assert paths.ancestors("D:/a/b") == ["D:/a/b", "D:/a", "D:/"]
    assert paths.ancestors("/a") == ["/a", "/"]


@pytest.mark.parametrize(
    ("raw", "wanted", "bare"),
    [
        ("plain <b>x</b>", "plain <b>x</b>", False), ("<command-name>/gm</command-name>\n<command-message>gm</command-message>", "/gm", True),
        ("<command-name>/gm</command-name><command-message>other</command-message>", "/gmother", True), ("a\n<system-reminder>z</system-reminder>\nb", "a\nb", False),
        ("<system-reminder>open", "<system-reminder>open", False), ("<command-args>let x</command-args>", "let x", False), ("```\n<system-reminder>q</system-reminder>\n```", "```\n<system-reminder>q</system-reminder>\n```", False),
        ("<command-args><system-reminder>k</system-reminder></command-args>", "<system-reminder>k</system-reminder>", False), ("<system-reminder>x</system-reminder>", "", True),
        ('<system-reminder id="1">x</system-reminder> tail', "tail", False),
    ],
)
def test_scaffolding(raw, wanted, bare):
    assert scaffolding.strip(raw) == wanted
    assert scaffolding.only(raw) == bare


def test_backfill_plan(spark):
    rows = ["nothing", "<system-reminder>x</system-reminder>", "a" * 1000 + "<system-reminder>x</system-reminder>", "keep <system-reminder>" + "y" * 90 + "</system-reminder>", None]
    df = scaffolding.backfill_plan(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, content_text string")).orderBy("id")
    assert [(r.action, r.reason, r.drop_vector) for r in df.collect()] == [
        ("skip", "no-scaffolding", False), ("unembeddable", "scaffolding-only", True), ("rewrite", "minor-change", False), ("rewrite", "material-change", True), ("skip", "no-scaffolding", False)
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = df.select(vectors.add(F.col("a"), F.col("b")), vectors.subtract(F.col("b"), F.col("a")), vectors.normalise(F.col("z")), F.round(vectors.cosine(F.col("a"), F.col("b")), 6), vectors.cosine(F.col("a"), F.col("z")), vectors.is_zero(F.col("z"))).first()
    assert list(got) == [[4.0, 6.0], [2.0, 2.0], [0.0, 0.0], 0.98387, 0.0, True]
    with pytest.raises(Exception, match="different dimensions"):
        spark.range(1).select(vectors.add(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_compose_and_weights():
    assert vectors.weighted_ids(["7", "8:0.5", " 9:x ", ":3", ""]) == [("7", 1.0), ("8", 0.5), ("9:x", 1.0), (":3", 1.0)]
    assert vectors.compose([3.0, 0.0], [0.0, 4.0]) == [0.6, -0.8]
    assert vectors.compose(like=[([1.0, 0.0], 0.2)], unlike=[([0.0, 1.0], 1.0)]) == pytest.approx([2**-0.5, -(2**-0.5)])
    assert vectors.compose(dimension=2) == [0.0, 0.0]
