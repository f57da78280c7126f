"""The stemmer against the published sample of its vocabulary and against the same rules in SQL; phrases over words that are left out."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from wharfline.functions import english
from wharfline.operators import retrieval
from wharfline.plans import english_sql

#: The sample of the stemmer's vocabulary that its authors publish, stem by stem, and some more words.
SAMPLE = """consign consign consigned consigning consignment; consist consist consisted consistency consistent consistently consisting consists; consol consolation consolations console consoled consoles consoling consolingly consols;
consolatori consolatory; consolid consolidate consolidated consolidating; conson consonant; consort consort consorted consorting; conspicu conspicuous conspicuously; conspiraci conspiracy; conspir conspirator conspirators conspire conspired conspiring;
constabl constable constables; constanc constance constancy; constant constant; knack knack knacks; knackeri knackeries; knag knag; knave knave knaves; knavish knavish; knead kneaded kneading; knee knee knees;
kneel kneel kneeled kneeling kneels; knell knell; knelt knelt; knew knew; knick knick; knif knif; knife knife; knight knight knights; knight knightly; knit knit knits knitted knitting; knive knives; knob knob knobs;
knock knock knocked knocking knocks; knocker knocker knockers; knopp knopp; knot knot knots; relat relational relate; generous generously generous; generat generate generated; hop hop hopping hopped; hope hope hoping hoped; ski skis; sky sky skies; die dying;
happili happily; nation nation national nationally; succeed succeed succeeding; inning inning innings; say say; youth youth; boyish boyish"""


def sample():
    out = {}
    for group in SAMPLE.replace("\n", " ").split(";"):
        stem, *words = group.split()
        out.update(dict.fromkeys(words, stem))
    return out


def test_published_sample():
    assert {w: english.stem(w) for w in sample()} == sample()


def test_rules_in_sql():
    rnd = random.Random(1)
    parts = "con sist ly ed ing s es ness ful ation al ize er iv ity able ment y e i o a ous li ll gener eed ogi bl at iz st t r sk commun arsen ex ceed 4".split()
    words = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))) for _ in range(20000)} | set(sample()) | set(english.EXCEPTIONS) | set(english.AFTER_PLURALS))
    frame = pd.DataFrame({"w": words})  # noqa: F841
    got = dict(duckdb.sql(f"WITH {english_sql.stems('SELECT w FROM frame')} SELECT w, term FROM stems").fetchall())
    assert got == {w: english.stem(w) for w in words}


def test_phrases_keep_the_places_of_stop_words(spark):
    texts = ["The King of Spain", "king spain", "kings of the spains", "Spain, of king", "the kings of Spain and more", "king of spa", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def found(query, analyser="english"):
        terms = retrieval.ANALYSERS[analyser](F.col("t"))
        return sorted(r.id for r in docs.withColumn("terms", terms).where(retrieval.matches(F.col("terms"), retrieval.parse_query(query, analyser))).collect())

    assert retrieval.parse_query('"the king of spain and"', "english").any_of == [[["king", None, "spain"]]]
    assert found('"king of spain"') == [0, 4]
    assert found('"king of the spain"') == [2]
    assert found('"king spain"') == [1]
    assert found("king spain") == [0, 1, 2, 3, 4]
    assert found('king -"king of spain"') == [1, 2, 3, 5]
    assert found('"king of spain"', "simple") == [0]
    assert found('"of the"') == []


def test_words_of_few_texts_are_python_objects_at_a_time(monkeypatch):
    """A batch of many texts: what is held beside Arrow's buffers does not grow with the batch; slices, null, empty and long texts come out as one by one."""
    import tracemalloc

    import pyarrow as pa

    text = "The kings of Spain were walking beside rivers and castles " * 40
    held = []
    for n in (100, 1600):
        tracemalloc.start()
        out = list(english.lexemes.func(iter([pa.array([text] * n)])))
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(out) == 1 and len(out[0]) == n and out[0][0] == out[0][n - 1]
    assert held[1] < 40_000_000 and held[1] < 8 * held[0]
    texts = [None, "", "the of", "Kings of Spain", text, None, "running river", text * 3]
    one = [english.analyse(t or "", {}) for t in texts]
    monkeypatch.setattr(english, "SLICE_BYTES", 30)
    got = next(english.lexemes.func(iter([pa.array(texts)]))).to_pylist()
    assert got == [[{"term": w, "place": k} for w, k in zip(*row, strict=True)] for row in one]
    assert next(english.terms_of.func(iter([pa.array(texts)]))).to_pylist() == [None if t is None else row[0] for t, row in zip(texts, one, strict=True)]
    assert next(english.lexemes.func(iter([pa.array([], pa.string())]))).to_pylist() == []


def test_a_search_cuts_each_text_once(spark):
    """However many phrases a query has."""
    docs = spark.range(3).selectExpr("id", "concat('the king of spain ', id) AS t")
    query = retrieval.parse_query('the king or from -are "of spain" spain')
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    made = retrieval.text_match(docs, query, "t", ["id"])
    assert made.count() == 3 and plan(made).count("split(") == 1
    assert plan(docs.where(retrieval.matches(retrieval.simple_terms(F.col("t")), query))).count("split(") == 1


def test_words_without_ends_are_their_own_stems():
    """No step changes a word that `stem` lets through at once."""
    rnd = random.Random(9)
    words = {"".join(rnd.choices("abcdeghiklmnorstuyz", k=rnd.randrange(3, 9))) for _ in range(20000)}
    through = [w for w in words if not w.endswith(english.ENDS)]
    assert len(through) > 1000
    for word in through:
        starts = (0, *english.regions(word))
        assert english.stem(word) == word == english.verbs(english.plurals(word), starts[1]) == english.last_letters(word, starts)
        assert all(english.by_rules(word, rules, starts) == word for rules in english.STEPS)
