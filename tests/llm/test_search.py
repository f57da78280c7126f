"""Ranked lexical search against every document and term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect
from oracle import rows as frame_rows
from plain import lower

from wharfline.llm import lexical_search, queries
from wharfline.llm.oracles import ORACLE_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top=50):
    terms = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms, df = len(terms), sum(sum(c.values()) for _, c in terms), Counter(t for _, c in terms for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall(lower(text or "")))
    out = []
    for item, mine in asked.items():
        scores = []
        for doc, c in terms:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if t in c)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, k + 1, doc, -score) for k, (score, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(rnd, n, words=60):
    text = lambda most: " ".join(rnd.choice(["w", "W", "é", "x-", "7"]) + str(int(rnd.paretovariate(0.7)) % words) for _ in range(rnd.randrange(most)))
    return [(k * 37 % 5003, text(120)) for k in range(n)], [(k, text(40)) for k in range(25)]


EDGES = [(6000, None), (6001, ""), (6002, ";;; --"), (6003, "w1"), (6003, "w1"), (6003, "w1 w2"), (None, "w1 w2 w3"), (6004, "W1,w2.É" * 3000), (6005, "ß_ß[]`{}~\x7f"), (6006, "x" * 3000 + " w1")]


@pytest.fixture
def benchmark(spark):
    from pyspark.sql import functions as F

    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string").repartition(2).withColumns({"doc_id": F.lit(1), "term": F.lit("t"), "rank": F.lit("r")})

    return make


@pytest.mark.parametrize(("tile", "group"), [(512, 1 << 18), (7, 1 << 18), (16, 60)])
def test_random_documents(table, benchmark, tile, group):
    docs, items = corpus(random.Random(1), 400)
    docs += EDGES
    items += [(90, None), (91, "--"), (92, "nobody says this"), (3, "w5 w6 extra"), (None, "w1"), (93, " ".join(f"w{k}" for k in range(60)))]
    made = lexical_search.search(table(docs, 6), benchmark(items), group_terms=group, tile_terms=tile)
    assert got(made) == plain(docs, items)


def test_ties_at_the_last_rank(table, benchmark):
    """Many documents of equal score in several tasks: the least ids are ranked."""
    docs = [(k * 7919 % 1000, f"same words here{k % 2}") for k in range(1000)]
    items = [(1, "same"), (2, "words here1"), (3, "here0 here1")]
    assert got(lexical_search.search(table(docs, 8), benchmark(items), top=20)) == plain(docs, items, 20)


def test_given_tables(spark, sf, documents):
    made = queries.op13_search(spark, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(made) == plain(documents, items)
    assert frame_rows(made.toPandas()) == frame_rows(connect(sf).sql(ORACLE_SQL["op13_search"]).df())


def test_empty_tables(table, benchmark):
    assert got(lexical_search.search(table([]), benchmark([(1, "w1")]))) == []
    assert got(lexical_search.search(table([(1, "w1")]), benchmark([]))) == []
    assert got(lexical_search.search(table([(1, None)]), benchmark([(1, "w1")]))) == []


def test_sums_stay_exact():
    """As many of the largest products as a tile may have are below 2^53, and one tile more is not assumed to be."""
    for n in (1, 1000, 10**12):
        worst = lexical_search.weight(n, 0) * 10**6
        assert lexical_search.exact_terms(n) * worst < 2**53
    items = [(0, list(range(50))), (1, [3, 70]), (2, [])]
    tiles = lexical_search.tiles_of(items, 20)
    assert all(len(t) <= 20 for t, _, _ in tiles)
    cells = sorted((rows[r], terms[c]) for terms, rows, found in tiles for r, c in found)
    assert cells == sorted((k, t) for k, mine in items for t in mine)


def test_long_texts_in_pieces():
    text = ("Ab1 c" * 300 + "é" * 100 + " x").encode()
    whole = [t for t in text.translate(lexical_search.FOLD).split()]
    for size in (3, 50, 10**6):
        assert [t for piece in lexical_search.terms_of(text, size) for t in piece] == whole
    assert np.array_equal(lexical_search.best(np.array([0, 5, 3, 5, 5]), np.array([1, 9, 2, 4, 8]), 2), [3, 4])
