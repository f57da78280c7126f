"""Near copies and repeated strings against plain versions."""

import random

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wharfline.llm import components, jaccard_join, queries, suffix_dedup


def edited(rnd, groups, most_words=80, copies=20, edits=4):
    docs = []
    for _ in range(groups):
        base = [rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(rnd.randrange(3, most_words))]
        for _ in range(rnd.randrange(1, copies)):
            w = list(base)
            for _ in range(rnd.randrange(0, edits)):
                w[rnd.randrange(len(w))] = rnd.choice("klmno")
            docs.append((len(docs) * 7 % 1009, " ".join(w)))
    return docs


EDGES = [(2000, None), (2001, ""), (2002, "  "), (2003, "a b c"), (2004, "A  b\tC"), (2005, "x " * 4000), (2006, "x " * 4100)]


def test_jaccard_random(table):
    docs = edited(random.Random(3), 18) + EDGES
    got = jaccard_join.join(table(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard(docs)
    assert len(got) == len(docs)


def test_jaccard_group_around_the_threshold(table):
    """One base, copies with more and more edits: the chain links far ones through near ones."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for n in range(60):
        w = list(base)
        for k in range(n % 12):
            w[rnd.randrange(150)] = f"e{n}-{k}"
        docs.append((n, " ".join(w)))
    got = jaccard_join.join(table(docs, 5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard(docs)


def test_jaccard_large_group_makes_few_pairs(spark, monkeypatch):
    """3,000 copies of one base around the threshold, many of them beyond it: the components are right, and few pairs are verified."""
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for n in range(3000):
        w = list(base)
        for k in range(n % 14):
            w[rnd.randrange(150)] = f"e{rnd.randrange(40)}"
        docs.append((n, " ".join(w)))
    asked = []
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    number: dict = {}
    sets = [np.array(sorted(number.setdefault(x, len(number)) for x in plain.shingles(t))) for _, t in docs]
    held = [[] for _ in number]
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    held, size, root = [np.array(h) for h in held], np.array([len(s) for s in sets]), np.arange(3000)
    for i, s in enumerate(sets):
        both = np.bincount(np.concatenate([held[x] for x in s]), minlength=3000)
        near = np.flatnonzero((both > 0) & (100 * both >= 80 * (size + len(s) - both)))
        joined = np.isin(root, root[near])
        root[joined] = root[joined].min()
    assert got == {i: (len(s), int(root[i])) for i, s in enumerate(sets)}
    assert sum(asked) < 5 * len(docs)


def test_jaccard_frequent_shingles_are_dealt_out(table):
    docs = edited(random.Random(8), 12) + EDGES
    got = jaccard_join.join(table(docs), frequent=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard(docs)


def test_jaccard_sets_with_equal_first_keys(table, monkeypatch):
    """With keys of two bits, sets are told apart by the second key."""
    keys = jaccard_join.node_keys

    def few(offsets, hashes, twice=()):
        one, two = keys(offsets, hashes)
        one = np.where(one == 0, 0, (one & 3) + 1)
        return np.where(np.isin(one, list(twice)), one ^ two, one), two

    monkeypatch.setattr(jaccard_join, "node_keys", few)
    docs = edited(random.Random(9), 8) + EDGES
    got = jaccard_join.join(table(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard(docs)


def test_jaccard_repeated_rows_and_null_ids(table):
    text = " ".join(map(str, range(30)))
    got = sorted(map(tuple, jaccard_join.join(table([(5, text), (5, text), (3, text), (None, text), (None, None), (7, text + " z")])).collect()), key=str)
    assert got == sorted([(5, 26, 3), (5, 26, 3), (3, 26, 3), (None, 26, None), (None, 0, None), (7, 27, 3)], key=str)


def test_jaccard_on_documents(spark, sf, documents):
    got = queries.op2_jaccard(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard(documents)


def test_keep_one(table):
    docs = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words here"), (4, None), (None, "a b c d e f g")]
    kept = jaccard_join.keep_one(table(docs))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]
    assert kept.columns == table(docs).columns


def test_longer_prefixes_for_dear_candidates():
    size, offsets = np.array([50, 50]), np.array([0, 50, 100])
    matches, length = jaccard_join.choose_matches(size, offsets, np.r_[np.zeros(50), np.full(50, 1000.0)])
    assert matches.tolist()[0] == 1 and matches.tolist()[1] > 1
    assert (length == 10 + matches).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 4, 0])
def test_repeats_random(table, large):
    rnd = random.Random(1)
    pool = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(10, 120))) for _ in range(30)]
    docs = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 6))) + rnd.choice(["", "é", "aaaa" * 40, "ab" * 60])) for i in range(200)] + [(1000, ""), (1001, None)]
    got = suffix_dedup.dedup(table(docs), with_bytes=False, large=large).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain.repeats(docs)


def test_repeats_one_letter_and_edges(table):
    docs = [(i, "x" * n) for i, n in enumerate([0, 49, 50, 51, 120, 60, 200, 50])] + [(100, "y" * 70), (101, "z" + "y" * 70), (102, "a" * 49 + "é")]
    got = suffix_dedup.dedup(table(docs)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == plain.repeats(docs)
    assert all(plain.sha(bytes(r.kept)) == r.kept_sha256 for r in got)


def test_repeats_equal_and_null_ids(table):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(90))
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.dedup(table([(4, text), (4, text), (None, text), (None, text + "!")])).collect()), key=str)
    assert got == [(4, 0), (4, 0), (None, 90), (None, 90)]


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 0])
def test_repeats_many_null_ids(spark, large):
    """Rows without an id lose what rows with one have, never to each other, each at its own places; extra columns have clashing names."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(60, 200))) for _ in range(20)]
    docs = [(3, texts[0] + texts[1]), (9, texts[2])] + [(None, "x" * k + texts[k % 20] + texts[(k + 1) % 20]) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name in ("id", "key", "own", "hash", "gram", "place"):
        df = df.selectExpr("*", f"'x' as {name}")
    got = suffix_dedup.dedup(df, with_bytes=False, large=large).collect()
    wanted = plain.repeats([(10**6 if d is None else d, t) for d, t in docs[:2]])
    kept = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is None)
    one = [plain.repeats([*docs[:2], (10**6, t)])[10**6] for d, t in docs[2:]]
    assert kept == sorted(one)
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == wanted


def test_repeats_on_documents(spark, sf, documents):
    got = queries.op7_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain.repeats(documents)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=7), min_size=1, max_size=24), st.randoms())
def test_suffix_sort(rows, rnd):
    signs = np.zeros((len(rows), 8), np.uint16)
    for k, r in enumerate(rows):
        signs[k, : len(r)] = np.array(r) + 1
    group = np.sort(np.array([rnd.randrange(3) for _ in rows]))
    order, shared = suffix_dedup.extensions(signs, group)
    keys = [(group[i], signs[i].tolist()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, len(rows)):
        a, b = signs[order[k - 1]], signs[order[k]]
        assert shared[k] == (-1 if group[order[k - 1]] != group[order[k]] else next((i for i in range(8) if a[i] != b[i]), 8))


def test_collisions_are_noticed(monkeypatch):
    """With hashes that tell nothing apart, comparisons byte by byte put the order right."""
    monkeypatch.setattr(suffix_dedup, "common", lambda hashes, x, y: np.zeros(len(x), np.int64))
    signs = np.array([[2, 1, 3], [2, 1, 1], [2, 0, 0], [1, 9, 9]], np.uint16)
    order, _ = suffix_dedup.extensions(signs, np.zeros(4, np.int64))
    assert order.tolist() == [3, 2, 1, 0]


def test_streaming_pass_does_not_depend_on_batches():
    rnd = random.Random(4)
    rows = sorted((rnd.randrange(6), rnd.randrange(3), rnd.randrange(4), rnd.randrange(100), -50) for _ in range(200))
    columns = [np.array(c) for c in zip(*rows, strict=True)]

    def through(cuts):
        parts = [tuple(c[a:b] for c in columns) for a, b in zip([0, *cuts], [*cuts, 200], strict=True)]
        return sorted(x for out in suffix_dedup.settle_sorted(iter(parts)) for x in zip(*(c.tolist() for c in out), strict=True))

    assert through([]) == through([50, 51, 120]) == through(list(range(1, 200)))


def test_empty_tables(table):
    assert jaccard_join.join(table([])).count() == 0
    assert suffix_dedup.dedup(table([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 100])
def test_bit_ranges(n):
    bits = np.array([0b1, 0b0110, 0b101], np.int64)
    row, start, stop = suffix_dedup.bit_ranges(np.array([n + 10] * 3), bits)
    assert list(zip(row.tolist(), (start - n).tolist(), (stop - n).tolist(), strict=True)) == [(0, 10, 60), (1, 8, 59), (2, 10, 60), (2, 8, 58)]
