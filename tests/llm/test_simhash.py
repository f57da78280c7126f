"""SimHash components against all pairs, and what the Golay code promises."""

import random
import re

import numpy as np
import plain
import pytest
import xxhash

from wharfline.llm import queries, simhash_dedup

EDGES = [(3000, None), (3001, ""), (3002, " \t\x0b"), (3003, "a b c"), (3004, "A  b\tC"), (3005, "x " * 4000), (3006, "ü" * 70), (None, "a b c"), (None, "nobody else says this at all")]


def brute_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", plain.lower(text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    """Rows (doc_id, fingerprint, component_id), sorted: every pair is compared."""
    prints = [brute_print(t) for _, t in docs]
    known = sorted(set(prints))
    root = {p: p for p in known}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = np.array(known, np.uint64)
    for k, p in enumerate(known):
        for q in values[np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= 4)].tolist():
            root[find(p)] = find(q)
    least = {}
    for (i, _), p in zip(docs, prints, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(docs, prints, strict=True)), key=str)


def edited(rnd, groups):
    docs = []
    for _ in range(groups):
        base = [rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(rnd.randrange(2, 200))]
        for _ in range(rnd.randrange(1, 15)):
            w = list(base)
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice("klmno")
            docs.append((len(docs) * 7 % 2003, " ".join(w)))
    return docs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_random_documents(table):
    docs = edited(random.Random(2), 60) + EDGES
    assert rows(simhash_dedup.join(table(docs))) == brute(docs)


def test_whole_table(spark, sf, documents):
    assert rows(queries.op11_simhash(spark, sf)) == brute(documents)


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_clouds_of_fingerprints(spark, most, monkeypatch):
    """Thousands of fingerprints within 12 bits of one another, and chains of just four and just five bits; crowded keys take the linear way."""
    rnd = random.Random(4)
    prints = []
    for _ in range(3):
        base = rnd.getrandbits(64)
        for _ in range(400 if most > 3 else 60):
            p = base
            for b in rnd.sample(range(64), rnd.randrange(7)):
                p ^= 1 << b
            prints.append(p)
        at = base ^ rnd.getrandbits(64)
        for step in (4, 4, 4, 5, 4, 5, 5):
            for b in rnd.sample(range(64), step):
                at ^= 1 << b
            prints.append(at)
    docs = [(k, f"{p:016x}") for k, p in enumerate(prints)]
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda df, *_: df.selectExpr("doc_id AS id", "cast(conv(text, 16, -10) AS long) AS print"))
    monkeypatch.setitem(globals(), "brute_print", lambda text: int(text, 16))
    made = simhash_dedup.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), most=most)
    assert rows(made) == brute(docs)


def test_code_and_keys():
    """The code is perfect, and any two words that differ in four bits share a key."""
    decoder = simhash_dedup.Decoder()
    words = np.arange(1 << 23)
    code = words[decoder.syndrome(words) == 0]
    assert len(code) == 4096 and min(int(c).bit_count() for c in code[1:]) == 7
    some = np.random.default_rng(1).integers(0, 1 << 23, 300)
    near = decoder.near(some)
    assert set((near >= 0).sum(axis=1).tolist()) == {1, 6}
    for w, found in zip(some.tolist(), near.tolist(), strict=True):
        assert sorted(n for n in found if n >= 0) == [k for k, c in enumerate(code.tolist()) if (c ^ w).bit_count() <= 4]
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    two = one.copy()
    for k in range(len(two)):
        for b in rng.choice(64, 4, replace=False):
            two[k] ^= np.uint64(1) << np.uint64(b)
    (a, at), (b, bt) = simhash_dedup.fuzzy_keys(one, decoder), simhash_dedup.fuzzy_keys(two, decoder)
    shared = set(zip(a.tolist(), at.tolist(), strict=True)) & set(zip(b.tolist(), bt.tolist(), strict=True))
    assert {k for _, k in shared} == set(range(3000))


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(5)
    for text in ("".join(rnd.choice("ab \t") for _ in range(5000)), "x" * 3000 + " y z " + "w" * 2000, " " * 4000 + "a b c", "a b c d" * 900):
        for size in (7, 64, 1000):
            whole = [w for piece in simhash_dedup.pieces(text.encode(), size) for w in piece]
            assert whole == text.encode().split()
            monkeypatch.setattr(simhash_dedup, "pieces", lambda t, size=size, real=simhash_dedup.pieces: real(t, size))
            assert simhash_dedup.fingerprint(text.encode()) == brute_print(text)
            monkeypatch.undo()


def test_repeats_empty_tables_and_keep_one(spark, table):
    docs = [(5, "one two three four five"), (5, "one two three four five"), (2, "one two three four five"), (9, "quite another text that stands alone"), (None, "one two three four five")]
    assert rows(simhash_dedup.join(table(docs))) == brute(docs)
    kept = simhash_dedup.keep_one(table(docs))
    assert kept.columns == table(docs).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 9] and kept.count() == 3
    assert simhash_dedup.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
