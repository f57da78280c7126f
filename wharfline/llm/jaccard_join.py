"""Similarity self-join of documents on word 5-grams, Jaccard 0.8 or more, with adaptive multi-match prefixes.

1. `shingled`: each document's set of shingle hashes, its size and a key of the whole set (node); documents with equal
   sets are one node from here on, so copies cost no pairs. The same pass counts, in a sketch, how many
   documents hold the shingles of each cell; the sketch orders all shingles, rare cells first, ties by hash.
2. `prefixes`: if two sets have Jaccard 0.8, the l rarest shingles that they share lie in both sets' prefixes of
   size - ceil(0.8 size) + l. Each document takes the l of least estimated cost: what its postings cost to send, and what the
   candidates cost to verify that share l of them. A pair must share the lesser l of both to be verified.
3. `shared`: postings by shingle, sorted; one streaming pass drops shingles of a single node.
4. Of each shingle's nodes the one that has it earliest in its order is verified against the others first. In a group of near
   copies that is the one with the fewest words of its own, so the group becomes one component through about a pair a document.
5. Then pairs of nodes in different components are verified: every link between components is found, so the components are exact. A
   pair is made only at a shingle that can be the first one common to both: what lies before it is not shared, so the overlap is at
   most the shorter rest (`can_link`). One more bound drops most near misses before they become rows: two sets differ in
   at least as many shingles as the parity signatures (SIGNATURE bits) of both differ in bits.

Verification compares whole sets, from whole texts. Shingles are compared by 64-bit hashes, whole sets by two of them.

Scale: postings (28 bytes) and the texts of candidates by id are what is shuffled. The sketch is the only thing broadcast: 1 MB,
4 MB at most (`sketch_bits`). Where a cell stands for very many shingles, only those held by more documents than the noise of
a cell stand out, and those are the ones that must come last. Postings of frequent shingles are dealt by node too, so a
shingle that a third of all documents hold fills no single task. Links, components and sets stay distributed. What remains
quadratic at worst: sets that all lie just beyond the threshold from each other and pass both bounds.

Defined results: no words or null text: an empty set, linked with nothing. A null id: n_shingles as usual, component null,
linked with nothing. Rows that repeat an id are one document each with their own sets and get the least id reached. Repeated rows
give repeated rows. A very long text is a block of its own, whole. Equal costs take the shorter prefix, equal places the lesser node;
neither changes the result. An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, written
from wharfline.llm.components import components
from wharfline.llm.suffix_dedup import mix, piece_hash, prefix_hashes

SHINGLE = 5
#: The threshold as a fraction, 80 / 100.
NUMERATOR, DENOMINATOR = 4, 5
#: What verifying a candidate costs, in postings.
VERIFY_COST = 20
CELL_BITS, MOST_CELL_BITS = 18, 20
SLICES = 256
#: Shingles that by the sketch so many other documents hold are dealt over SALTS keys.
FREQUENT = 4000
SALTS = 1024
SIGNATURE = 512
BLOCK_BYTES = 2 << 20
PAIR_BYTES = 4 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, and each text's distinct shingle hashes in ascending order, end to end."""
    joined = b" ".join([t.translate(LOWER) for t in texts]) + b" "
    data = np.frombuffer(joined, np.uint8)
    gap = SPACE[data]
    edge = np.diff(np.r_[True, gap].astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = mix(piece_hash(prefix_hashes(data), start, stop) + (stop - start).astype(np.uint64)) if len(start) else np.empty(0, np.uint64)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    first = np.searchsorted(start, begins)  # of each text's words
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(word) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += word[k : k + n] * WEIGHTS[k]
    whole = owner[:n] == owner[SHINGLE - 1 :] if n else np.empty(0, bool)
    hashes, owners = [mix(total[whole])], [owner[:n][whole]]
    for t in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        mine = word[first[t] : first[t + 1]]
        hashes.append(mix((mine * WEIGHTS[: len(mine)]).sum(keepdims=True) + np.uint64(len(mine))))
        owners.append(np.array([t]))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.empty(0, bool)
    h, o = h[new], o[new]
    return np.searchsorted(o, np.arange(len(texts) + 1)), h


def node_keys(offsets: np.ndarray, hashes: np.ndarray, twice: Collection[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A key of each whole set (0: empty) and a second, independent one. Keys in twice, which different sets have, are taken together with the second."""
    size = np.diff(offsets).astype(np.uint64)

    def key(tag: int) -> np.ndarray:
        sums = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(tag)))]
        k = mix(sums[offsets[1:]] - sums[offsets[:-1]] + size * WEIGHTS[0]).view(np.int64)
        return np.where(size == 0, 0, np.where(k == 0, 1, k))

    one, two = key(0x2545F4914F6CDD1D), key(0x9E6C63D0876A9A47)
    return (np.where(np.isin(one, list(twice)), one ^ two, one) if twice else one), two


def signatures(offsets: np.ndarray, hashes: np.ndarray) -> list[list[int]]:
    """For each set SIGNATURE bits, in longs: whether an odd number of its shingles fall on a bit."""
    size = np.diff(offsets)
    out = []
    for a in range(0, len(size), 2000):
        b = min(a + 2000, len(size))
        mine = hashes[offsets[a] : offsets[b]]
        place = np.repeat(np.arange(b - a), size[a:b]) * SIGNATURE + (mine >> np.uint64(17) & np.uint64(SIGNATURE - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=(b - a) * SIGNATURE) & 1).astype(np.uint8)
        out += np.packbits(odd.reshape(b - a, SIGNATURE), axis=1).view(np.int64).tolist()
    return out


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list[bytes], list]]:
    """Texts (null: empty) and ids, some limit bytes at a time."""
    texts, ids, size = [], [], 0
    for batch in batches:
        for text, i in zip(batch.column("text").cast(pa.binary()), batch.column("id").to_pylist(), strict=True):
            data = text.as_py() or b""
            if texts and size + len(data) > limit:
                yield texts, ids
                texts, ids, size = [], [], 0
            texts.append(data)
            ids.append(i)
            size += len(data)
    if texts:
        yield texts, ids


def sketch_bits(rows: int) -> int:
    """Bits of a cell's number: as many cells as rows, within bounds."""
    return min(max(rows.bit_length(), CELL_BITS), MOST_CELL_BITS)


def shingled(texts: DataFrame, bits: int) -> DataFrame:
    """Of texts (id, text): rows (id, node, other, n, signature), and each task's sketch as rows (slice, counts)."""
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("signature", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        none = lambda n: [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        for block, ids in text_blocks(batches):
            offsets, hashes = shingle_sets(block)
            nodes, other = node_keys(offsets, hashes)
            size = np.diff(offsets)
            _, once = np.unique(nodes, return_index=True)
            counted = np.zeros(len(block), bool)
            counted[once] = True
            sketch += np.bincount((hashes[np.repeat(counted, size)] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes), pa.array(other), pa.array(size), pa.array(signatures(offsets, hashes), pa.list_(pa.int64())), *none(len(block))], schema=schema)
        parts = [p.tobytes() for p in np.split(sketch, SLICES)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 4, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return map_arrow(texts, run, "id long, node long, other long, n long, signature array<long>, slice int, counts binary")


def sketch_of(rows: DataFrame, bits: int) -> np.ndarray:
    """All tasks' sketches added up: 4 bytes a cell, whatever the corpus."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                new = np.frombuffer(counts.as_py(), np.uint32).astype(np.uint64)
                total[k] = total[k] + new if k in total else new
        yield pa.RecordBatch.from_pydict({"slice": list(total), "counts": [np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in total.values()]}, schema=schema)

    summed = np.zeros((SLICES, (1 << bits) // SLICES), np.uint32)
    for row in map_arrow(rows.where("slice is not null").select("slice", "counts").repartition("slice"), run, "slice int, counts binary").toLocalIterator():
        summed[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    return summed.ravel()


def choose_matches(size: np.ndarray, offsets: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set its l and the length of its l-prefix; others: estimated other holders of each shingle, rare first."""
    owner = np.repeat(np.arange(len(size)), size)
    need = -(-size * NUMERATOR // DENOMINATOR)
    sums = np.cumsum(others)
    met = sums - np.r_[0.0, sums][offsets[:-1]][owner]
    place = np.arange(len(others)) - offsets[owner]
    wanted = place + 1 - (size - need)[owner]  # l, if the prefix ends here
    cost = np.where(wanted > 0, place + 1 + met * (1 + VERIFY_COST / np.maximum(wanted, 1)), np.inf)
    some = np.flatnonzero(size > 0)
    matches, length = np.ones(len(size), np.int64), np.zeros(len(size), np.int64)
    if len(some):
        low = np.full(len(size), np.inf)
        low[some] = np.minimum.reduceat(cost, offsets[:-1][some])
        at = np.flatnonzero(cost == low[owner])
        whose, first = np.unique(owner[at], return_index=True)
        matches[whose], length[whose] = wanted[at[first]], place[at[first]] + 1
    return matches, length


POSTINGS = "shingle long, node long, n int, place int, matches int, salt int"
POSTING_TYPES = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("matches", pa.int32()), ("salt", pa.int32())])


def prefixes(texts: DataFrame, sketch: np.ndarray, twice: Collection[int] = (), frequent: int = FREQUENT) -> DataFrame:
    """Postings of each set's prefix: shingle, node, n, the shingle's place in the set's order, the set's l, and a salt other than 0 for frequent shingles.
    Sets under 4 shingles can only equal others and have none."""
    sent = texts.sparkSession.sparkContext.broadcast(sketch)
    bits = len(sketch).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        noise = np.median(counts)
        for block, _ in text_blocks(batches):
            offsets, hashes = shingle_sets(block)
            nodes, size = node_keys(offsets, hashes, twice)[0], np.diff(offsets)
            cell = counts[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
            owner = np.repeat(np.arange(len(block)), size)
            order = np.lexsort((hashes, cell, owner))
            others = np.maximum(cell[order].astype(np.float64) - noise - 1, 0)
            matches, length = choose_matches(size, offsets, others)
            once = np.zeros(len(block), bool)
            once[np.unique(nodes, return_index=True)[1]] = True
            place = np.arange(len(hashes)) - offsets[owner]
            use = (place < length[owner]) & (once & (size >= NUMERATOR))[owner]
            mine = owner[use]
            salt = np.where(others[use] >= frequent, 1 + (nodes[mine] & (SALTS - 1)), 0)
            columns = [hashes[order][use].view(np.int64), nodes[mine], *[x.astype(np.int32) for x in (size[mine], place[use], matches[mine], salt)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=POSTING_TYPES)

    return map_arrow(texts, run, POSTINGS)


def shared(postings: DataFrame) -> DataFrame:
    """Postings of shingles that several nodes hold, and of those that the sketch calls frequent, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, False  # the last row seen; whether it is out already, since its shingle had another node before
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if last is not None:
                columns = [np.r_[np.array([old], x.dtype), x] for old, x in zip(last, columns, strict=True)]
            s, v = columns[:2]
            fresh = np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])]
            columns = [c[fresh] for c in columns]
            s, salt = columns[0], columns[5]
            same = s[1:] == s[:-1]
            many = np.r_[False, same] | np.r_[same, False] | (salt > 0)
            shown = many.copy()
            if last is not None and out:
                shown[0] = False
            if shown.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[shown]) for c in columns], schema=POSTING_TYPES)
            out = bool(many[-1]) or (len(s) == 1 and out)
            last = [c[-1] for c in columns]

    ordered = postings.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node")
    return map_arrow(ordered, run, POSTINGS).drop("salt")


def can_link(a: str, b: str) -> str:
    """Of two sides (n, place) of the first common shingle: J >= 4/5 asks for an overlap of 4/9 of both sizes together, and from the shingle on
    no more than the shorter rest is common."""
    return f"least(n_{a} - place_{a}, n_{b} - place_{b}) * {NUMERATOR + DENOMINATOR} >= (n_{a} + n_{b}) * {NUMERATOR}"


def verified(pairs: DataFrame, ids: DataFrame, texts: DataFrame, twice: Collection[int] = ()) -> DataFrame:
    """The pairs (a, b) of nodes that link. ids: (node, id of one document with it)."""
    one = lambda side: ids.select(F.col("node").alias(side), F.col("id").alias(f"{side}_id"))
    named = pairs.join(one("a"), "a").join(one("b"), "b")
    text = lambda side: texts.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
    full = named.join(text("a"), "a_id").join(text("b"), "b_id").select("a", "b", "a_text", "b_text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        for _, _, x, y in rows:
            known.setdefault(x, len(known))
            known.setdefault(y, len(known))
        offsets, hashes = shingle_sets(list(known))
        nodes, _ = node_keys(offsets, hashes, twice)
        linked = []
        for a, b, x, y in rows:
            i, j = known[x], known[y]
            if nodes[i] != a or nodes[j] != b:  # another row with the same id
                continue
            p, q = hashes[offsets[i] : offsets[i + 1]], hashes[offsets[j] : offsets[j + 1]]
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            if both * DENOMINATOR >= NUMERATOR * (len(p) + len(q) - both):
                linked.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in linked], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())]
            for a, b, x, y in zip(*columns, strict=True):
                x, y = x.as_py(), y.as_py()
                rows.append((a, b, x, y))
                size += len(x) + len(y)
                if size >= PAIR_BYTES:
                    yield settle(rows)
                    rows, size = [], 0
        if rows:
            yield settle(rows)

    return map_arrow(full, run, "a long, b long").distinct()


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id_col, n_shingles, component_id): documents linked directly or through others have the same component_id, the least id."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = sketch_bits(texts.count())
    first = written(shingled(texts, bits), "shingled")
    sets = first.where("slice is null and id is not null and n > 0")
    # 64 bits tell all but a handful of sets apart, whatever the corpus: what comes to the driver is that handful
    twice = {r["node"] for r in sets.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low != high").select("node").toLocalIterator()}
    if twice:
        sets = sets.withColumn("node", F.when(F.col("node").isin(sorted(twice)), F.col("node").bitwiseXOR(F.col("other"))).otherwise(F.col("node")))
    nodes = written(sets.groupBy("node").agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "nodes")
    ids = nodes.select("node", "id")
    known = texts.where("id is not null and text is not null")
    postings = written(shared(prefixes(known, sketch_of(first, bits), twice, frequent)), "postings")

    sides = ("node", "n", "place")
    best = postings.groupBy("shingle").agg(F.min(F.struct((F.col("place") / F.col("n")).alias("part"), *sides)).alias("h"))
    star = postings.withColumnsRenamed({c: f"{c}_x" for c in sides}).join(best.select("shingle", *[F.col(f"h.{c}").alias(f"{c}_h") for c in sides]), "shingle")
    star = star.where(f"node_h != node_x AND {can_link('h', 'x')}").select(F.greatest("node_x", "node_h").alias("a"), F.least("node_x", "node_h").alias("b"))
    near = written(sharing(written(star.distinct(), "star"), postings), "near")
    grown = components(verified(near, ids, known, twice))

    label = lambda rows, of: rows.join(of.select(F.col("node"), F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    labelled = written(label(postings, grown), "labelled")
    several = labelled.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least")).where("low < high").select("shingle", "least")
    # at this shingle the node could link with one of its own size, or with the smallest that holds the shingle
    across = labelled.join(several, "shingle").where(f"(n - place) * {NUMERATOR + DENOMINATOR} >= (n + greatest(least, n * {NUMERATOR} / {DENOMINATOR})) * {NUMERATOR}").drop("least")
    across = written(across.join(nodes.select("node", *[F.get("signature", F.lit(k)).alias(f"s{k}") for k in range(SIGNATURE // 64)]), "node"), "across")
    x, y = (across.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in across.columns if c not in ("shingle", "matches")]) for side in "xy")
    differ = " + ".join(f"bit_count(s{k}_x ^ s{k}_y)" for k in range(SIGNATURE // 64))
    met = x.join(y, "shingle").where(f"node_x > node_y AND c_x != c_y AND {can_link('x', 'y')} AND ({differ}) * {NUMERATOR + DENOMINATOR} <= n_x + n_y")
    pairs = written(met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct().join(near, ["a", "b"], "left_anti"), "pairs")
    more = verified(sharing(pairs, postings), ids, known, twice)
    # links between components are few, however many pairs they rest on
    between = label(more.select(F.col("a").alias("node"), F.col("b").alias("other")), grown).select(F.col("c").alias("a"), F.col("other").alias("node"))
    between = written(label(between, grown).select("a", F.col("c").alias("b")).distinct(), "between")
    joined = components(between).select(F.col("node").alias("c"), F.col("component").alias("whole"))
    placed = written(label(ids, grown).join(joined, "c", "left").select("node", "id", F.coalesce("whole", "c").alias("c")), "placed")
    least = placed.groupBy("c").agg(F.min("id").alias("component_id"))
    of_node = placed.join(least, "c").select("node", "component_id")
    linked = sets.select("id", "node", "n").join(of_node, "node").select("id", "n", "component_id")
    alone = first.where("slice is null and (id is null or n = 0)").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def sharing(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose prefixes share as many shingles as the lesser l of both."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = postings.join(ends, "node").groupBy("node", "matches").agg(F.collect_list("shingle").alias("held"))
    of = lambda side: held.select(F.col("node").alias(side), F.col("matches").alias(f"l_{side}"), F.col("held").alias(f"held_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where("size(array_intersect(held_a, held_b)) >= least(l_a, l_b)").select("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without near duplicates: of each component the document with the least id stays, with every row of that id.
    Rows without an id are left alone."""
    kept = join(df, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    out = df.join(kept, id_col, "left_semi").unionByName(df.where(F.col(id_col).isNull()))
    return out.select(*df.columns)
