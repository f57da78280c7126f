"""Near-duplicate detection by 64-bit SimHash fingerprints that differ in at most four bits, found by Golay-code fuzzy hashing.

1. `fingerprints`: a document's words (runs without white space, A-Z lower-cased) give 4-word shingles, repeats included; a bit of the
   fingerprint is 1 if it is set in over half of their XXH64 hashes. Equal fingerprints are one node from here on, so exact copies, and
   near copies that the fingerprint does not tell apart, cost nothing more.
2. `fuzzy_keys`: a fingerprint is cut into three segments (22, 21 and 21 bits). The binary Golay code of length 23 is perfect: each segment, padded
   with zeros, lies within 3 bits of one codeword, and within 4 bits of that one alone or of six. Two segments that differ in at most two bits
   always have a codeword within 4 bits of both: if the first one is within 2 bits of its codeword, the other is within 4; else the word half the way
   between them is within 3 bits of its own codeword, and both are one bit further away at most.
3. Pigeonhole: of four differing bits either no segment has more than two, so all three share a codeword (a key of 36 bits), or one
   segment has three or more, so one of the others is equal and the last differs in one bit at most (a key of 21 to 23 bits and a codeword).
   Both together are some 180 keys a fingerprint, and as a key has 33 bits or more, few fingerprints meet by chance.
4. `links`: the fingerprints of a key are verified against each other in blocks, breadth first: what has been reached is compared with what has not, so a
   cloud of near copies costs little more than a comparison each, and what leaves the task is a spanning forest, not pairs.
5. A key that more than MOST fingerprints hold is not gathered. Its fingerprints take an exact way that is linear in their number: two
   fingerprints are within four bits if and only if some word is within two bits of both, so each is sent to all 2081 words around it,
   and those that meet are linked.
6. Components of the links by star contraction; each document gets the least id of its component.

Scale: texts are read once and never shuffled. Shuffled are 16 bytes a key of a distinct fingerprint. Nothing is broadcast or brought to the driver;
a task holds at most MOST fingerprints (8 bytes each) of a key at a time.

Defined results: null text or no words: fingerprint zero, linked like any other; fewer than four words: the whole sequence is the shingle. A null id: its
fingerprint takes part in links but is no one's component; a component without any id has a null one. Rows that repeat an id are documents of their
own. Repeated rows give repeated rows. A very long text is read whole, PIECE_BYTES at a time. Nothing depends on the order of rows. An empty
table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, written
from wharfline.llm.components import components

SHINGLE = 4
HASH_SEED = 42
DISTANCE = 4
#: Bits of the three segments, from the lowest bit on.
SEGMENTS = (22, 21, 21)
#: A codeword is 12 bits of data above 11 of check.
CODE_BITS, CHECK_BITS, CODE_RADIUS = 23, 11, 3
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GENERATOR = 0b101011100011
PIECE_BYTES = 1 << 20
MOST = 1 << 16
BLOCK = 1 << 22
#: Documents whose distinct fingerprints one task makes keys of: some 180 keys each.
TASK_ROWS = 100_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = b" \t\n\x0b\x0c\r"


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, some size bytes at a time."""
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and text[stop] not in SPACE:
            cut = [text.find(bytes([c]), stop, stop + size) for c in SPACE]
            found = min((c for c in cut if c >= 0), default=-1)
            stop = found if found >= 0 else min(stop + size, len(text))
        yield text[at:stop].translate(LOWER).split()
        at = stop


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's shingles, in order."""
    before: list[bytes] = []
    short = True
    for words in pieces(text):
        words = before + words
        if len(words) < SHINGLE:
            before = words
            continue
        joined = b" ".join(words)
        stops = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, stops[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), stops[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
        before, short = words[1 - SHINGLE :], False
    if short and before:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), HASH_SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bits that are set in over half of the shingles' hashes; 0 without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text):
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): print as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], schema=schema)

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, print long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All words of so many bits with at most radius ones."""
    words = [np.zeros(1, np.int64)]
    for _ in range(radius):
        words.append(np.unique((words[-1][:, None] | (1 << np.arange(bits))).ravel()))
    return np.unique(np.concatenate(words))


def remainders() -> np.ndarray:
    """For each value of a word's high 12 bits what the word, its low 11 bits zero, leaves when divided by the generator polynomial. A word is a codeword if it leaves nothing."""
    left = np.arange(1 << (CODE_BITS - CHECK_BITS)) << CHECK_BITS
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - CHECK_BITS)), left)
    return left


class Decoder:
    """Codewords near words: from a word's syndrome, through a table, the errors of at most CODE_RADIUS + 1 bits that may have made it."""

    def __init__(self) -> None:
        self.left = remainders()
        errors = ball(CODE_BITS, CODE_RADIUS + 1)
        syndrome = self.syndrome(errors)
        order = np.argsort(syndrome, kind="stable")
        place = np.arange(len(errors)) - np.searchsorted(syndrome[order], syndrome[order])
        self.errors = np.full((1 << CHECK_BITS, 6), -1)
        self.errors[syndrome[order], place] = errors[order]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.left[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))

    def near(self, words: np.ndarray) -> np.ndarray:
        """For each word the numbers of the codewords within CODE_RADIUS + 1, which are their high 12 bits: one or six, the rest of the row is -1."""
        errors = self.errors[self.syndrome(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)


def segments(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in SEGMENTS:
        out.append((prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    return out


def fuzzy_keys(prints: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the fingerprint that has it). The kind of a key is in its highest bits: 0 for three codewords, 1 to 6 for an equal segment and a codeword."""
    parts = segments(prints)
    codes = [decoder.near(p) for p in parts]
    owner = np.arange(len(prints))
    keys, owners = [], []
    for i in range(6):
        for j in range(6):
            for k in range(6):
                ok = (codes[0][:, i] >= 0) & (codes[1][:, j] >= 0) & (codes[2][:, k] >= 0)
                keys.append((codes[0][:, i] << 24 | codes[1][:, j] << 12 | codes[2][:, k])[ok])
                owners.append(owner[ok])
    kind = 0
    for equal in range(3):
        for other in range(3):
            if other == equal:
                continue
            kind += 1
            for i in range(6):
                ok = codes[other][:, i] >= 0
                keys.append((kind << 40 | parts[equal] << 12 | codes[other][:, i])[ok])
                owners.append(owner[ok])
    return np.concatenate(keys), np.concatenate(owners)


def keyed(prints: DataFrame) -> DataFrame:
    """Of distinct prints: rows (key, print)."""
    schema = pa.schema([("key", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder()
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 1000):
                mine = values[at : at + 1000]
                keys, owner = fuzzy_keys(mine.view(np.uint64), decoder)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(mine[owner])], schema=schema)

    return map_arrow(prints, run, "key long, print long")


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join each connected group of these distinct fingerprints, under the distance, to its least one: breadth first, so
    a fingerprint is compared with those not yet reached only."""
    rest = np.sort(prints)
    a, b = [], []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            met = np.zeros(len(rest), bool)
            step = max(1, BLOCK // len(rest))
            for at in range(0, len(front), step):
                open_ = np.flatnonzero(~met)
                if not len(open_):
                    break
                met[open_[(np.bitwise_count(front[at : at + step, None] ^ rest[None, open_]) <= DISTANCE).any(axis=0)]] = True
            front, rest = rest[met], rest[~met]
            a.append(front)
            b.append(np.full(len(front), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def links(keys: DataFrame, most: int = MOST) -> DataFrame:
    """From rows (key, print): rows (a, b) of linked fingerprints, and rows (a, null) of those whose key more than most hold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = [forest(g.view(np.uint64)) for g in groups]
        if sum(len(f[0]) for f in found):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], schema=schema)

    def crowd(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64())], schema=schema)

    def twos(p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keys of two fingerprints, by far the most: rows of p."""
        near = p[np.bitwise_count(p[:, 0] ^ p[:, 1]) <= DISTANCE]
        if len(near):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (near.max(axis=1), near.min(axis=1))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n = [], None, 0  # what the last key has so far

        def add(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            held.append(part)
            n += len(part)
            if n > most:
                yield from crowd(held)
                held = []

        def end() -> Iterator[pa.RecordBatch]:
            if 1 < n <= most:
                yield from settle([np.concatenate(held)])

        for batch in batches:
            k, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            if k[0] == key:
                yield from add(p[: cuts[1]])
                cuts = cuts[1:]
            if len(cuts) < 2:
                continue
            yield from end()
            inner, size = cuts[:-2], np.diff(cuts[:-1])
            two = inner[size == 2]
            yield from twos(np.stack([p[two], p[two + 1]], axis=1).view(np.uint64))
            several = np.flatnonzero((size > 2) & (size <= most))
            yield from settle([p[cuts[x] : cuts[x + 1]] for x in several])
            yield from crowd([p[cuts[x] : cuts[x + 1]] for x in np.flatnonzero(size > most)])
            held, key, n = [], k[-1], 0
            yield from add(p[cuts[-2] :])
        yield from end()

    ordered = keys.repartition("key").sortWithinPartitions("key")
    return map_arrow(ordered, run, "a long, b long")


def around(prints: DataFrame) -> DataFrame:
    """Of distinct prints: rows (a, b) that link each with the least one it shares a word with, among all words within half the distance."""
    masks = ball(64, DISTANCE // 2)
    schema = pa.schema([("word", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 100):
                mine = values[at : at + 100]
                yield pa.RecordBatch.from_arrays([pa.array((mine[:, None] ^ masks).ravel()), pa.array(np.repeat(mine, len(masks)))], schema=schema)

    words = written(map_arrow(prints, run, "word long, print long"), "words")
    least = words.groupBy("word").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return words.join(least, "word").where("print != b").select(F.col("print").alias("a"), "b")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id_col, fingerprint, component_id): documents linked directly or through others have the same component_id, the least id."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    # a number of partitions, so that they are not joined because fingerprints are small: their keys are not
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_ROWS))
    distinct = docs.select("print").distinct().repartition(tasks, "print")
    found = written(links(keyed(distinct), most).distinct(), "links")
    crowded = found.where("b is null").select(F.col("a").alias("print"))
    pairs = found.where("b is not null")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(around(crowded))
    # tables of their own, so that the large component's rows are joined, which Spark can split, and not aggregated in the same task
    nodes = written(components(pairs), "nodes")
    ids = docs.groupBy("print").agg(F.min("id").alias("id"))
    least = written(ids.join(nodes.withColumnRenamed("node", "print"), "print").groupBy("component").agg(F.min("id").alias("component_id")), "least")
    linked = written(nodes.join(least, "component").select(F.col("node").alias("print"), "component_id"), "linked")
    alone = ids.join(linked, "print", "left_anti").select("print", F.col("id").alias("component_id"))
    of_print = written(linked.unionByName(alone), "of_print")
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return docs.join(of_print, "print").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without near duplicates: of each component the document with the least id stays, with every row of that id.
    Rows without an id are left alone."""
    kept = join(df, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return df.join(kept, id_col, "left_semi").unionByName(df.where(F.col(id_col).isNull())).select(*df.columns)
