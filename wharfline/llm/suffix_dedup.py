"""Removal of repeated byte strings by a suffix sort whose comparisons go through prefix hashes.

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id. Steps:

1. `anchor_rows`, map-only. In every LENGTH-byte string the GRAM-byte piece with the least hash (the leftmost of equals) is an
   anchor: equal strings have equal anchors at the same place. A text has an anchor every 17 bytes or so. Of anchors whose whole
   surroundings are equal, those of a block of texts are settled at once against the smallest id (bytes compared), as ranges of
   bytes; only that one's travels on. So exact copies and the inside of common passages send a row for each block, not for each text.
2. `shared`: anchors sorted by piece and surroundings (64-bit hashes of both); a streaming pass settles those whose surroundings
   a smaller id has, and keeps, of pieces with different surroundings, one anchor of each.
3. `surroundings`: the kept anchors meet their texts once more and bring the bytes around them.
4. `repeated_strings`, by piece: suffixes from the anchor to the right, and from it to the left, are sorted by a mergesort
   that compares two of them by a binary search over prefix polynomial hashes; common extensions of neighbours are then
   compared byte by byte, so a collision can neither hide nor make a match. Strings that have an anchor at the same
   place are equal where both extensions are long enough; of each such class all but the smallest id's are marked.
   Pieces with more than LARGE anchors, whose group no task should hold, go another way: `by_strings` names every string around them,
   and the smallest id of each comes from an aggregation that map tasks combine.
5. `dedup`: the ranges meet the texts, and the marked bytes go.

Scale: what is shuffled is 40 bytes an anchor once, the surroundings of shared anchors, and the texts by document. A task holds
CHUNK anchors of small groups, or one group of LARGE at most; no group is larger, whatever a passage's edges look like.

Defined results: null text is no bytes. A null id counts as larger than every other, and rows with equal ids (repeated rows among
them) never remove from each other. Texts shorter than LENGTH keep every byte; very long ones are a block of their own. Of equal anchors in one
text each counts. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, text_or_empty, written

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM  # the most bytes of a string before its anchor
BLOCK_BYTES = 2 << 20
CHUNK = 30_000
LARGE = 100_000
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Rows without an id have ids from here on, drawn from their texts; none of those is smaller than another.
NULL_ID = (1 << 63) - (1 << 31)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        _powers[base] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
    return _powers[base][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the differences of low bits over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i] is the sum of (byte + 1) * BASE ** place over the first i bytes."""
    return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[:-1])]


def piece_hash(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of the bytes from start to stop, wherever they stand."""
    return (hashes[stop] - hashes[start]) * powers(INVERSE, len(hashes) - 1)[start]


def find_anchors(data: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the anchors; stops[i] is where the text of byte i ends."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64)
    low = np.uint64((1 << max(26, n.bit_length())) - 1)
    gram = mix((hashes[GRAM:] - hashes[:-GRAM]) * powers(INVERSE, n)[: n - GRAM + 1])
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, wanted = 1, SPAN + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: -(wanted - width)], least[wanted - width :])
    at = np.arange(len(least))
    chosen = np.zeros(n, bool)
    chosen[(least[at + LENGTH <= stops[: len(least)]] & low).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def whole_range(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of what the LENGTH-byte strings over an anchor cover that fit in left bytes before and right bytes from it."""
    return at - np.minimum(left, SPAN), at - np.maximum(0, LENGTH - right) + LENGTH


def anchors_of_block(texts: list[bytes], ids: np.ndarray, keys: np.ndarray) -> tuple[tuple, tuple]:
    """Open anchors (gram, around, id, place, -right), and settled ranges (id, place, stop). A place is key * 2 ** 32 + position."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes = prefix_hashes(data)
    at = find_anchors(data, starts[1:][owner], hashes)
    doc = owner[at]
    left, right = np.minimum(at - starts[doc], SPAN), np.minimum(starts[doc + 1] - at, LENGTH)
    around = mix(piece_hash(hashes, at - left, at + right) + (left * 64 + right).astype(np.uint64)).view(np.int64)
    gram = mix(piece_hash(hashes, at, at + GRAM)).view(np.int64)
    settled = np.zeros(len(at), bool)
    if len(at):
        rank = np.minimum(ids[doc], NULL_ID)
        order = np.lexsort((rank, around))
        new = np.r_[True, around[order][1:] != around[order][:-1]]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = rank[order] > rank[lead]
        mine, first = order[later], lead[later]
        reach = np.arange(SPAN + LENGTH)
        for a in range(0, len(mine), 1 << 16):
            x, y = mine[a : a + (1 << 16)], first[a : a + (1 << 16)]
            place = lambda k: data[np.minimum((at - left)[k][:, None] + reach, len(data) - 1)]
            same = ((place(x) == place(y)) | (reach >= (left + right)[x][:, None])).all(axis=1)
            settled[x[same & (left[x] == left[y]) & (right[x] == right[y])]] = True
    position = at - starts[doc]
    on = np.flatnonzero(settled)
    start, stop = whole_range(position[on], left[on], right[on])
    fresh = np.r_[True, (doc[on][1:] != doc[on][:-1]) | (start[1:] > stop[:-1])] if len(on) else np.empty(0, bool)
    begins = np.flatnonzero(fresh)
    ends = np.r_[begins[1:], len(on)] - 1 if len(on) else begins
    d = doc[on][begins]
    high = keys.astype(np.int64) << 32
    free = ~settled
    return (gram[free], around[free], ids[doc][free], (high[doc] | position)[free], -right[free]), (ids[d], high[d] | start[begins], stop[ends])


ANCHORS = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("stop", pa.int32())])
ANCHOR_COLUMNS = "gram long, around long, id long, place long, stop int"
#: Of `shared`: stop is where a settled range stops, or, with a gram, minus the bytes from the anchor on.
KEPT = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("stop", pa.int32())])
KEPT_COLUMNS = "gram long, id long, place long, stop int"


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    texts, ids, keys, size = [], [], [], 0
    for batch in batches:
        for text, i, key in zip(batch.column("text").cast(pa.binary()), batch.column("id").to_pylist(), batch.column("key").to_pylist(), strict=True):
            data = text.as_py()
            if texts and size + len(data) > limit:
                yield texts, np.array(ids), np.array(keys)
                texts, ids, keys, size = [], [], [], 0
            texts.append(data)
            ids.append(i)
            keys.append(key)
            size += len(data)
    if texts:
        yield texts, np.array(ids), np.array(keys)


def anchor_rows(texts: DataFrame) -> DataFrame:
    """Of texts (id, key, text). A settled range needs no gram; it gets a hash of its own, which spreads such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, BLOCK_BYTES):
            anchors, (ids, place, stop) = anchors_of_block(*block)
            own = mix((place * 31 + ids).astype(np.uint64)).view(np.int64)
            columns = [np.r_[a, b] for a, b in zip(anchors, (own, own, ids, place, stop), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k == 4 else c) for k, c in enumerate(columns)], schema=ANCHORS)

    return map_arrow(texts, run, ANCHOR_COLUMNS)


def settle_sorted(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pass over anchors (gram, around, id, place, stop) sorted by the first three: rows (gram, id, place, stop) to keep.

    What is held between batches: the open gram's anchors of one document, until a second document and other surroundings show.
    """
    gram = around = leader = first = None  # of the row before: its gram and surroundings, their least id, and the gram's first id
    several = apart = False  # whether the gram has several surroundings; several documents
    held: list[tuple] = []
    for g, a, i, p, s in batches:
        if not len(g):
            continue
        new_gram = np.r_[g[0] != gram, g[1:] != g[:-1]]
        new_run = new_gram | np.r_[a[0] != around, a[1:] != a[:-1]]
        at = np.maximum.accumulate(np.where(new_run, np.arange(len(g)), -1))
        least = np.where(at < 0, i[0] if leader is None else leader, i[at])
        late = np.minimum(i, NULL_ID) > np.minimum(least, NULL_ID)
        segment = np.cumsum(new_gram)  # 0: the open gram goes on
        n = int(segment[-1]) + 1
        begins = np.maximum.accumulate(np.where(new_gram, np.arange(len(g)), -1))
        first_id = np.where(begins < 0, i[0] if first is None else first, i[begins])
        many = np.bincount(segment[new_run & ~new_gram], minlength=n) > 0
        differ = np.bincount(segment[np.minimum(i, NULL_ID) != np.minimum(first_id, NULL_ID)], minlength=n) > 0
        many[0] |= several
        differ[0] |= apart
        need = many & differ
        if held and (need[0] or n > 1):
            if need[0]:
                yield from held
            held = []
        reps = ~late
        out = reps & need[segment]
        wait = reps & (segment == n - 1) & ~need[-1]
        yield g[out], i[out], p[out], s[out]
        if late.any():
            position, right = p[late] & 0xFFFFFFFF, -s[late].astype(np.int64)
            start, stop = whole_range(position, np.minimum(position, SPAN), right)
            yield g[late], i[late], (p[late] >> 32 << 32) | start, stop.astype(np.int32)
        if wait.any():
            held.append((g[wait], i[wait], p[wait], s[wait]))
        gram, around, leader, first = g[-1], a[-1], least[-1], first_id[-1]
        several, apart = bool(many[-1]), bool(differ[-1])


def shared(anchors: DataFrame) -> DataFrame:
    """Settled ranges, and one anchor of each surroundings of a gram that has different ones in different documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=KEPT)

        def anchors_only() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                g, a, i, p, s = (batch.column(k).to_numpy() for k in range(5))
                done = s >= 0
                if done.any():
                    waiting.append(made((g[done], i[done], p[done], s[done])))
                yield tuple(x[~done] for x in (g, a, i, p, s))

        for rows in settle_sorted(anchors_only()):
            yield from waiting
            waiting.clear()
            if len(rows[0]):
                yield made(rows)
        yield from waiting

    dealt = anchors.repartition("gram").sortWithinPartitions("gram", "around", "id")
    return map_arrow(dealt, run, KEPT_COLUMNS)


def by_document(rows: DataFrame, **lists: Column) -> DataFrame:
    """(id, key, lists..): the rows (id, place, ..) of each document in arrays, as many as its text has anchors at most."""
    split = rows.withColumn("key", F.shiftright("place", 32).cast("int")).withColumn("at", F.col("place").bitwiseAND(0xFFFFFFFF))
    return split.groupBy("id", "key").agg(*[F.collect_list(c).alias(n) for n, c in lists.items()])


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a column of lists, and their values end to end."""
    return np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))], column.flatten().to_numpy(zero_copy_only=False)


AROUND = "gram long, id long, place long, left int, around binary"
AROUND_ROWS = 20_000


def surroundings(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(gram, id, place, left, around): the bytes around each anchor, left of them before it."""
    schema = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("left", pa.int32()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([*[pa.array(np.concatenate([h[k] for h in held])) for k in range(4)], pa.array([x for h in held for x in h[4]], pa.binary())], schema=schema)
        for batch in batches:
            (offsets, at), (_, gram) = listed(batch.column("ats")), listed(batch.column("grams"))
            ids, keys, texts = batch.column("id").to_numpy(), batch.column("key").to_numpy().astype(np.int64), batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                mine = at[offsets[k] : offsets[k + 1]]
                data, left = texts[k].as_py(), np.minimum(mine, SPAN)
                around = [data[p:q] for p, q in zip((mine - left).tolist(), (mine + LENGTH).tolist(), strict=True)]
                held.append((gram[offsets[k] : offsets[k + 1]], np.full(len(mine), ids[k]), keys[k] << 32 | mine, left.astype(np.int32), around))
                size += len(mine)
                if size >= AROUND_ROWS:
                    yield made()
                    held, size = [], 0
        if size:
            yield made()

    asked = by_document(anchors, ats=F.col("at"), grams=F.col("gram"))
    return map_arrow(texts.join(asked, ["id", "key"]).select("id", "key", "text", "ats", "grams"), run, AROUND)


def common(hashes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How long the common extension of suffixes x and y is, by binary search over their prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), hashes.shape[1] - 1)
    for _ in range(int(hashes.shape[1]).bit_length()):
        middle = (low + high + 1) >> 1
        same = hashes[x, middle] == hashes[y, middle]
        low, high = np.where(same, middle, low), np.where(same, high, np.minimum(middle - 1, high))
        high = np.maximum(high, low)
    return low


def suffix_sort(signs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes (rows of signs, 0 after the end) within their groups, which are contiguous: a bottom-up mergesort
    in which all pairs of runs of all groups merge at once; an element's place is its own rank plus its rank in the other run."""
    n, width = signs.shape
    hashes = np.zeros((n, width + 1), np.uint64)
    for k in range(width):
        hashes[:, k + 1] = hashes[:, k] * np.uint64(BASE) + signs[:, k]
    padded = np.c_[signs, np.zeros(n, signs.dtype)]
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[new, n])
    start, size = np.repeat(new, sizes), np.repeat(sizes, sizes)
    order, run = np.arange(n), 1
    while run < sizes.max():
        rank = np.arange(n) - start
        pair = rank // (2 * run) * 2 * run
        second = rank - pair >= run
        active = np.flatnonzero((size > run) & (pair + run < size))
        own = start + pair + np.where(second, run, 0)
        low = start + np.where(second, pair, pair + run)
        high = np.minimum(low + run, start + size)
        base, low, high = low[active].copy(), low[active], high[active]
        me, after = order[active], second[active]
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            x, y = me[todo], order[middle]
            at = common(hashes, x, y)
            gap = padded[y, at].astype(np.int32) - padded[x, at]
            before = (gap < 0) | (after[todo] & (gap == 0))
            low[todo] = np.where(before, middle + 1, low[todo])
            high[todo] = np.where(before, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        placed = order.copy()
        placed[(start + pair)[active] + (active - own[active]) + (low - base)] = me
        order, run = placed, run * 2
    return order


def extensions(signs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order, and how many signs each shares with the one before it (-1: another group), compared byte by byte."""
    order = suffix_sort(signs, group)
    for again in (False, True):
        here, before = signs[order[1:]], signs[order[:-1]]
        differ = here != before
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), signs.shape[1])
        at = np.minimum(length, signs.shape[1] - 1)[:, None]
        wrong = (np.take_along_axis(here, at, 1) < np.take_along_axis(before, at, 1)).ravel() & (group[order[1:]] == group[order[:-1]])
        if again or not wrong.any():
            break
        order = np.array(sorted(range(len(signs)), key=lambda i: (group[i], signs[i].tolist())))  # hashes have collided
    return order, np.r_[-1, np.where(group[order[1:]] == group[order[:-1]], length, -1)]


def repeated_bits(group: np.ndarray, ids: np.ndarray, left: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each anchor, sorted by group and id: bit j if its string from j before it is also an anchor's of a smaller id. Anchor k's surroundings
    are data[offsets[k]:offsets[k + 1]]."""
    n = len(ids)
    at, right = offsets[:-1] + left, np.diff(offsets) - left
    last = len(data) - 1
    reach = np.arange(LENGTH)
    forward = np.where(reach < right[:, None], data[np.minimum(at[:, None] + reach, last)].astype(np.uint16) + 1, 0).astype(np.uint16)
    back = np.arange(SPAN)
    backward = np.where(back < left[:, None], data[np.maximum(at[:, None] - 1 - back, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)
    ahead, shared_ahead = extensions(forward, group)
    behind, shared_behind = extensions(backward, group)
    bits = np.zeros(n, np.int64)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(SPAN + 1):
        a[ahead] = np.cumsum(shared_ahead < LENGTH - j)
        b[behind] = np.cumsum(shared_behind < j)
        fits = np.flatnonzero((right >= LENGTH - j) & (left >= j))
        if len(fits) < 2:
            continue
        string = a[fits] * (n + 1) + b[fits]
        order = np.argsort(string, kind="stable")
        new = np.r_[True, string[order][1:] != string[order][:-1]]
        least = ids[fits[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = fits[order][ids[fits[order]] > least]
        bits[later] |= np.int64(1) << j
    return bits


def bit_ranges(at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop): for each run of set bits what its strings cover."""
    on = (bits[:, None] >> np.arange(SPAN + 2) & 1).astype(np.int8)
    edge = np.diff(on, axis=1, prepend=0)
    row, low = np.nonzero(edge == 1)
    _, over = np.nonzero(edge == -1)
    return row, at[row] - (over - 1), at[row] - low + LENGTH


def repeated_strings(around: DataFrame) -> DataFrame:
    """(id, place, stop): ranges that repeat what a smaller id has; the anchors of one gram in one chunk."""
    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("stop", pa.int32())])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids, place = rows.column("id").to_numpy(), rows.column("place").to_numpy()
        binary = rows.column("around").chunk(0)
        offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
        bits = repeated_bits(rows.column("gram").to_numpy(), np.minimum(ids, NULL_ID), rows.column("left").to_numpy().astype(np.int64), np.frombuffer(binary.buffers()[2], np.uint8), offsets)
        row, start, stop = bit_ranges(place & 0xFFFFFFFF, bits)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((place[row] >> 32 << 32) | start), pa.array(stop.astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                rows = pa.Table.from_batches(held)
                gram = rows.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield settle(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size -= cut
        if size:
            yield settle(pa.Table.from_batches(held))

    return map_arrow(around.repartition("gram").sortWithinPartitions("gram", "id"), run, "id long, place long, stop int")


def by_strings(around: DataFrame) -> DataFrame:
    """What repeated_strings gives, without gathering a gram's anchors: every string is a key of its own."""
    schema = pa.schema([("string", pa.binary()), ("id", pa.int64()), ("place", pa.int64()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, place, left, data in zip(*(batch.column(n).to_pylist() for n in ("id", "place", "left", "around")), strict=True):
                starts = range(len(data) - LENGTH + 1)
                base = place - left
                at = (place & 0xFFFFFFFF) - left
                yield pa.RecordBatch.from_arrays(
                    [pa.array([data[k : k + LENGTH] for k in starts], pa.binary()), pa.array([i] * len(starts), pa.int64()), pa.array([base + k for k in starts], pa.int64()), pa.array([at + k + LENGTH for k in starts], pa.int32())],
                    schema=schema,
                )

    strings = map_arrow(around.select("id", "place", "left", "around"), run, "string binary, id long, place long, stop int")
    least = strings.groupBy("string").agg(F.min("id").alias("first"))
    return strings.join(least, "string").where(f"least(id, {NULL_ID}) > least(first, {NULL_ID})").select("id", "place", "stop")


def covered(size: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of size bytes the ranges cover."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    return np.cumsum(change[:size]) > 0


RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True, large: int = LARGE) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is what stays of each text's bytes."""
    # a text is told from others of its id by 31 bits of its hash, and one without an id by 62
    rows = df.select(F.col(id_col).alias("own"), text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    bits = F.shiftright("hash", 31).bitwiseAND(0x7FFFFFFF)
    texts = rows.select("own", F.coalesce(F.col("own").cast("long"), F.lit(NULL_ID) + bits).alias("id"), F.col("hash").bitwiseAND(0x7FFFFFFF).cast("int").alias("key"), "text")
    kept = written(shared(anchor_rows(texts.where(F.octet_length("text") >= LENGTH).select("id", "key", "text"))), "anchors")
    anchors = kept.where("stop < 0")
    crowded = written(anchors.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > large).select("gram"), "crowded")
    ranges = repeated_strings(surroundings(texts, anchors.join(crowded, "gram", "left_anti")))
    if not crowded.isEmpty():
        ranges = ranges.unionByName(by_strings(surroundings(texts, anchors.join(crowded, "gram", "left_semi"))))
    found = written(ranges, "ranges")
    marks = by_document(found.unionByName(kept.where("stop >= 0").select("id", "place", "stop")), ranges=F.shiftleft("at", 32).bitwiseOR(F.col("stop").cast("long")))
    fields = [f for f in RESULT if with_bytes or f[0] != "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, ranges = listed(batch.column("ranges"))
            out = []
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                data = text.as_py()
                if offsets[k + 1] > offsets[k]:
                    mine = ranges[offsets[k] : offsets[k + 1]].astype(np.int64)
                    gone = covered(len(data), mine >> 32, mine & 0xFFFFFFFF)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                else:
                    kept, spans = data, 0
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([batch.column("own").cast(pa.int64()), *[pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)]], names=[id_col, *[n for n, _ in fields]])

    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return map_arrow(texts.join(marks, ["id", "key"], "left").select("own", "text", "ranges"), run, schema)
