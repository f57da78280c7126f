"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts and items are normalised once, byte by byte, and become sequences of word numbers. A window is WINDOW words of an item, or all of a shorter
one. Every window holds one of the pieces of half its length that begin at multiples of that length, so the automaton has those pieces
as patterns: a few nodes a word of the benchmark, not one for each letter of each window. A word's number is written in digits of base 64, since the
automaton looks through a node's children one by one. Each text is scanned once; where a piece
occurs, the words beside it are compared with the item's, and runs of a window's length or more are hits. They map back to the
words of the original. Nothing is shuffled: the corpus streams through map tasks.

The benchmark is sent in blocks of at most BLOCK_BYTES of its words, one pass over the corpus a block, so what a task
holds is bounded however large the benchmark is; an item beyond that is cut into parts that share all but one word of a window. The usual
benchmark is one block.

Defined results: null or wordless text has no words and no hits; null or wordless items and items without an id have no windows;
repeated items count once; items with the same window are all counted; repeated documents give repeated rows; very long texts are
read whole; an empty table gives an empty result or no hits. Extra columns are left alone.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: One byte to one byte, so offsets stay: A-Z to a-z, ASCII that is no letter or digit to a space; bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


#: A piece at more places than this, such as a phrase that many items begin with, is not compared with what stands beside each of them: the windows around it are looked up.
MANY = 32
BASE = 64
#: Digits begin at the third character: the first is what stands for unknown words, the second for the end of an item.
UNKNOWN, END, ZERO = "\0", "\1", 2


class Automaton:
    """Over a block of (item id, words); words are joined by spaces. Finds runs of words that windows of the items cover."""

    def __init__(self, block: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.window, self.piece = window, (window + 1) // 2
        self.code: dict[bytes, str] = dict.fromkeys(w for _, line in block for w in line.split())
        self.width = 1
        while BASE**self.width < len(self.code):
            self.width += 1
        for n, w in enumerate(self.code):
            self.code[w] = "".join(chr(ZERO + n // BASE**k % BASE) for k in range(self.width))
        self.ids: list[str] = []
        self.short: dict[str, tuple[int, list[str]]] = {}  # by code: length, ids
        lines, starts, places, at = [], [], defaultdict(lambda: array("q")), 0
        for item, line in block:
            w = line.split()
            if len(w) < window:
                self.short.setdefault(self.coded(w), (len(w), []))[1].append(item)
                continue
            text = self.coded(w) + END * self.width
            for k in range(0, len(w) - self.piece + 1, self.piece):
                places[text[k * self.width : (k + self.piece) * self.width]].append(at + k)
            lines.append(text)
            starts.append(at)
            self.ids.append(item)
            at += len(w) + 1
        self.flat, self.starts = END * self.width + "".join(lines) + END * self.width, np.array(starts, np.int64)
        self.windows: dict[str, set[int]] = defaultdict(set)  # those around pieces of more than MANY places: the items that have them
        stops = [*starts[1:], at]
        for key, found in places.items():
            if len(found) > MANY:
                for p in found:
                    item = int(np.searchsorted(self.starts, p, "right")) - 1
                    for start in range(max(starts[item], p - window + self.piece), min(p, stops[item] - 1 - window) + 1):
                        self.windows[self.flat[(start + 1) * self.width : (start + 1 + window) * self.width]].add(item)
                places[key] = None
        self.found = ahocorasick.Automaton()
        for key in {**places, **self.short}:
            self.found.add_word(key, (key if key in self.short else None, places.get(key, ())))
        if len(self.found):
            self.found.make_automaton()

    def coded(self, w: list[bytes]) -> str:
        return "".join([self.code.get(x, UNKNOWN * self.width) for x in w])

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [first, last) of words, which may overlap, and the items whose windows occur."""
        if not len(self.found):
            return [], set()
        text, flat, width = self.coded(w), self.flat, self.width
        runs, items, seen, beside = [], set(), set(), self.window - self.piece
        for at, (short, places) in self.found.iter(text):
            end, rest = divmod(at + 1, width)
            if rest:
                continue
            if short is not None:
                n, ids = self.short[short]
                runs.append((end - n, end))
                items.update(ids)
            begin = end - self.piece
            if places is None:
                for first in range(max(0, begin - beside), min(begin, len(w) - self.window) + 1):
                    code = text[first * width : (first + self.window) * width]
                    if code in self.windows:
                        runs.append((first, first + self.window))
                        if code not in seen:
                            seen.add(code)
                            items.update(self.ids[i] for i in self.windows[code])
                continue
            for p in places:
                left = right = 0
                # flat begins with an END, so its word p has place p + 1
                while left < beside and left < begin and text[(begin - left - 1) * width : (begin - left) * width] == flat[(p - left) * width : (p - left + 1) * width]:
                    left += 1
                while right < beside and end + right < len(w) and text[(end + right) * width : (end + right + 1) * width] == flat[(p + self.piece + right + 1) * width : (p + self.piece + right + 2) * width]:
                    right += 1
                if left + self.piece + right >= self.window:
                    runs.append((begin - left, end + right))
                    items.add(self.ids[int(np.searchsorted(self.starts, p, "right")) - 1])
        return runs, items


def in_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items as (id, words), some block_bytes at a time; the driver never holds more than a block and one item."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct().toLocalIterator():
        for part in parts_of(words(row.t), window, block_bytes):
            if block and size + len(part) > block_bytes:
                yield block
                block, size = [], 0
            block.append((row.i, part))
            size += len(part)
    if block:
        yield block


def parts_of(w: list[bytes], window: int, most_bytes: int) -> Iterator[bytes]:
    """The words joined, in parts of some most_bytes (of a window at least) so that each window lies within one."""
    at = 0
    while at == 0 and w or at + window <= len(w):
        stop, size = min(at + window, len(w)), sum(len(x) + 1 for x in w[at : at + window])
        while stop < len(w) and size + len(w[stop]) < most_bytes:
            size += len(w[stop]) + 1
            stop += 1
        yield b" ".join(w[at:stop])
        at = stop - window + 1 if stop < len(w) else len(w)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_runs (runs of hit words, [first, last)) and hit_items (sorted ids); columns of those names are replaced."""
    spark = docs.sparkSession
    seen = 0
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit_runs": F.array().cast("array<struct<first:long,last:long>>"), "hit_items": F.array().cast("array<string>")})
    for block in chain(in_blocks(benchmark, item_col, item_text, block_bytes, window), [[]]):
        if not block and seen:
            break
        seen += 1
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = Automaton(sent.value, window)
            for batch in batches:
                runs, ids, counts = [], [], []
                before = batch.column("hit_runs").to_pylist(), batch.column("hit_items").to_pylist()
                for text, old_runs, old_ids in zip(batch.column(text_col), *before, strict=True):
                    w = words(text.as_py())
                    new, items = found.hits(w)
                    runs.append(merged([(r["first"], r["last"]) for r in old_runs] + new))
                    ids.append(sorted({*old_ids, *items}))
                    counts.append(len(w))
                new_columns = {"n_words": pa.array(counts, pa.int64()), "hit_runs": pa.array(runs, batch.schema.field("hit_runs").type), "hit_items": pa.array(ids, batch.schema.field("hit_items").type)}
                yield pa.RecordBatch.from_arrays([new_columns.get(name, batch.column(k)) for k, name in enumerate(batch.schema.names)], schema=batch.schema)

        out = map_arrow(out, scan, out.schema)
    return out


def merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, stop) in the original of runs of words."""
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    at = [m.span() for m in WORD.finditer(lower)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns, whatever those are called."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return find_overlaps(packed, benchmark, **options).where(F.size("hit_runs") == 0).select("row.*")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )

