"""Match positions of regular expressions as plain column expressions, in time that grows with the text and its matches.

split() gives the text between matches and regexp_extract_all() the matches; running sums of their lengths are the
positions, in code points. Patterns must mean the same in java.util.regex and never match the empty string.

No array or string grows with the matches inside a fold, which would copy it at every step: sums run within blocks of BLOCK values and over the blocks' totals
(`before_each`), and pieces of a text are cut from chunks of CHUNK code points (`cut`), since finding a place in a string takes time in its distance from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,found:string>>"
#: Values that a fold appends to one array; the totals of blocks are few (20,000 for 10 million matches) and summed in one more fold.
BLOCK = 512
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside a lambda an expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what those before it come to under combine, 0 at first."""
    zero = F.lit(0)

    def running(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("seen"))
        step = lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen"))
        return F.aggregate(block, start, step, lambda acc: acc["seen"])

    def in_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.greatest(F.floor((F.size(v) - 1) / BLOCK).cast("int"), zero)), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, lambda b: F.aggregate(b, zero, combine)), zero), running)))

    return let(values, in_blocks)


def matches(text: Column, pattern: str, keep: Callable[[Column], Column], group: int = 0, ahead: bool = False) -> Column:
    """Leftmost non-overlapping matches for which keep(group's text) holds: array of (start, stop, found), stop exclusive.

    A failing match is dropped and its text stays consumed. With ahead, the group is a lookahead's, from the start of the match: the
    span is the group, only the match is consumed, and a failing group hides none that starts after the match. Cost: three passes a pattern over texts that match.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def placed(x: Column, at: Column) -> Column:
        start, whole = at + F.length(x["gap"]), x["part"] if ahead else x["found"]
        return F.struct(start.alias("start"), (start + F.length(whole)).alias("stop"), whole.alias("found"), x["part"].alias("part"))

    def spans(p: Column) -> Column:
        places = before_each(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))), lambda a, b: a + b)
        kept = F.filter(F.zip_with(p, places, placed), lambda s: s["found"].isNotNull() & F.coalesce(keep(s["part"]), F.lit(False)))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, spans)).otherwise(F.array().cast(SPAN))


def chunks(text: Column) -> Column:
    """text in pieces of CHUNK code points."""
    return F.when(F.length(text) > CHUNK, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(text))


def cut(pieces: Column, start: Column, stop: Column) -> Column:
    """The code points from start to stop, or to the end if that comes first, of a text given as chunks()."""
    first, last = F.floor(start / CHUNK).cast("int"), F.least(F.floor((stop - 1) / CHUNK).cast("int"), F.size(pieces) - 1)
    head, tail = F.get(pieces, first), F.get(pieces, last)
    inside = start - first * CHUNK + 1
    several = F.concat(F.substring(head, inside, F.lit(CHUNK)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), stop - last * CHUNK))
    return F.when((stop <= start) | (first > last), "").when(first == last, F.substring(head, inside, stop - start)).otherwise(several)


def replaced(text: Column, spans: Column, mask: Callable[[Column], Column], order: Callable[[Column], Column]) -> Column:
    """text with mask(span) at the place of each span, once for spans that overlap: the mask is that of the first of them by order(span), which begins with the start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(order(s).alias("o"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))

    def masked(pieces: Column, s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(cut(pieces, at, s["start"]), mask(s)))

    def whole(pieces: Column, sorted_spans: Column) -> Column:
        ends = F.transform(sorted_spans, lambda s: s["stop"])
        made = F.zip_with(sorted_spans, before_each(ends, lambda a, b: F.greatest(a, b)), lambda s, at: masked(pieces, s, at))
        rest = cut(pieces, F.array_max(ends), F.size(pieces) * CHUNK)
        return F.array_join(F.concat(F.filter(made, lambda p: p.isNotNull()), F.array(rest)), "")

    return F.when(F.size(spans) > 0, let(chunks(text), lambda pieces: let(ordered, lambda s: whole(pieces, s)))).otherwise(text)


def joined(spans: Column, order: Callable[[Column], Column]) -> Column:
    """kind:start:stop of an array of structs, sorted by order(), joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(order(s).alias("o"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
