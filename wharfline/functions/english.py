"""The English analyser: words with their places, stop words left out, stemmed by the Porter2 algorithm.

The stemmer's rules are one table, `STEPS`, which `stem` reads word by word, and `plans.english_sql` turns into SQL. A word is stemmed once per task: `lexemes`
is one Arrow pass with a dictionary of the words met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.functions.text import STOP_WORDS

LEXEMES = T.ArrayType(T.StructType().add("term", "string").add("place", "integer"))
WORD = re.compile("[a-z0-9]+")
#: Words of a task's dictionary.
MOST_WORDS = 1 << 17
#: Bytes of text whose words are Python objects at a time.
SLICE_BYTES = 1 << 20


class Rule(NamedTuple):
    """At the end of a word: suffix becomes by, if it begins in the region (0: anywhere) and a letter of before, if any, stands in front of it."""

    suffix: str
    by: str
    region: int
    before: str = ""


# Fixed values, of the published algorithm: vowels, prefixes with a region of their own, exceptions, and rules by step.
VOWELS = "aeiouy"
PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = (
    Rule("tional", "tion", 1), Rule("enci", "ence", 1), Rule("anci", "ance", 1), Rule("abli", "able", 1), Rule("entli", "ent", 1), Rule("izer", "ize", 1), Rule("ization", "ize", 1), Rule("ational", "ate", 1),
    Rule("ation", "ate", 1), Rule("ator", "ate", 1), Rule("alism", "al", 1), Rule("aliti", "al", 1), Rule("alli", "al", 1), Rule("fulness", "ful", 1), Rule("ousli", "ous", 1), Rule("ousness", "ous", 1),
    Rule("iveness", "ive", 1), Rule("iviti", "ive", 1), Rule("biliti", "ble", 1), Rule("bli", "ble", 1), Rule("ogi", "og", 1, "l"), Rule("fulli", "ful", 1), Rule("lessli", "less", 1), Rule("li", "", 1, "cdeghkmnrt"),
)
STEP_3 = (
    Rule("tional", "tion", 1), Rule("ational", "ate", 1), Rule("alize", "al", 1), Rule("icate", "ic", 1), Rule("iciti", "ic", 1), Rule("ical", "ic", 1), Rule("ful", "", 1), Rule("ness", "", 1), Rule("ative", "", 2),
)
STEP_4 = tuple(Rule(s, "", 2) for s in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()) + (Rule("ion", "", 2, "st"),)
STEPS = tuple(tuple(sorted(rules, key=lambda r: -len(r.suffix))) for rules in (STEP_2, STEP_3, STEP_4))
#: Of each step, to see at once that no rule fits: most words of a large vocabulary end in none.
SUFFIXES = tuple(tuple(rule.suffix for rule in rules) for rules in STEPS)
VERB_ENDS = ("eedly", "eed", "ingly", "edly", "ing", "ed")
#: A word with none of these ends is its own stem.
ENDS = tuple({"s", "ied", *VERB_ENDS, "y", "e", "ll", *(s for suffixes in SUFFIXES for s in suffixes)})

#: The region after the first letter that is no vowel and follows one; Y is a y that is no vowel.
REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
SHORT_END = re.compile(f"([^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")
VOWEL = re.compile(f"[{VOWELS}]")
NO_VOWEL = re.compile(f"(^|[{VOWELS}])y")


def regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin."""
    first = next(len(p) for p in PREFIXES if word.startswith(p)) if word.startswith(PREFIXES) else None
    if first is None:
        first = m.end() if (m := REGION.match(word)) else len(word)
    return first, m.end() if (m := REGION.match(word, first)) else len(word)


def by_rules(word: str, rules: tuple[Rule, ...], starts: tuple[int, int, int]) -> str:
    """The rule of the longest suffix that fits decides, whether it may be used or not."""
    for rule in rules:
        if word.endswith(rule.suffix):
            at = len(word) - len(rule.suffix)
            usable = at >= starts[rule.region] and (not rule.before or (at > 0 and word[at - 1] in rule.before))
            return word[:at] + rule.by if usable else word
    return word


def plurals(word: str) -> str:
    if word[-1] not in "sd":
        return word
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def verbs(word: str, first: int) -> str:
    if not word.endswith(VERB_ENDS):
        return word
    for ending in ("eedly", "eed"):
        if word.endswith(ending):
            at = len(word) - len(ending)
            return word[:at] + "ee" if at >= first else word
    ending = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
    if ending is None or not VOWEL.search(word[: -len(ending)]):
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(DOUBLES):
        return word[:-1]
    return word + "e" if len(word) <= first and SHORT_END.search(word) else word


def last_letters(word: str, starts: tuple[int, int, int]) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= starts[2] or (at >= starts[1] and not SHORT_END.search(word[:-1]))):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and at >= starts[2] else word


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if not word.endswith(ENDS):
        return word
    if "y" in word:
        word = NO_VOWEL.sub(r"\1Y", word)
    first, second = regions(word)
    word = plurals(word)
    if word in AFTER_PLURALS:
        return word
    word = verbs(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    starts = (0, first, second)
    for rules, suffixes in zip(STEPS, SUFFIXES, strict=True):
        if word.endswith(suffixes):
            word = by_rules(word, rules, starts)
    if word.endswith(("e", "ll")):
        word = last_letters(word, starts)
    return word.replace("Y", "y")


def analyse(text: str, known: dict[str, str | None]) -> tuple[list[str], list[int]]:
    """Terms and places of the words that count; places count all words from 1. known: stems so far, null for a stop word."""
    words = WORD.findall(text.lower())
    new = {w for w in words if w not in known}
    if known and len(known) + len(new) > MOST_WORDS:
        known.clear()
        new = set(words)
    for word in new:
        known[word] = None if word in STOP_WORDS else stem(word)
    found = [known[w] for w in words]
    return [t for t in found if t is not None], [k for k, t in enumerate(found, 1) if t is not None]


def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in turn, at most SLICE_BYTES together or a single text, so that Python objects are held for few words at a time, however many rows come in a batch."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(sizes)
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, upto - at).to_pylist()
        at = upto


def lists(sizes: Sequence[int] | np.ndarray, values: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    """Values end to end as lists of these sizes; null where missing."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), values, mask=pa.array(missing) if missing is not None and len(sizes) else None)


@F.arrow_udf(LEXEMES)
def lexemes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text's terms and their places; of a null text none."""
    known: dict[str, str | None] = {}
    empty = lists([], pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32())], ["term", "place"]))
    for batch in texts:
        made = [empty]
        for some in slices(batch):
            rows = [analyse(t or "", known) for t in some]
            both = [pa.array([x for row in rows for x in row[k]], kind) for k, kind in enumerate((pa.string(), pa.int32()))]
            made.append(lists([len(terms) for terms, _ in rows], pa.StructArray.from_arrays(both, ["term", "place"])))
            del rows
        yield pa.concat_arrays(made)


@F.arrow_udf(T.ArrayType(T.StringType()))
def terms_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text's terms in order; null for null."""
    known: dict[str, str | None] = {}
    for batch in texts:
        made = [lists([], pa.array([], pa.string()))]
        for some in slices(batch):
            rows = [analyse(t or "", known)[0] for t in some]
            made.append(lists([len(r) for r in rows], pa.array([x for r in rows for x in r], pa.string()), [t is None for t in some]))
            del rows
        yield pa.concat_arrays(made)
