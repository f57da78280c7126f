"""The English analyser's rules in DuckDB's SQL: distinct words go through the stemmer's steps, a common table expression each."""

from __future__ import annotations

from wharfline.functions import english as e
from wharfline.functions.text import STOP_WORDS

V = e.VOWELS
SHORT = f"([^{V}][{V}][^{V}wxY]|^[{V}][^{V}])$"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _ends(x: str, endings) -> str:
    return "(" + " OR ".join(f"suffix({x}, '{w}')" for w in endings) + ")"


def _rules(x: str, rules) -> str:
    out = []
    for r in rules:
        n = len(r.suffix)
        usable = [f"length({x}) - {n} >= r{r.region}"] + ([f"contains('{r.before}', substr({x}, length({x}) - {n}, 1)) AND length({x}) > {n}"] if r.before else [])
        out.append(f"WHEN suffix({x}, '{r.suffix}') THEN CASE WHEN {' AND '.join(usable)} THEN left({x}, length({x}) - {n}) || '{r.by}' ELSE {x} END")
    return f"CASE {' '.join(out)} ELSE {x} END"


def stems(words: str) -> str:
    """CTEs up to stems (w, term), of a query that gives distinct words w."""
    first = " ".join(f"WHEN starts_with(x, '{p}') THEN {len(p)}" for p in e.PREFIXES)
    region = f"[^{V}]*[{V}]+[^{V}]"
    verb = f"""CASE WHEN suffix(x, 'eedly') THEN CASE WHEN length(x) - 5 >= r1 THEN left(x, length(x) - 3) ELSE x END WHEN suffix(x, 'eed') THEN CASE WHEN length(x) - 3 >= r1 THEN left(x, length(x) - 1) ELSE x END ELSE x END"""
    return f"""v0 AS ({words}), v1 AS (SELECT w, regexp_replace(w, '(^|[{V}])y', '\\1Y', 'g') AS x FROM v0),
v2 AS (SELECT w, x, CASE {first} ELSE CASE WHEN regexp_matches(x, '^{region}') THEN length(regexp_extract(x, '^{region}')) ELSE length(x) END END AS r1 FROM v1),
v3 AS (SELECT w, x, r1, CASE WHEN regexp_matches(substr(x, r1 + 1), '^{region}') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '^{region}')) ELSE length(x) END AS r2 FROM v2),
v4 AS (SELECT w, r1, r2, CASE WHEN suffix(x, 'sses') THEN left(x, length(x) - 2) WHEN {_ends('x', ('ied', 'ies'))} THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
  WHEN suffix(x, 's') AND NOT {_ends('x', ('us', 'ss'))} AND regexp_matches(left(x, greatest(length(x) - 2, 0)), '[{V}]') THEN left(x, length(x) - 1) ELSE x END AS x FROM v3),
v5 AS (SELECT w, r1, r2, x, CASE WHEN {_ends('x', ('eedly', 'eed'))} THEN NULL WHEN suffix(x, 'ingly') THEN 5 WHEN suffix(x, 'edly') THEN 4 WHEN suffix(x, 'ing') THEN 3 WHEN suffix(x, 'ed') THEN 2 END AS n FROM v4),
v6 AS (SELECT w, r1, r2, n IS NOT NULL AND regexp_matches(left(x, length(x) - n), '[{V}]') AS cut, CASE WHEN n IS NOT NULL AND regexp_matches(left(x, length(x) - n), '[{V}]') THEN left(x, length(x) - n) ELSE {verb} END AS x, x AS plural FROM v5),
v7 AS (SELECT w, r1, r2, plural, CASE WHEN NOT cut THEN x WHEN {_ends('x', ('at', 'bl', 'iz'))} THEN x || 'e' WHEN {_ends('x', e.DOUBLES)} THEN left(x, length(x) - 1) WHEN length(x) <= r1 AND regexp_matches(x, '{SHORT}') THEN x || 'e' ELSE x END AS x FROM v6),
v8 AS (SELECT w, r1, r2, plural, CASE WHEN length(x) > 2 AND regexp_matches(x, '[^{V}][yY]$') THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM v7),
v9 AS (SELECT w, r1, r2, plural, {_rules('x', e.STEPS[0])} AS x FROM v8), v10 AS (SELECT w, r1, r2, plural, {_rules('x', e.STEPS[1])} AS x FROM v9), v11 AS (SELECT w, r1, r2, plural, {_rules('x', e.STEPS[2])} AS x FROM v10),
v12 AS (SELECT w, plural, CASE WHEN suffix(x, 'e') AND (length(x) - 1 >= r2 OR (length(x) - 1 >= r1 AND NOT regexp_matches(left(x, length(x) - 1), '{SHORT}'))) THEN left(x, length(x) - 1)
  WHEN suffix(x, 'll') AND length(x) - 1 >= r2 THEN left(x, length(x) - 1) ELSE x END AS x FROM v11),
stems AS (SELECT w, CASE w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in e.EXCEPTIONS.items())} ELSE CASE WHEN length(w) < 3 THEN w WHEN plural IN ({_in(e.AFTER_PLURALS)}) THEN plural ELSE replace(x, 'Y', 'y') END END AS term FROM v12)"""


def lexemes(rows: str, key: str, column: str) -> str:
    """CTEs up to lexed (key, terms, places) for every row of rows; lists in order, empty without a term that counts."""
    return f"""words AS (SELECT {key}, unnest(list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda t: t <> '')) AS w, generate_subscripts(list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda t: t <> ''), 1) AS place FROM {rows}),
{stems(f"SELECT DISTINCT w FROM words WHERE w NOT IN ({_in(STOP_WORDS)})")},
lexed AS (SELECT r.{key}, coalesce(l.terms, []) AS terms, coalesce(l.places, []) AS places FROM {rows} r LEFT JOIN (SELECT {key}, list(term ORDER BY place) AS terms, list(place ORDER BY place) AS places FROM words JOIN stems USING (w) GROUP BY {key}) l USING ({key}))"""
