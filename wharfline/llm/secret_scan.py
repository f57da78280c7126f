"""Secret scan through a trigram inverted index, in DataFrame operations only.

1. `trigram_query` derives from each rule's regex a Boolean query: alternatives, each a set of trigrams that any match must hold.
2. `postings` is the inverted index: a row for each trigram and text that holds it.
3. `candidates` intersects the postings of each alternative (relational division: as many of its trigrams as it has).
4. `scan` verifies a rule's regex on its candidates only; rules without mandatory trigrams run on every text.

Scale: postings are narrow rows that never group by trigram, so a trigram that every text holds makes no hot group; they
are grouped by (text key, alternative), which map tasks combine. Candidates are written, so their size is known when they meet the texts in one
left join by text key: Spark sends them to the tasks where that size is below its broadcast limit, and no text is shuffled; else it shuffles both.
The clause table is as large as the rule list, whatever the corpus, so it is broadcast. Keys are 64-bit hashes: texts
that share one share candidates, and verification stays exact.

Defined results: null text is empty text and has no spans; a null id stays null. Spans of different kinds may overlap, and all are reported. Very long texts
are read whole. Repeated rows give repeated result rows. Other columns of the input,
whatever their names, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import text_or_empty, written
from wharfline.llm.spans import SPAN, joined, matches, replaced, sha256_hex


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the group has at_least characters; base kinds come first in reports."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    base: bool = False


#: A private key as PEM, from its header to its END line or, without one, to the last line of base64. Line ends may be escaped and
#: lines quoted, indented or prefixed, as keys stand in JSON, source code and mails; where line ends are lost, long runs count as lines;
#: whatever else stands around a long run between header and END line is the key too. Every part is possessive and none passes five dashes that begin no END line, so the time stays linear.
_HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_PAD = r"""[\x20\t"'+,;>#|*]*+"""
_END_OF_LINE = r"""(?:(?:\\r)?\\n(?:["'+,;\x20\t]*+\\?\r?\n)?|["'+,;\x20\t]*+\\?\r?\n|\r)"""
_GAP = r"""(?:[\s"'+,;>#|*]|\\[nrt]|\\\r?\n)"""
_ALONE = r"""(?=[\x20\t\r"'+,;)}\]`]*+(?:\n|\\[nr]|\Z))"""
_LINE = rf"{_PAD}{_END_OF_LINE}{_PAD}[A-Za-z0-9+/]++={{0,2}}+{_ALONE}|{_GAP}++[A-Za-z0-9+/=]{{16,}}+{_ALONE}|{_GAP}++[A-Za-z0-9+/=]{{40,}}+(?![^\s\"'\\,;)}}\]`<-])"
_UNDASHED = r"(?:[^-]|-(?!----))"
_VALUE = r"(?:[^\n\\-]|-(?!----))*+"
_FIELD = rf"{_PAD}{_END_OF_LINE}{_PAD}[A-Za-z][A-Za-z0-9-]*+:{_VALUE}"
_DIRECT = r"(?:[A-Za-z0-9+/=]{16,}+)?+"
_END = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
_CLOSED = rf"{_DIRECT}(?:{_LINE}|{_FIELD})*+(?:{_GAP}*+[A-Za-z0-9+/=]++)?+{_GAP}*+{_END}"
_BETWEEN = rf"(?={_UNDASHED}*?[A-Za-z0-9+/=]{{40}}){_UNDASHED}*+{_END}"
_BROKEN = rf"{_DIRECT}(?:{_PAD}{_END_OF_LINE}{_PAD}(?:Proc-Type|DEK-Info):{_VALUE})*+(?:{_LINE})*+"
PEM = rf"{_HEADER}(?:{_CLOSED}|{_BETWEEN}|{_BROKEN})"

#: The base kinds' patterns and lengths, then public token formats. A run of [0-9a-f] shorter than 16, or an
#: AKIA run shorter than 18, can neither count nor hide another match, so the length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A regex that branches into more alternatives than this counts as one without mandatory trigrams there.
MOST_FORMS = 64
#: So many trigrams of an alternative are asked for; any part of them is still mandatory, and candidates are verified.
MOST_BITS = 60
GAP = None


def _forms(items: Sequence) -> list[tuple]:
    """The alternatives of a parsed regex, each a sequence of characters and GAPs (anything)."""
    forms: list[tuple] = [()]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = [(chr(arg),)]
        elif name == "SUBPATTERN":
            more = _forms(arg[3])
        elif name == "BRANCH":
            more = [f for branch in arg[1] for f in _forms(branch)]
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            more = [(chr(c),) for _, c in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            once = _forms(inner) if least or most == 1 else [(GAP,)]
            if (least, most) == (0, 1):
                more = [(), *once]
            elif least == 1 == most:
                more = once
            else:
                more = [(*f, GAP) for f in once] if least else [(GAP,)]
        elif name == "AT":
            more = [()]
        else:
            more = [(GAP,)]
        forms = [f + m for f in forms for m in more] if len(forms) * len(more) <= MOST_FORMS else [(*f, GAP) for f in forms]
    return forms


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory lower-case trigrams; empty if some way to match the regex has none."""
    query = set()
    for form in _forms(regex_parser.parse(pattern)):
        runs = "".join("\n" if c is GAP else c for c in form).lower().split("\n")
        query.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    kept = [q for q in query if not any(other < q for other in query)]
    return [] if frozenset() in query else sorted(kept, key=sorted)


def postings(texts: DataFrame, trigrams: Sequence[str] | None = None) -> DataFrame:
    """Inverted index (trigram, key) of texts (key, text): all trigrams of the lower-cased text, or the given ones only."""
    if trigrams is None:
        held = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?=([\s\S]{3}))"), F.lit(1)))
    else:
        # the lower-cased text is a lambda's variable, so that it is made once for all trigrams
        wanted = F.array(*[F.lit(t) for t in sorted(trigrams)])
        held = F.flatten(F.transform(F.array(F.lower(F.col("text"))), lambda low: F.filter(wanted, lambda t: F.contains(low, t))))
    return texts.select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, kinds): texts that hold every trigram of some alternative of a rule. Postings meet by or-ing a bit for each trigram of the alternative, which repeated rows do not change."""
    clauses = []
    for rule in rules:
        for n, query in enumerate(trigram_query(rule.pattern)):
            mandatory = sorted(query)[:MOST_BITS]
            clauses += [(f"{rule.kind}/{n}", rule.kind, t, 1 << k, (1 << len(mandatory)) - 1) for k, t in enumerate(mandatory)]
    wanted = index.sparkSession.createDataFrame(clauses, "clause string, kind string, trigram string, bit long, whole long")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("key", "clause", "kind", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = whole").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns and found_spans (a column of that name is replaced): an array of (kind, start, stop, found) in code points, unordered."""
    own = [c for c in df.columns if c != "found_spans"]
    texts = df.select(F.struct(*own).alias("row"), text_or_empty(text_col).alias("text"), F.col(id_col).alias("id")).select("row", "text", F.xxhash64("id", "text").alias("key"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    wanted = sorted({t for query in queries.values() for q in query for t in q})
    if wanted:
        known = written(candidates(postings(texts.select("key", "text"), wanted), [r for r in rules if queries[r.kind]]), "candidates")
        found = texts.join(known, "key", "left")
    else:
        found = texts.withColumn("kinds", F.array().cast("array<string>"))

    def spans(rule: Rule) -> Column:
        every = matches(F.col("text"), rule.pattern, lambda part: F.length(part) >= rule.at_least, rule.group)
        tagged = F.transform(every, lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))
        none = F.array().cast(SPAN.replace("start", "kind:string,start"))
        return F.when(F.array_contains("kinds", rule.kind), tagged).otherwise(none) if queries[rule.kind] else tagged

    return found.select("row.*", F.concat(*[spans(rule) for rule in rules]).alias("found_spans"))


def redact(scanned: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """scanned without found_spans, each span of its texts (overlapping ones together) replaced by mask."""
    clean = replaced(F.col(text_col), F.col("found_spans"), lambda s: F.lit(mask), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return scanned.withColumn(text_col, clean).drop("found_spans")


def order_of(rules: Sequence[Rule]):
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"))


def digest(scanned: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash of the base spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    of = lambda kind: F.size(F.filter("found_spans", lambda s: s["kind"] == kind)).cast("long")
    basic = F.filter("found_spans", lambda s: s["kind"].isin(base))
    return scanned.select(
        id_col,
        *[of(kind).alias(f"n_{kind}") for kind in base],
        sha256_hex(joined(basic, order_of(rules))).alias("base_sha256"),
        joined(F.col("found_spans"), order_of(rules)).alias("spans"),
    )
