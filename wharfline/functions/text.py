"""Text expressions: all columns in, columns out, no Python per row. Lengths are code points."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SNIPPET_CHARS = 140
EXCERPT_CHARS = 300
#: Fixed value: the shortest real content, in characters, that is worth an embedding.
LEAST_CONTENT = 50
#: Openings of tool output and boilerplate, as regular expressions searched in the whole text.
NOISE = (
    r"^\[Request interrupted", r"^\[THINKING\]", r"^No results found", r"^No files found", r"^No matches found", r"^File created successfully",
    r"^Updated task #", r"^MCP (error|tool call)", r"^To github\.com", r"^Exit code \d", r"^\s*(CREATE TABLE|COPY \d|DROP TABLE|ALTER TABLE|INSERT \d)",
    r"^\s*\d+ rows? affected", r'^\{"ok":false', r"^📬\s*\*?\*?Slack heads-up", r"^##\s*Slack Brief", r"^All clear! No urgent items",
    r"ACCESSIBILITY ACCOMMODATION.*screen reader", r"IMMEDIATE DISMISSAL.*dismissed-urls\.txt",
)
#: How those are read that do not begin where the text begins, or that pass over line ends.
NOISE_FLAGS = {**dict.fromkeys(NOISE[13:16], "(?m)"), **dict.fromkeys(NOISE[16:], "(?s)")}
#: First lines of sessions that no person started.
AUTOMATED = (
    r"^You are a Slack monitoring assistant", r"^You are a curiosity curator", r"^You are an ADHD accessibility assistant",
    r"^You are an MCP availability checker", r"^You are Henchman, the theatrical lab assistant", r"^Huddle in #",
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f names it; without it, expressions built on expressions double at each step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def trim_all(text: Column) -> Column:
    """Trims every kind of white space, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cap(text: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if some were cut."""
    return let(text, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark before white space or the end; all of it if there is none."""
    return let(collapse(text), lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"^.*?[.!?](?=\s|$)", 0), F.lit("")), t))


def _given(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def snippet(raw: Column, headline: Column | None = None) -> Column:
    """One line: the headline if there is one, else the first sentence of raw; null if neither says anything."""
    lead = F.when(_given(raw).isNotNull(), first_sentence(raw))
    return cap(F.coalesce(_given(headline), lead) if headline is not None else lead, SNIPPET_CHARS)


def excerpt(raw: Column, headline: Column | None = None) -> Column:
    whole = F.coalesce(_given(headline), _given(raw)) if headline is not None else _given(raw)
    return cap(whole, EXCERPT_CHARS)


def first_meaningful_line(text: Column) -> Column:
    """(The pattern is a fixed value.) The first line that is not blank once heading marks and list bullets are off; null if none."""
    lines = F.transform(F.split(text, "\n"), lambda x: trim_all(F.regexp_replace(x, r"^\s*(?:#{1,6}|[-*+])\s+", "")))
    return F.get(F.filter(lines, lambda x: F.length(x) > 0), F.lit(0))


def opening_sentence(line: Column) -> Column:
    """(The pattern is a fixed value.) To the first sentence end that a capital, digit, quote or bracket follows, so versions and abbreviations stay whole."""
    return let(line, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"^(.*?[.!?])\s+(?=[\"'(\[]?[A-Z0-9])", 1), F.lit("")), t))


def resolve_title(title: Column, summary: Column) -> tuple[Column, Column]:
    """(title, source of it): the stored title, else the summary's opening sentence, else null and 'none'."""
    stored = F.nullif(trim_all(title), F.lit(""))
    derived = opening_sentence(first_meaningful_line(trim_all(summary)))
    return F.coalesce(stored, derived), F.when(stored.isNotNull(), "source").when(derived.isNotNull(), "summary").otherwise("none")


def not_warmup(title: Column) -> Column:
    """True unless the title is Warmup; a null title is no warmup."""
    return ~title.eqNullSafe(F.lit("Warmup"))


def noise_reason(text: Column, only: Column | None = None) -> Column:
    """Why stripped text is not worth an embedding: scaffolding-only (where `only` says so), too-short:<n>, pattern:<expression>, or null."""
    found = F.when(F.coalesce(only, F.lit(False)), "scaffolding-only") if only is not None else F.when(F.lit(False), "")
    found = found.when(F.length(text) < LEAST_CONTENT, F.concat(F.lit("too-short:"), F.length(text).cast("string")))
    for pattern in NOISE:
        found = found.when(like(text, NOISE_FLAGS.get(pattern, "") + pattern), F.lit(f"pattern:{pattern}"))
    return found


def automated_reason(title: Column) -> Column:
    line = trim_all(F.split_part(title, F.lit("\n"), F.lit(1)))
    found = F.when(like(line, AUTOMATED[0]), F.lit(f"pattern:{AUTOMATED[0]}"))
    for pattern in AUTOMATED[1:]:
        found = found.when(like(line, pattern), F.lit(f"pattern:{pattern}"))
    return found


def sanitise(text: Column) -> Column:
    """For embedding: NUL goes, other control characters become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"[\x00-\x1F\x7F-\x9F]", " ")


def strip_thinking(text: Column) -> Column:
    """What follows the last </think>, without stray opening tags."""
    return trim_all(F.regexp_replace(F.substring_index(text, "</think>", -1), r"</?think>", ""))


def occurrences(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def unrecoverable(payload: Column) -> Column:
    """Nothing but NULs and white space."""
    return like(payload, r"(?U)^[\x00\s]*$")


def escape_like(value: str) -> str:
    return "".join(f"\\{c}" if c in "\\%_" else c for c in value)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits: the simple analyser, which SQL can share."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


#: The words that English text search leaves out.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def clean_json(value):
    """A parsed JSON value without NULs and lone surrogates in its strings, keys among them. Of keys that become equal, one that was clean wins, else the first."""
    if isinstance(value, str):
        return "".join(c for c in value if c != "\0" and not "\ud800" <= c <= "\udfff")
    if isinstance(value, list):
        return [clean_json(v) for v in value]
    if isinstance(value, dict):
        clean = {k: clean_json(v) for k, v in value.items() if clean_json(k) == k}
        for k, v in value.items():
            clean.setdefault(clean_json(k), clean_json(v))
        return clean
    return value


@F.pandas_udf(StringType())
def deep_clean_json(value: pd.Series) -> pd.Series:
    """JSON text through clean_json; keys are any, so this is a walk and no expression."""
    return value.map(lambda v: None if v is None else json.dumps(clean_json(json.loads(v)), ensure_ascii=False, separators=(",", ":")))


def round_half_up(x: Column, places: int = 2) -> Column:
    """Half goes towards plus infinity, unlike F.round."""
    f = 10.0**places
    return F.floor(x * f + 0.5) / f


# --- signals of bad summaries

#: The names of the signals, and in `summary_signals` their patterns and bounds.
SIGNALS = ("truncated", "marker_only", "no_update", "refusal", "raw_message_leak", "too_short", "over_compressed", "loopy", "json_dump", "code_dump", "unsummarizable")


def summary_signals(summary: Column, chars: Column) -> dict[str, Column]:
    """A boolean for each of SIGNALS; chars is the length of what was summarised."""
    words = F.split(summary, " ")
    n = F.size(words)
    found = {
        "truncated": like(summary, r"^\[(USER|ASSISTANT|SYSTEM|TOOL)\]:") & (chars > 8000),
        "marker_only": summary.isin("No embeddable content", "Embedding generation failed"),
        "no_update": like(summary, r"(?i)^\s*(NO_UPDATE|NO UPDATE|N/A|None)\s*$"),
        "refusal": like(summary, r"(?i)^\s*(<done>|</?think>|BLOCKED|ERROR:|I cannot|I am unable|I'm unable|I will not)"),
        "raw_message_leak": (chars > 8000) & (occurrences(summary, "[USER]:") * 7 + occurrences(summary, "[ASSISTANT]:") * 12 > 14),
        "too_short": (F.length(summary) < 500) & (chars > 8000),
        "over_compressed": (chars > 5000) & (F.try_divide(F.length(summary).cast("double"), chars.cast("double")) < 0.005),
        "loopy": (F.length(summary) > 2000) & (n > 300) & (F.size(F.array_distinct(words)) / n < 0.05),
        "json_dump": like(summary, r"^\s*\{") & like(summary, r'"file_paths"\s*:'),
        "code_dump": (chars > 8000) & (occurrences(summary, "`" * 3) >= 4),
        "unsummarizable": summary.startswith("[unsummarizable]"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}
