"""Plain-text views of the few rows of an answer."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def line(key: Column, title: Column, mine: Column, source: Column, at: Column, count: Column) -> Column:
    """A session in one line, as a column."""
    mark = F.when(mine, " [CURRENT PROJECT]").otherwise("")
    return F.concat(F.lit("#"), key.cast("string"), F.lit(" "), F.coalesce(title, F.lit("(untitled)")), mark, F.lit(" | "), source, F.lit(" | "), F.date_format(at, "yyyy-MM-dd"), F.lit(" | "), count.cast("string"), F.lit(" messages"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def age(seconds: Column) -> Column:
    """How long ago: in seconds under a minute, then minutes, hours, days, rounded down; never for null."""
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds.isNull(), "never").when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def chunk(session: Column, c: Column) -> Column:
    """One chunk (chunk_index, start_message_id, end_message_id, content_chars, summary) of a session, and where its messages are."""
    place = F.concat(F.lit("messages "), c["start_message_id"].cast("string"), F.lit("-"), c["end_message_id"].cast("string"))
    return F.concat(F.lit("chunk ["), c["chunk_index"].cast("string"), F.lit("] of session "), session.cast("string"), F.lit(", "), place, F.lit(", "), c["content_chars"].cast("string"), F.lit(" chars\n\n"), F.coalesce(c["summary"], F.lit("(no summary)")))


def digest(session: Column, title: Column, project: Column, at: Column, messages: Column, summary: Column, excerpt: Column, chunks: Column, offset: int, total: Column) -> Column:
    """A session on a page: its title, facts, summary (else an excerpt, else that there is none) and the chunks (an array as `chunk` takes them) from offset on, out of total, a line each, with where
    the next page begins."""
    text = lambda c: c.cast("string")
    head = F.concat(F.lit("# "), F.coalesce(title, F.concat(F.lit("Session "), text(session), F.lit(" (no title yet)"))))
    facts = F.concat(F.lit("session "), text(session), F.lit(" | project "), text(project), F.lit(" | "), F.date_format(at, "yyyy-MM-dd"), F.lit(" | "), text(messages), F.lit(" messages"))
    about = F.when(F.nullif(summary, F.lit("")).isNotNull(), F.concat(F.lit("## Summary\n"), summary)).when(F.nullif(excerpt, F.lit("")).isNotNull(), F.concat(F.lit("## Excerpt (no summary yet)\n"), excerpt)).otherwise(F.lit("## Summary\nnone"))
    shown = F.coalesce(F.size(chunks), F.lit(0))
    lines = F.transform(chunks, lambda c: F.concat(F.lit("- ["), text(c["chunk_index"]), F.lit("] messages "), text(c["start_message_id"]), F.lit("-"), text(c["end_message_id"]), F.lit(", "), text(c["content_chars"]), F.lit(" chars: "), one_line(F.coalesce(c["summary"], F.lit("")))))
    title_of = F.when(total > shown, F.concat(F.lit(f"## Chunks {offset}-"), text(shown + offset - 1), F.lit(" of "), text(total))).otherwise("## Chunks")
    more = F.when(total > shown + offset, F.concat(F.lit("\nmore chunks from "), text(shown + offset))).otherwise("")
    part = F.when(shown > 0, F.concat(title_of, F.lit("\n"), F.array_join(lines, "\n"), more)).otherwise("no chunks: read the whole session")
    return F.concat_ws("\n\n", F.concat(head, F.lit("\n"), facts), about, part)


def health(metrics: Mapping[str, Column], bad: Mapping[str, Column], ages: Mapping[str, Column]) -> Column:
    """The state of everything: numbers a line each, the kinds of bad summaries that occur, and how old the newest vectors are."""
    numbers = [F.concat(F.lit(f"- {name}: "), value.cast("string")) for name, value in metrics.items()]
    kinds = F.array_join(F.filter(F.array(*[F.when(n > 0, F.concat(F.lit(f"  - {name}: "), n.cast("string"))) for name, n in bad.items()]), lambda x: x.isNotNull()), "\n")
    old = [F.concat(F.lit(f"- {name}: "), age(seconds)) for name, seconds in ages.items()]
    return F.concat_ws("\n", F.lit("# Health"), *numbers, F.lit("- bad summaries:"), F.when(kinds == "", "  - none").otherwise(kinds), *old)


def hit(place: Column, r: Mapping[str, Column] | DataFrame, mine: Column) -> Column:
    """One of `hits`' entries, as a column."""
    first = F.concat(place.cast("string"), F.lit(". "), F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("(untitled)")), F.when(mine, " [CURRENT PROJECT]").otherwise(""))
    second = F.concat(F.lit("   session "), r["session_id"].cast("string"), F.lit(", "), r["source_name"], F.lit(", "), F.date_format(r["started_at"], "yyyy-MM-dd"), F.lit(", "), r["matched_tier"], F.lit(", score "), F.format_string("%.3f", r["score"]))
    return F.concat_ws("\n", first, second, F.when(F.nullif(r["snippet"], F.lit("")).isNotNull(), F.concat(F.lit("   "), r["snippet"])))


def hits(found: DataFrame, own_projects: Iterable[int] = ()) -> str:
    """Search results, best first; the caller's own projects are marked."""
    mine, lines = set(own_projects), []
    for n, r in enumerate(found.collect(), 1):
        mark = " [CURRENT PROJECT]" if r["project_id"] in mine else ""
        title = r["title"] or "(untitled)"
        lines.append(f"{n}. {title}{mark}\n   session {r['session_id']}, {r['source_name']}, {r['started_at']:%Y-%m-%d}, {r['matched_tier']}, score {r['score']:.3f}" + (f"\n   {r['snippet']}" if r["snippet"] else ""))
    return "\n".join(lines) or "No results."


def page(messages: DataFrame, next_offset: int | None = None) -> str:
    """A page of messages in order; cut ones say so."""
    parts = [f"[{r['role'].upper()}] #{r['id']}{' (cut)' if r['truncated'] else ''}\n{r['content_text'] or ''}" for r in messages.orderBy("sequence_num").collect()]
    return "\n\n".join([*parts, f"continue at offset {next_offset}"] if next_offset is not None else parts)


def counts(row: Row | Mapping, title: str) -> str:
    """One row of numbers, a line each, widest name first aligned."""
    values = row.asDict() if isinstance(row, Row) else dict(row)
    width = max(map(len, values), default=0)
    return "\n".join([title, *(f"  {k:<{width}}  {v}" for k, v in values.items())])


def drift(rows: DataFrame) -> tuple[str, int]:
    """The report of a verification and its exit code: 1 if anything has drifted."""
    off = rows.where("drift != 'none'").collect()
    lines = [f"{r['drift']}: {r[0]} by {r['rows_off']}" for r in off]
    return "\n".join(lines or ["no drift"]), int(bool(off))
