"""Reading in steps: digests, chunk lists, pages of messages under a budget of characters; packing of messages into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.text import excerpt, strip_thinking
from wharfline.storage import written

#: Fixed values.
PAGE_CHARS, PREVIEW_CHARS = 24_000, 2_000
CHUNK_CHARS, PIECE_OVERHEAD, WHOLE_CHARS = 28_000, 10, 8_000
SEPARATOR = "\n\n---\n\n"


def budget_page(messages: DataFrame, budget: int = PAGE_CHARS, by: str = "session_id", preview: int = PREVIEW_CHARS) -> DataFrame:
    """Of each session the first messages that fit the budget: (by, id, sequence_num, role, content_text, truncated).

    The page ends before a message that does not fit. A first message larger than the whole budget is shown alone, cut to a preview.
    """
    order = Window.partitionBy(by).orderBy("sequence_num", "id")
    size = F.coalesce(F.length("content_text"), F.lit(0)).cast("long")
    rows = messages.withColumn("__size", size).withColumn("__n", F.row_number().over(order))
    rows = rows.withColumn("__sum", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    alone = (F.col("__n") == 1) & (F.col("__size") > budget)
    shown = rows.where(alone | (F.col("__sum") <= budget))
    text = F.when(alone, F.substring("content_text", 1, min(preview, budget))).otherwise(F.col("content_text"))
    return shown.select(by, "id", "sequence_num", "role", text.alias("content_text"), alone.alias("truncated"))


def page_summary(messages: DataFrame, budget: int = PAGE_CHARS, by: str = "session_id") -> DataFrame:
    """(by, fetched, shown, exhausted, next_offset) of each session's first page."""
    fetched = messages.groupBy(by).agg(F.count("*").alias("fetched"))
    shown = budget_page(messages, budget, by).groupBy(by).agg(F.count("*").alias("shown"))
    rows = fetched.join(shown, by, "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    first_cut = budget_page(messages, budget, by).where("truncated").select(by, F.lit(True).alias("cut"))
    out = rows.join(first_cut, by, "left")
    exhausted = (F.col("shown") < F.col("fetched")) | F.coalesce("cut", F.lit(False))
    return out.select(by, "fetched", "shown", exhausted.alias("exhausted"), F.when(exhausted, F.col("shown")).alias("next_offset"))


def in_range(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each chunk's messages: equal session, id between the chunk's first and last."""
    spans = chunks.select("session_id", "chunk_index", "start_message_id", "end_message_id")
    return messages.join(spans, "session_id").where(F.col("id").between(F.col("start_message_id"), F.col("end_message_id"))).drop("start_message_id", "end_message_id")


CHUNKS = "session_id long, chunk_index int, start_message_id long, end_message_id long, content_chars long, n_pieces int, text string"


def chunk_sessions(messages: DataFrame, most: int = CHUNK_CHARS, least: int = WHOLE_CHARS) -> DataFrame:
    """(session_id, chunk_index, start_message_id, end_message_id, content_chars, n_pieces, text) of sessions longer than least.

    A session's messages go through one task in order, in a stream: what is held is the open chunk, however long the session is.
    """
    spoken = messages.where(F.length("content_text") > 0).select("session_id", "id", "sequence_num", F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content_text")).alias("text"))
    long = spoken.groupBy("session_id").agg(F.sum(F.length("text") + PIECE_OVERHEAD).alias("n")).where(F.col("n") > least).select("session_id")
    return chunk_texts(spoken.join(long, "session_id", "left_semi"), most)


class Packer:
    """Packs texts, in order, into chunks of at most `most` characters; a text too long for one is cut into pieces. What is held is the open chunk."""

    def __init__(self, most: int = CHUNK_CHARS) -> None:
        self.most, self.piece, self.room, self.index = most, most - PIECE_OVERHEAD, 0, 0
        self.open: list[tuple[int, str]] = []  # (message, piece of its text)

    def close(self) -> Iterator[tuple]:
        """The open chunk, if any: (chunk_index, start_message_id, end_message_id, content_chars, n_pieces, text)."""
        if self.open:
            texts = [t for _, t in self.open]
            yield self.index, self.open[0][0], self.open[-1][0], sum(map(len, texts)), len(texts), SEPARATOR.join(texts)
            self.index, self.open = self.index + 1, []

    def add(self, message: int, text: str) -> Iterator[tuple]:
        """The chunks that are full now."""
        for a in range(0, len(text), self.piece):
            part = text[a : a + self.piece]
            if len(part) + PIECE_OVERHEAD > self.room:
                yield from self.close()
                self.room = self.most
            self.open.append((message, part))
            self.room -= len(part) + PIECE_OVERHEAD


def chunk_texts(rows: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """The same of all sessions of rows (session_id, id, sequence_num, text)."""
    schema = pa.schema([("session_id", pa.int64()), ("chunk_index", pa.int32()), ("start_message_id", pa.int64()), ("end_message_id", pa.int64()), ("content_chars", pa.int64()), ("n_pieces", pa.int32()), ("text", pa.string())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, packer = None, Packer(most)
        shown = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        for batch in batches:
            out: list[tuple] = []
            for s, i, text in zip(*(batch.column(n).to_pylist() for n in ("session_id", "id", "text")), strict=True):
                if s != session:
                    out += [(session, *c) for c in packer.close()]
                    session, packer = s, Packer(most)
                out += [(session, *c) for c in packer.add(i, text)]
            yield shown(out)
        if last := [(session, *c) for c in packer.close()]:
            yield shown(last)

    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "sequence_num", "id")
    return ordered.select("session_id", "id", "text").mapInArrow(packed, CHUNKS)


class ChunkMessages:
    """The same as a table function: of a table (session_id, id, text) partitioned by session and in order, and the most characters of a chunk."""

    def __init__(self) -> None:
        self.session, self.packer = None, None

    def eval(self, row, most: int):
        if self.packer is None:
            self.session, self.packer = row["session_id"], Packer(most)
        if row["text"]:
            for chunk in self.packer.add(row["id"], row["text"]):
                yield self.session, *chunk

    def terminate(self):
        if self.packer is not None:
            for chunk in self.packer.close():
                yield self.session, *chunk


def manifest(chunks: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """(session_id, chunk_index, start_message_id, end_message_id, content_chars, total_chunks, next_offset): a page of each session's chunk list; next_offset is null on the last."""
    total = chunks.groupBy("session_id").agg(F.count("*").alias("total_chunks"))
    shown = chunks.where(F.col("chunk_index").between(offset, offset + limit - 1)).select("session_id", "chunk_index", "start_message_id", "end_message_id", "content_chars")
    return shown.join(total, "session_id").withColumn("next_offset", F.when(F.col("total_chunks") > offset + limit, offset + limit))


def range_page(messages: DataFrame, first: int, last: int, budget: int = PAGE_CHARS) -> DataFrame:
    """budget_page of the messages with ids from first to last, and where to go on: next_id is the first id that did not fit, null where all did."""
    inside = messages.where(F.col("id").between(first, last))
    shown = budget_page(inside, budget)
    rest = inside.join(shown.select("id"), "id", "left_anti").groupBy("session_id").agg(F.min("id").alias("next_id"))
    return shown.join(rest, "session_id", "left")


def digest(sessions: DataFrame, messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(session_id, message_count, chunk_count, excerpt): the excerpt is of the summary, else the first chunk, else the first message."""
    first_chunk = chunks.groupBy("session_id").agg(F.min_by("text", "chunk_index").alias("chunk"), F.count("*").alias("chunk_count"))
    first_message = messages.groupBy("session_id").agg(F.min_by("content_text", "sequence_num").alias("message"))
    rows = sessions.join(first_chunk, "session_id", "left").join(first_message, "session_id", "left")
    return rows.select("session_id", "message_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), excerpt(F.coalesce("summary", "chunk", "message")).alias("excerpt"))


def as_json(rows: DataFrame, by: str, columns: list[str], order: str) -> DataFrame:
    """(by, json): each group's rows as one JSON array of objects, in order. For groups that fit a row, such as a session's messages to be shown."""
    packed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *columns))).alias("x"))
    return packed.select(by, F.to_json(F.transform("x", lambda r: F.struct(*[r[c].alias(c) for c in columns]))).alias("json"))


def opening(text: Column, sentences: int = 1) -> Column:
    """The first sentences: the stand-in for a model."""
    return F.array_join(F.slice(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. "), 1, sentences), ". ")


Summarizer = Callable[[Column], Column]


def summarise(chunks: DataFrame, sentences: int = 1) -> DataFrame:
    """Extractive stand-in for a model: each chunk's opening sentences, whole, joined by session; one level of the summary tree."""
    made = chunks.withColumn("lead", opening(F.col("text"), sentences))
    return made.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "lead"))).alias("x")).select("session_id", F.array_join(F.col("x.lead"), "\n").alias("summary"))


def summary_tree(messages: DataFrame, summarizer: Summarizer = opening, most: int = CHUNK_CHARS, whole: int = WHOLE_CHARS, levels: int = 12) -> DataFrame:
    """(session_id, summary, level): what is short is its own summary, what fits one call is summarised, and longer sessions are packed into chunks whose
    summaries take the place of the messages, until they fit. A chunk whose summary is refused (`refused`) keeps its opening CUT characters. A level is a table; each is much
    shorter than the one before. Raises if a summarizer does not shrink the texts within so many levels."""
    rows = messages.where(F.length("content_text") > 0).select("session_id", "id", "sequence_num", F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content_text")).alias("text"))
    done: DataFrame | None = None
    for level in range(levels):
        size = rows.groupBy("session_id").agg((F.sum(F.length("text") + len(SEPARATOR)) - len(SEPARATOR)).alias("chars"))
        small = rows.join(size.where(F.col("chars") <= most), "session_id").groupBy("session_id", "chars").agg(F.sort_array(F.collect_list(F.struct("sequence_num", "id", "text"))).alias("x"))
        joined = small.select("session_id", "chars", F.array_join(F.col("x.text"), SEPARATOR).alias("text"))
        made = joined.select("session_id", F.when(F.col("chars") <= whole, F.col("text")).otherwise(summarizer(F.col("text"))).alias("summary"), F.lit(level).alias("level"))
        done = made if done is None else done.unionByName(made)
        large = rows.join(size.where(F.col("chars") > most).select("session_id"), "session_id", "left_semi")
        chunks = chunk_texts(large, most)
        summary = summarizer(F.col("text"))
        kept = F.when(refused(F.col("text"), summary).isNotNull(), F.substring("text", 1, CUT)).otherwise(summary)
        rows = written(chunks.select("session_id", F.col("chunk_index").cast("long").alias("id"), F.col("chunk_index").cast("long").alias("sequence_num"), kept.alias("text")), "summaries")
        if rows.isEmpty():
            return done
    raise RuntimeError(f"the summaries still do not fit after {levels} levels")


#: The least length of a summary, and what of a chunk stands in for a refused one.
LEAST_SUMMARY, CUT = 100, 5000


def refused(text: Column, summary: Column, prompt_tokens: Column | None = None, context: int = 16_384) -> Column:
    """Why a summary does not count: it echoes a control marker, is too short, is not shorter than its text, or the prompt filled the context; else null."""
    said = strip_thinking(summary)
    why = F.when(F.regexp_like(said, F.lit("^<[A-Za-z]")), "control marker").when(F.length(said) < LEAST_SUMMARY, "too short").when(F.length(said) >= F.length(text), "not shrunk")
    return F.when(prompt_tokens >= context - 64, "truncated").otherwise(why) if prompt_tokens is not None else why


# --- attempts

#: Texts of at most so many characters are their own summary if the model refuses them.
LEAST_ATTEMPT = 50
MOST_ATTEMPTS = 60


def summarise_with_attempts(texts: DataFrame, summarise: Callable[[Column], Column], refused: Callable[[Column, Column], Column], rewrite: Callable[[Column], Column], least: int = LEAST_ATTEMPT, between: str = " ") -> DataFrame:
    """(id, summary, attempts, reasons) of texts (id, text): what the model refuses comes again, rewritten at first, then in halves, until nothing is refused.

    refused(text, said) is the reason, null where said will do. An attempt is a table, all texts of it at once, and the next one has what it refused; a half that is no longer than least
    is its own summary, so it ends. A text's summary joins those of its parts in order. attempts is the number of the last attempt that it took, reasons are the different ones, sorted.
    A null text is its own summary."""
    part = texts.select("id", F.lit("").alias("part"), "text")
    kept: list[DataFrame] = []
    for attempt in range(MOST_ATTEMPTS):
        said = part.select("id", "part", "text", summarise(F.col("text")).alias("said"))
        tried = said.withColumn("why", refused(F.col("text"), F.col("said")))
        short = F.coalesce(F.length("text") <= least, F.lit(True)) & (attempt > 1 if attempt else F.col("text").isNull())
        done = F.col("why").isNull() | short
        tried = written(tried.withColumn("done", done), "attempt")
        kept.append(tried.select("id", "part", F.when(F.col("why").isNull(), F.col("said")).otherwise(F.col("text")).alias("said"), "done", F.lit(attempt + 1).alias("attempt"), "why"))
        rest = tried.where("NOT done")
        if rest.isEmpty():
            break
        half = F.floor(F.length("text") / 2).cast("int")
        halves = F.array(F.struct(F.lit("0").alias("side"), F.substring("text", F.lit(1), half).alias("text")), F.struct(F.lit("1").alias("side"), F.substring("text", half + 1, F.length("text")).alias("text")))
        part = rest.select("id", "part", rewrite(F.col("text")).alias("text")) if attempt == 0 else rest.select("id", "part", F.explode(halves).alias("h")).select("id", F.concat("part", "h.side").alias("part"), "h.text")
    else:
        raise RuntimeError("texts are still refused")
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    ordered = F.sort_array(F.collect_list(F.when(F.col("done"), F.struct("part", "said"))))
    return every.groupBy("id").agg(F.array_join(ordered["said"], between).alias("summary"), F.max("attempt").alias("attempts"), F.sort_array(F.collect_set("why")).alias("reasons"))
