"""The calls of the service this library can stand behind, as plain functions that return DataFrames or values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.functions.times import clamp, since
from wharfline.operators import merge, pending, reading, reports, retrieval


class Library:
    """A corpus of conversations (retrieval.Corpus, chunks, bookkeeping and logs) behind one object. Tables it was not given are asked for when a call needs them."""

    def __init__(self, corpus: retrieval.Corpus, chunks: DataFrame | None = None, embeddings: DataFrame | None = None, logs: DataFrame | None = None, letters: DataFrame | None = None):
        self.corpus, self.chunks, self.embeddings, self.logs, self.letters = corpus, chunks, embeddings, logs, letters

    def _given(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise ValueError(f"this call needs the table {name}")
        return table

    def search(self, query: str | None = None, now: datetime | None = None, since_text: str | None = None, limit: int = 8, **options) -> DataFrame:
        floor = since(since_text, now or datetime.now().astimezone()) if since_text else None
        return retrieval.search(self.corpus, retrieval.SearchParams(query=query, since=floor, limit=clamp(limit, 1, 100, 8), **options))

    def session(self, term: str) -> DataFrame:
        """By number, by outside id, or by a part of the title; the newest."""
        s = self.corpus.sessions.where("deleted_at IS NULL")
        hit = F.ilike("title", F.lit(f"%{retrieval.text.escape_like(term)}%"))
        hit = hit | (F.col("external_id") == term) if "external_id" in s.columns else hit
        return s.where(hit | (F.col("session_id") == int(term)) if term.isdigit() else hit).orderBy(F.desc("started_at"), "session_id").limit(1)

    def digest(self, session_id: int) -> DataFrame:
        one = lambda df: df.where(F.col("session_id") == session_id)
        return reading.digest(one(self.corpus.sessions), one(self.corpus.messages), one(self._given("chunks")))

    def messages(self, session_id: int, budget: int = reading.PAGE_CHARS, offset: int = 0) -> DataFrame:
        return reading.budget_page(self.corpus.messages.where((F.col("session_id") == session_id) & (F.col("sequence_num") >= offset)), budget)

    def message(self, message_id: int) -> DataFrame:
        return self.corpus.messages.where(F.col("id") == message_id)

    def chunk(self, session_id: int, index: int) -> DataFrame:
        return self._given("chunks").where((F.col("session_id") == session_id) & (F.col("chunk_index") == index))

    def sessions(self, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
        rows = self.corpus.sessions.where("deleted_at IS NULL")
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        return reports.page(rows, [F.col("started_at").desc_nulls_last(), F.desc("session_id")], clamp(limit, 1, 200, 50), max(0, offset))

    def projects(self) -> DataFrame:
        return self.corpus.sessions.where("deleted_at IS NULL").groupBy("project_id", "source_name").agg(F.count("*").alias("n_sessions"), F.max("started_at").alias("last_at")).orderBy(F.col("last_at").desc_nulls_last(), "project_id")

    def context(self, cwd: str, limit: int = 10) -> DataFrame:
        rows = self.corpus.sessions.where("deleted_at IS NULL").where(retrieval.paths.related(F.col("project_path"), cwd))
        return rows.orderBy(F.col("started_at").desc_nulls_last(), "session_id").limit(limit)

    def health(self) -> DataFrame:
        return reports.bad_summaries(self.corpus.sessions)

    def activity(self, start: str, stop: str) -> DataFrame:
        return reports.daily_activity(self.corpus.sessions, "started_at", start, stop, {"n_sessions": F.count("*")})

    def pending(self) -> DataFrame:
        return pending.pending_messages(self.corpus.messages, self._given("embeddings"))

    def quarantine(self, limit: int = 50) -> DataFrame:
        return reports.page(self._given("letters").where("resolved_at IS NULL"), [F.desc("last_attempt_at"), F.col("record_key")], limit)

    def log_page(self, limit: int = 100, offset: int = 0, contains: str | None = None, **equal) -> DataFrame:
        rows = self._given("logs")
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        rows = rows.where(F.contains("message", F.lit(contains))) if contains else rows
        return rows.orderBy(F.desc("logged_at")).offset(max(0, offset)).limit(clamp(limit, 1, 500, 100))

    def report_useless(self, session_id: int, at: datetime) -> DataFrame:
        """The sessions with this one deleted, softly."""
        doomed = self.corpus.sessions.where(F.col("session_id") == session_id).select("session_id")
        return merge.soft_delete(self.corpus.sessions, doomed, ["session_id"], F.lit(at.isoformat(sep=" ")).cast(self.corpus.sessions.schema["deleted_at"].dataType))
