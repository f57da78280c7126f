"""Search: vector and text arms, rank fusion, claims, headlines, hybrid search. Every step is a lazy DataFrame.

Arms are (session_id, message_id, rank, raw, headline) with ranks from 1. Scores never shuffle whole collections: each arm ends in an
ordered limit, which keeps the best rows of each task, and only those few rows meet in fusion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.functions import english, paths, text, vectors
from wharfline.storage import written

#: The constant of rank fusion, the flat bonus of the caller's own projects, and how far each arm fetches.
RANK_K = 60
PROJECT_BOOST = 0.5
OVER_FETCH = {"session": 2, "chunk": 3, "message": 3, "fts": 2}
CLASS_OVER_FETCH = 5
ARMS = ("session", "chunk", "message", "fts")
DEFAULT_CLASSES = ("coding",)
#: Parameters of Robertson and Zaragoza's ranking function.
K1, B = 1.2, 0.75


def simple_terms(column: Column) -> Column:
    """Every word is a term."""
    return F.transform(F.coalesce(text.tokens(column), F.array().cast("array<string>")), lambda t, k: F.struct(t.alias("term"), (k + 1).alias("place")))


#: How text is cut into terms, on the side of the documents and of the query: by words alone, or as English. Arrays of (term, place); places count all words from 1.
ANALYSERS = {"simple": simple_terms, "english": english.lexemes}


# --- classes of data


def resolve_classes(classes: Sequence[str] | None = None, source: str | None = None, default: Sequence[str] = DEFAULT_CLASSES) -> list[str] | None:
    """Explicit classes win, '*' switches the filter off, and so does a source; None means no filter."""
    given = [c.strip().lower() for c in classes or () if c.strip()]
    if given:
        return None if "*" in given else given
    return None if source else list(default)


def check_classes(wanted: Sequence[str], known: Sequence[str]) -> None:
    """Raises for a class that nothing has; an empty vocabulary checks nothing."""
    if known and (odd := sorted(set(wanted) - set(known))):
        raise ValueError(f"unknown data classes {odd}; known: {sorted(known)}")


def class_vocabulary(projects: DataFrame, sources: DataFrame, column: str = "data_class") -> DataFrame:
    return projects.select(column).union(sources.select(column)).where(F.col(column).isNotNull()).distinct().orderBy(column)


# --- vectors


def knn(collection: DataFrame, query: Sequence[float], n: int, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id_col, score, rank): the n nearest by cosine, exactly; ties by id. where filters before the choice."""
    rows = collection.where(where) if where is not None else collection
    best = vectors.cosine_scores(rows, [query], id_col, vector_col).orderBy(F.desc("score"), id_col).limit(n)
    return best.select(id_col, "score", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long").alias("rank"))


def vector_of(collection: DataFrame, key, id_col: str = "id", vector_col: str = "embedding") -> list[float] | None:
    """One vector, by key; null if there is none."""
    row = collection.where(F.col(id_col) == key).select(vector_col).first()
    return None if row is None else list(row[0])


def resolve_centroids(centroid: DataFrame, given: Sequence[str], id_col: str) -> list[tuple[list[float], float]]:
    """(centroid, weight) of ids such as '7' or '7:0.5'; unknown ids and non-numbers are skipped. Only the ids asked for are fetched."""
    wanted = {int(i): w for i, w in vectors.weighted_ids(given) if re.fullmatch(r"\d+", i)}
    if not wanted:
        return []
    rows = centroid.where(F.col(id_col).isin(*wanted) & F.col("centroid").isNotNull()).select(id_col, "centroid").collect()
    return [(list(r[1]), wanted[r[0]]) for r in sorted(rows, key=lambda r: r[0])]


# --- text


@dataclass
class WebQuery:
    """A query in web style: words are all required, "quoted words" in a row, `or` between alternatives, - before what must not be there.
    A phrase is a list of terms; a null stands for a word that is left out, but keeps its place."""

    any_of: list[list[list[str | None]]] = field(default_factory=list)  # alternatives of phrases
    none_of: list[list[str | None]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(t for group in self.any_of for phrase in group for t in phrase if t is not None))


def parse_query(query: str, analyser: str = "simple") -> WebQuery:
    out, joined = WebQuery(), False
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', query):
        quoted, word = m[2], m[3]
        if word and word.lower() == "or" and not m[1]:
            joined = bool(out.any_of)
            continue
        phrase = [t for t in re.split("[^a-z0-9]+", (quoted if quoted is not None else word).lower()) if t]
        if analyser == "english":
            phrase = [None if t in text.STOP_WORDS else english.stem(t) for t in phrase]
        while phrase and phrase[0] is None:
            del phrase[0]
        while phrase and phrase[-1] is None:
            del phrase[-1]
        if not phrase:
            continue
        if m[1]:
            out.none_of.append(phrase)
        elif joined:
            out.any_of[-1].append(phrase)
        else:
            out.any_of.append([phrase])
        joined = False
    return out


def has_phrase(terms: Column, phrase: Sequence[str | None]) -> Column:
    """Whether (term, place) terms hold the phrase's words at its distances."""
    rest = [(t, k) for k, t in enumerate(phrase) if t is not None and k]

    def here(x: Column) -> Column:
        later = [F.array_contains(terms, F.struct(F.lit(t).alias("term"), (x["place"] + k).alias("place"))) for t, k in rest]
        return reduce(lambda a, b: a & b, later, x["term"] == phrase[0])

    return F.exists(terms, here)


def matches(terms: Column, query: WebQuery) -> Column:
    """Every group of alternatives is met and nothing that is excluded is there; an empty query matches nothing."""
    if not query.any_of:
        return F.lit(False)

    def fits(terms: Column) -> Column:
        wanted = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has_phrase(terms, p) for p in group]) for group in query.any_of])
        return reduce(lambda a, p: a & ~has_phrase(terms, p), query.none_of, wanted)

    return F.exists(F.array(terms), fits)  # a filter that names the terms again for each phrase would cut the text again each time


def text_match(docs: DataFrame, query: WebQuery, text_col: str, keep: Sequence[str], analyser: str = "simple") -> DataFrame:
    """(keep.., terms) of the documents that match."""
    cut = docs.select(*keep, ANALYSERS[analyser](F.col(text_col)).alias("__t"))
    # a generator gives a row or none and works its terms out once, where a filter would move below them and repeat them
    return cut.select(*keep, F.explode(F.filter(F.array("__t"), lambda t: matches(t, query))).alias("terms"))


def bm25(docs: DataFrame, terms: Sequence[str], text_col: str, keep: Sequence[str], query: WebQuery | None = None, without: WebQuery | None = None, analyser: str = "simple") -> DataFrame:
    """(keep.., score) of documents that hold a term (and match query and not without), Robertson and Zaragoza's BM25. Texts are cut into terms once: frequencies and lengths
    are written as a narrow table, which gives the statistics of all documents and then the scores. Nothing is exploded, so a word of every document makes no hot key."""
    rows = docs.withColumn("__t", ANALYSERS[analyser](F.col(text_col)))
    frequency = lambda term: F.size(F.filter("__t", lambda x: x["term"] == term)).cast("double")
    tf = [frequency(t).alias(f"__tf{k}") for k, t in enumerate(terms)]
    use = (matches(F.col("__t"), query) if query is not None else F.lit(True)) & (~matches(F.col("__t"), without) if without is not None else F.lit(True))
    counted = written(rows.select(*keep, F.size("__t").cast("double").alias("__len"), *tf, use.alias("__use")), "terms")
    stats = counted.agg(F.count("*").cast("double").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{k}") > 0).cast("double").alias(f"__df{k}") for k in range(len(terms))])
    joined = counted.where("__use").crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for k in range(len(terms)):
        f, df = F.col(f"__tf{k}"), F.col(f"__df{k}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    hit = reduce(lambda a, b: a | b, [F.col(f"__tf{k}") > 0 for k in range(len(terms))], F.lit(False))
    return joined.where(hit).select(*keep, score.alias("score"))


def ranked_text(docs: DataFrame, query: str, text_col: str, keep: Sequence[str], limit: int, analyser: str = "english", exclude: str | None = None) -> DataFrame:
    """(keep.., score, rank) of the best matches of a web-style query; ties by the first of keep."""
    q = parse_query(query, analyser)
    scored = bm25(docs, q.terms, text_col, keep, q, parse_query(exclude, analyser) if exclude else None, analyser).withColumn("score", F.round("score", 9))
    return ranked(scored, [F.desc("score"), F.col(keep[0])], [*keep, "score"], limit)


def search_messages(messages: DataFrame, sessions: DataFrame, query: str, limit: int = 20, source: str | None = None, analyser: str = "english") -> DataFrame:
    """(id, session_id, project_id, source_name, score, rank): the best messages of live sessions, of one source if it is named."""
    live = sessions.where("deleted_at IS NULL") if "deleted_at" in sessions.columns else sessions
    live = live.where(F.col("source_name") == source) if source else live
    said = messages.select("id", "session_id", "content_text").join(live.select("session_id", "project_id", "source_name"), "session_id")
    return ranked_text(said, query, "content_text", ["id", "session_id", "project_id", "source_name"], limit, analyser)


def search_session_summaries(sessions: DataFrame, query: str, limit: int = 20, analyser: str = "english") -> DataFrame:
    return ranked_text(sessions.where("summary IS NOT NULL"), query, "summary", ["session_id", "project_id", "source_name"], limit, analyser)


def best_window(words: list[str], wanted: set[str], most: int = 25, least: int = 10) -> tuple[int, int]:
    """Where to cut a headline: the window of at most `most` words with the most different wanted words, the first of equals."""
    hit = [re.sub("[^a-z0-9]", "", w.lower()) for w in words]
    places = [i for i, h in enumerate(hit) if h in wanted]
    if not places:
        return 0, min(least, len(words))
    best = max(places, key=lambda i: (len({h for h in hit[i : i + most] if h in wanted}), -i))
    last = max(i for i in places if i < best + most)
    return best, min(len(words), max(last + 1, best + least))


def headline(column: Column, terms: Sequence[str], analyser: str = "simple") -> Column:
    """A window of the text with the terms in bold; an Arrow-batched UDF, meant for the few rows left after ranking."""
    wanted, same = set(terms), english.stem if analyser == "english" else str

    @F.pandas_udf(T.StringType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(value: str | None) -> str | None:
            if value is None:
                return None
            words = value.split()
            hit = [same(re.sub("[^a-z0-9]", "", w.lower())) for w in words]
            a, b = best_window(hit, wanted)
            return " ".join(f"**{w}**" if h in wanted else w for w, h in zip(words[a:b], hit[a:b], strict=True))

        for batch in batches:
            yield batch.map(one)

    return cut(column)


# --- ranks


def ranked(df: DataFrame, order: Sequence[Column], keep: Sequence[str], n: int) -> DataFrame:
    """The first n rows by order, with their rank; the limit comes first, so the numbering sees n rows."""
    top = df.orderBy(*order).limit(n)
    return top.select(*keep, F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def fuse(arms: DataFrame, key: str = "session_id", k: int = RANK_K) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over arms of (key, rank)."""
    return arms.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def once_per(arm: DataFrame, key: str = "session_id") -> DataFrame:
    """Each key's first row; ranks closed up again in their order."""
    first = arm.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("__n = 1").drop("__n")
    return first.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long"))


def first_claim(arms: DataFrame, key: str = "session_id") -> DataFrame:
    """Each key's row of the first arm (arm_priority, then rank) that names it; a later headline replaces the claimed row's."""
    w = Window.partitionBy(key)
    claimed = arms.withColumn("__n", F.row_number().over(w.orderBy("arm_priority", "rank"))).withColumn("__h", F.max("headline").over(w))
    return claimed.where("__n = 1").withColumn("headline", F.col("__h")).drop("__n", "__h")


@dataclass
class SearchParams:
    query: str | None = None
    vector: Sequence[float] | None = None
    negative_vector: Sequence[float] | None = None
    like_session: Sequence[str] = ()
    unlike_session: Sequence[str] = ()
    like_project: Sequence[str] = ()
    unlike_project: Sequence[str] = ()
    mode: str = "hybrid"
    limit: int = 8
    source: str | None = None
    since: datetime | None = None
    classes: Sequence[str] | None = None
    cwd: str | None = None
    project_only: bool = False
    include_automated: bool = False
    include_unsummarized: bool = False
    exclude_terms: str | None = None
    analyser: str = "english"


@dataclass
class Corpus:
    """sessions (session_id, project_id, source_name, data_class, project_path, title, summary, started_at, is_automated, deleted_at),
    messages (id, session_id, content_text), vector collections (id, session_id, embedding, raw) by arm, and an index of the messages."""

    sessions: DataFrame
    messages: DataFrame
    collections: dict[str, DataFrame] = field(default_factory=dict)
    session_centroids: DataFrame | None = None
    project_centroids: DataFrame | None = None
    #: a postings.Index of the messages' texts; without one every text is cut into terms for each search
    text_index: Any = None


def eligible(corpus: Corpus, p: SearchParams) -> DataFrame:
    """The sessions that a search may show, with in_project."""
    s = corpus.sessions.where("deleted_at IS NULL")
    if p.source:
        s = s.where(F.col("source_name") == p.source)
    if p.since:
        s = s.where(F.col("started_at") >= F.lit(p.since.replace(tzinfo=None)).cast("timestamp_ntz"))
    if not p.include_automated:
        s = s.where(~F.coalesce("is_automated", F.lit(False)))
    if not p.include_unsummarized:
        s = s.where("summary IS NOT NULL")
    if (classes := resolve_classes(p.classes, p.source)) is not None:
        s = s.where(F.col("data_class").isin(*classes))
    here = paths.related(F.col("project_path"), p.cwd) if p.cwd else F.lit(False)
    s = s.withColumn("in_project", F.coalesce(here, F.lit(False)))
    return s.where("in_project") if p.project_only else s


def search(corpus: Corpus, p: SearchParams) -> DataFrame:
    """(session_id, title, title_source, project_id, source_name, data_class, started_at, score, matched_tier, message_id, snippet), best first.

    Each vector arm fetches some times the limit from its whole collection (more where classes will be left out), and filters run on those few rows: a narrow filter
    can leave fewer hits than there are.
    """
    steer = [resolve_centroids(c, ids, key) if c is not None else [] for c, ids, key in (
        (corpus.session_centroids, p.like_session, "session_id"), (corpus.session_centroids, p.unlike_session, "session_id"),
        (corpus.project_centroids, p.like_project, "project_id"), (corpus.project_centroids, p.unlike_project, "project_id"))]
    if not p.query and p.vector is None and not any(steer):
        raise ValueError("a search needs a query, a vector or centroids")
    sessions = eligible(corpus, p)
    wide = CLASS_OVER_FETCH if resolve_classes(p.classes, p.source) is not None else 1
    arms: list[DataFrame] = []
    if p.mode in ("semantic", "hybrid") and (p.vector is not None or any(steer)):
        vector = vectors.compose(p.vector, p.negative_vector, steer[0] + steer[2], steer[1] + steer[3])
        for arm, collection in corpus.collections.items():
            near = knn(collection, vector, p.limit * OVER_FETCH[arm] * wide)
            rows = F.broadcast(near).join(collection.select("id", "session_id", "raw"), "id").join(sessions.select("session_id"), "session_id", "left_semi")
            arms.append(once_per(rows).select("session_id", F.col("id").alias("message_id"), "rank", "raw", F.lit(None).cast("string").alias("headline"), F.lit(ARMS.index(arm)).alias("arm_priority")))
    if p.mode in ("text", "hybrid") and p.query:
        query = parse_query(p.query, p.analyser)
        without = parse_query(p.exclude_terms, p.analyser) if p.exclude_terms else None
        if corpus.text_index is not None and corpus.text_index.analyser == p.analyser:
            scored = corpus.text_index.scores(query, without).withColumnRenamed("doc", "id").join(corpus.messages.select("id", "session_id"), "id")
        else:
            scored = bm25(corpus.messages, query.terms, "content_text", ("id", "session_id"), query, without, p.analyser)
        scored = scored.join(sessions.select("session_id"), "session_id", "left_semi")
        scored = scored.withColumn("score", F.round("score", 9))
        best = scored.groupBy("session_id").agg(F.min(F.struct(-F.col("score"), "id"))["id"].alias("id"), F.max("score").alias("score"))
        top = ranked(best, [F.desc("score"), F.col("id")], ["session_id", "id"], p.limit * OVER_FETCH["fts"])
        shown = F.broadcast(top).join(corpus.messages.select("id", "content_text"), "id")
        arms.append(shown.select("session_id", F.col("id").alias("message_id"), "rank", F.lit(None).cast("string").alias("raw"), headline(F.col("content_text"), query.terms, p.analyser).alias("headline"), F.lit(ARMS.index("fts")).alias("arm_priority")))
    if not arms:
        raise ValueError("no arm can answer this search")
    # some rows an arm, which three steps read: worked out once
    union = written(reduce(DataFrame.unionByName, arms), "arms")
    hits = first_claim(union).join(fuse(union), "session_id").join(sessions, "session_id")
    title, origin = text.resolve_title(F.col("title"), F.col("summary"))
    score = F.col("score") + F.when(F.col("in_project"), PROJECT_BOOST).otherwise(0.0)
    tier = F.get(F.array(*[F.lit("message" if a == "fts" else a) for a in ARMS]), F.col("arm_priority"))
    shown = hits.select(
        "session_id", title.alias("title"), origin.alias("title_source"), "project_id", "source_name", "data_class", "started_at", score.alias("score"),
        tier.alias("matched_tier"), "message_id", text.snippet(F.col("raw"), F.col("headline")).alias("snippet"), "arm_priority", "rank",
    )
    return shown.orderBy(F.desc("score"), "arm_priority", "rank", "session_id").limit(p.limit).drop("arm_priority", "rank")
