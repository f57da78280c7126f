"""Inverted index for text search: written once, extended by deltas, read by term, best matches by block maxima.

An index is a folder of tables. Each `extend` adds a segment to them: postings by term, documents with their terms, the postings that it outdates, and what it adds to
the statistics (negative for what it outdates). Its row in `totals` comes last, in one small file; segments without one do not exist for
readers, so a writer that fails leaves nothing behind that anybody sees. One writer at a time.

A segment's documents fall into blocks by a hash of their ids, and a posting row holds one block's documents for one term: ids, frequencies, lengths and places as arrays, in front of
them the block's greatest frequency and least length. Rows lie in `bucket` folders by a hash of the term; a task writes a file of its blocks to each, in order of term, so a search opens the folders of its terms, and
Parquet's statistics leave the pages of other terms unread.

`search` finds the best k by MaxScore over blocks. The heads of the rows (term, block, greatest frequency, least length), which are all it reads of most blocks, bound what a document
of each block can score. The most promising blocks are scored first; the k-th score so found is a threshold, and only blocks whose bound reaches it are
read at all. The result is exact, ties included.

Scale: documents are dealt out by block, once, before their terms become rows, so a term that every document holds is as many rows as there are blocks, never one group. A task turns one block
after another (or MOST_PLACES places of it: then a term has several rows in that block, and its bound is only greater) from rows by document to rows by term, in Arrow arrays. A search brings to the driver the statistics of its terms and the numbers of the first blocks.

Defined results: null text has no terms but counts as a document of length 0. A null id is left out. Of rows of one id in a delta the one with the greatest text counts. Documents that come
again replace what they were; ids in `gone` are deleted. An index without segments finds nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions.english import MOST_WORDS, WORD, lists, slices, stem
from wharfline.functions.text import STOP_WORDS
from wharfline.operators.retrieval import K1, B, WebQuery
from wharfline.storage import written

BUCKETS = 32
#: Documents of a block, and how many blocks are scored first.
BLOCK_DOCS = 256
FIRST_BLOCKS = 8
#: Places that are put in order of term at a time.
MOST_PLACES = 1 << 22
#: Bounds are rounded up by so much, since scores are sums of doubles.
SLACK = 1e-9
POSTINGS = "term string, block int, docs array<long>, times array<int>, lens array<int>, places array<array<int>>, most int, least int, segment long, bucket int"
ROWS = ["term", "block", "docs", "times", "lens", "places", "most", "least"]
DOCS = "doc long, block int, len int, terms array<string>, segment long"
DEAD = "doc long, of_segment long, segment long"
TERMS = "term string, holders long, segment long, bucket int"
TOTALS = "docs long, len long, segment long"
SCHEMAS = {"postings": POSTINGS, "docs": DOCS, "dead": DEAD, "terms": TERMS, "totals": TOTALS}
PARTITIONS = {"postings": ["segment", "bucket"], "docs": ["segment"], "dead": ["segment"], "terms": ["segment", "bucket"], "totals": []}


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def first_letters(bucket: str, term: str) -> Column:
    """Bucket and seven letters as a number: rows in its order, then by term, are in order of bucket and term, and most are told apart without their terms being read."""
    letters = [F.ascii(F.substring(term, k + 1, 1)).cast("long") * (1 << 8 * (6 - k)) for k in range(7)]
    return reduce(lambda a, b: a + b, letters, F.col(bucket).cast("long") * (1 << 56))


class Codes(dict):
    """The number of each word's term, -1 for a stop word; terms by number. A word is analysed when it is first met."""

    def __init__(self, analyser: str) -> None:
        super().__init__()
        self.english, self.terms, self.numbers = analyser == "english", [], {}

    def __missing__(self, word: str) -> int:
        number = -1
        if not self.english or word not in STOP_WORDS:
            term = stem(word) if self.english else word
            number = self.numbers.setdefault(term, len(self.terms))
            if number == len(self.terms):
                self.terms.append(term)
        self[word] = number
        return number

    def forget(self) -> None:
        self.clear()
        self.numbers.clear()
        self.terms.clear()


def once_each(docs: DataFrame) -> DataFrame:
    """docs (doc, text), of rows of one id the one with the greatest text. Only ids are shuffled, and the texts of those that are there more than once."""
    again = written(docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "again")
    if again.isEmpty():
        return docs
    return docs.join(again, "doc", "left_anti").unionByName(docs.join(again, "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text")))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def cut(docs: DataFrame, analyser: str) -> DataFrame:
    """Of docs (doc, text): a row (doc, len, terms, times, places) each, terms distinct, places of all terms end to end, of each as many as its times."""
    schema = pa.schema([("doc", pa.int64()), ("len", pa.int32()), ("terms", pa.list_(pa.string())), ("times", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes(analyser)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                if len(known) > MOST_WORDS:
                    known.forget()
                found = [WORD.findall((text or "").lower()) for text in texts]
                words = np.array([len(f) for f in found], np.int64)
                code = np.concatenate([np.fromiter(map(known.__getitem__, f), np.int64, len(f)) for f in found])
                row, place = np.repeat(np.arange(len(texts)), words), np.arange(len(code)) - np.repeat(starts_of(words), words) + 1
                counts = code >= 0
                code, row, place = code[counts], row[counts], place[counts]
                # by row and term; the sort is stable, so places stay in order
                key = row * (len(known.terms) + 1) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                times = np.diff(first, append=len(order))
                used, number = np.unique(code[order][first], return_inverse=True)
                terms = pa.array([known.terms[c] for c in used.tolist()], pa.string()).take(pa.array(number))
                length, distinct = np.bincount(row, minlength=len(texts)), np.bincount(row[order][first], minlength=len(texts))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(length, pa.int32()), lists(distinct, terms), lists(distinct, pa.array(times, pa.int32())), lists(length, pa.array(place[order], pa.int32()))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc long, len int, terms array<string>, times array<int>, places array<int>")


def inverted(pieces: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """The posting rows of a block's documents (rows of `cut` with their block, in order of doc), without a Python object for a word."""
    rows = pa.Table.from_batches(pieces).combine_chunks()
    flat = {name: rows[name].combine_chunks().flatten() for name in ("terms", "times", "places")}
    if not len(flat["terms"]):
        return None
    coded = flat["terms"].dictionary_encode()
    code, times, places = (x.to_numpy(zero_copy_only=False) for x in (coded.indices, flat["times"], flat["places"]))
    # stable: within a term documents stay in order
    order = np.argsort(code, kind="stable")
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["terms"]).to_numpy())[order]
    sizes = times[order]
    took = np.repeat(starts_of(times)[order] - starts_of(sizes), sizes) + np.arange(len(places))
    holders = np.bincount(code, minlength=len(coded.dictionary))
    docs, lens = rows["doc"].to_numpy()[row], rows["len"].to_numpy()[row]
    block = pa.repeat(rows["block"][0], len(holders))
    columns = [coded.dictionary, block, *(lists(holders, pa.array(x)) for x in (docs, sizes, lens)), lists(holders, lists(sizes, pa.array(places[took])))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.maximum.reduceat(sizes, starts_of(holders))), pa.array(np.minimum.reduceat(lens, starts_of(holders)))], names=ROWS)


def posted(docs: DataFrame, most_places: int) -> DataFrame:
    """Posting rows of cut documents that lie together by block, in order of doc. A block's documents with more than so many places are several rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, places = [], None, 0
        for batch in batches:
            at, sizes = 0, pc.list_value_length(batch.column("places")).to_pylist()
            for k, (b, size) in enumerate(zip(batch.column("block").to_pylist(), sizes, strict=True)):
                if b != block or places + size > most_places:
                    held.append(batch.slice(at, k - at))
                    if (made := inverted(held)) is not None:
                        yield made
                    held, block, places, at = [], b, 0, k
                places += size
            held.append(batch.slice(at))
        if held and (made := inverted(held)) is not None:
            yield made

    return docs.select("doc", "block", "len", "terms", "times", "places").mapInArrow(run, POSTINGS.removesuffix(", segment long, bucket int"))


class Index:
    """An index below a folder; analyser as in retrieval.ANALYSERS."""

    def __init__(self, spark: SparkSession, root: str, analyser: str = "english") -> None:
        self.spark, self.root, self.analyser = spark, root.rstrip("/"), analyser
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*PARTITIONS[name]).parquet(f"{self.root}/{name}")

    def _read(self, name: str, segments: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        return rows if segments is None else rows.where(F.col("segment").isin(*segments))

    def _add(self, name: str, rows: DataFrame, segment: int) -> None:
        self._shaped(name, rows, segment).write.mode("append").partitionBy(*PARTITIONS[name]).parquet(f"{self.root}/{name}")

    def _shaped(self, name: str, rows: DataFrame, segment: int) -> DataFrame:
        if "bucket" in SCHEMAS[name]:
            # in the tasks that made them: to deal them out once more by range would shuffle every posting and work all of them out twice, once to sample
            rows = rows.withColumn("bucket", bucket_of("term"))
            rows = rows.sortWithinPartitions(first_letters("bucket", "term"), "term", *(["block"] if name == "postings" else []))
        return rows.withColumn("segment", F.lit(segment))

    def segments(self) -> list[int]:
        """Those that are whole; one small row each."""
        return sorted(r["segment"] for r in self._read("totals").select("segment").collect())

    def _dead(self, segments: Sequence[int]) -> DataFrame:
        return self._read("dead", segments).select("doc", F.col("of_segment").alias("segment"))

    def extend(self, delta: DataFrame | None = None, id_col: str = "id", text_col: str = "text", gone: DataFrame | None = None) -> int:
        """Adds the documents of delta, in place of what the index has under their ids, and drops the ids of gone (id_col). Returns the segment's number."""
        segments, segment = self.segments(), time.time_ns()
        empty = self.spark.createDataFrame([], "doc long, text string")
        given = empty if delta is None else once_each(delta.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))
        fresh = written(cut(given, self.analyser), "cut")
        blocks = max(1, -(-fresh.count() // BLOCK_DOCS))
        fresh = fresh.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
        self._add("docs", fresh.select("doc", "block", "len", "terms"), segment)

        # dealt out by block before terms become rows: a document travels once, and the rows of a term and block are made in one task, block by block
        rows = posted(fresh.repartition("block").sortWithinPartitions("block", "doc"), MOST_PLACES)
        self._add("postings", rows, segment)

        ids = fresh.select("doc") if gone is None else fresh.select("doc").unionByName(gone.select(F.col(id_col).cast("long").alias("doc"))).distinct()
        outdated = written(self._read("docs", segments).join(self._dead(segments), ["doc", "segment"], "left_anti").join(ids, "doc", "left_semi").select("doc", "len", "terms", "segment"), "outdated")
        self._add("dead", outdated.select("doc", F.col("segment").alias("of_segment")), segment)
        signed = fresh.select("terms", F.lit(1).alias("n")).unionByName(outdated.select("terms", F.lit(-1).alias("n")))
        self._add("terms", signed.select(F.explode("terms").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("holders")).where("holders != 0"), segment)
        counts = fresh.select("len", F.lit(1).alias("n")).unionByName(outdated.select("len", F.lit(-1).alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("docs"), F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).cast("long").alias("len"))
        self._add("totals", counts.coalesce(1), segment)
        return segment

    def postings(self, terms: Sequence[str], segments: Sequence[int]) -> DataFrame:
        """The rows of these terms: their folders are chosen by the driver, their row groups by Parquet's statistics."""
        met = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of("term").alias("b")).distinct()
        buckets = [r["b"] for r in met.collect()]
        return self._read("postings", segments).where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))

    def statistics(self, terms: Sequence[str], segments: Sequence[int]) -> tuple[int, float, dict[str, int]]:
        """Documents, their mean length, and how many hold each term."""
        n, total = self._read("totals", segments).agg(F.sum("docs"), F.sum("len")).first()
        buckets = [r["b"] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of("term").alias("b")).distinct().collect()]
        held = self._read("terms", segments).where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)).groupBy("term").agg(F.sum("holders"))
        return n or 0, (total or 0) / n if n else 0.0, {r[0]: r[1] for r in held.collect()}

    def _scored(self, query: WebQuery, without: WebQuery | None, segments: Sequence[int], stats: tuple[int, float, dict[str, int]], blocks: DataFrame | None, allowed: DataFrame | None) -> DataFrame:
        """(doc, score) of the live documents, in these blocks (segment, block), that match."""
        wanted = query.terms
        every = list(dict.fromkeys([*wanted, *WebQuery(any_of=[query.none_of]).terms, *(without.terms if without else [])]))
        rows = self.postings(every, segments)
        if blocks is not None:
            rows = rows.join(blocks, ["segment", "block"], "left_semi")
        each = rows.select("segment", "term", F.explode(F.arrays_zip("docs", "times", "lens", "places")).alias("x")).select("segment", "term", "x.*")
        of = lambda term, column: F.max(F.when(F.col("term") == term, F.col(column)))
        # a document is in one block of its segment: it has a row for each term at most
        by_doc = each.groupBy("segment", F.col("docs").alias("doc")).agg(F.max("lens").cast("double").alias("len"), *[of(t, "times").cast("double").alias(f"tf{k}") for k, t in enumerate(every)], *[of(t, "places").alias(f"at{k}") for k, t in enumerate(every)])
        number = {t: k for k, t in enumerate(every)}

        def has(phrase: Sequence[str | None]) -> Column:
            rest = [(number[t], d) for d, t in enumerate(phrase) if t is not None and d]
            first = F.col(f"at{number[phrase[0]]}")
            if not rest:
                return first.isNotNull()
            return F.coalesce(F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(F.col(f"at{k}"), p + d), F.lit(False)) for k, d in rest])), F.lit(False))

        def holds(q: WebQuery) -> Column:
            found = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(p) for p in group]) for group in q.any_of], F.lit(bool(q.any_of)))
            return reduce(lambda a, p: a & ~has(p), q.none_of, found)

        kept = by_doc.where(holds(query) & (~holds(without) if without else F.lit(True)))
        kept = kept.join(self._dead(segments), ["doc", "segment"], "left_anti")
        kept = kept.join(allowed, "doc", "left_semi") if allowed is not None else kept
        score = F.lit(0.0)
        for t in wanted:
            f = F.coalesce(F.col(f"tf{number[t]}"), F.lit(0.0))
            score = score + self._part(t, f, F.col("len"), stats)
        return kept.select("doc", score.alias("score"))

    @staticmethod
    def _part(term: str, times: Column, length: Column, stats: tuple[int, float, dict[str, int]]) -> Column:
        """What a term adds to a score: it grows with times and falls with length, so a block's extremes bound it."""
        n, mean, holders = stats
        df = float(holders.get(term, 0))
        return F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5))) * times * (K1 + 1) / (times + K1 * (1 - B + B * length / mean))

    def scores(self, query: WebQuery, without: WebQuery | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(doc, score) of every match."""
        segments = self.segments()
        if not query.any_of or not segments:
            return self.spark.createDataFrame([], "doc long, score double")
        return self._scored(query, without, segments, self.statistics(query.terms, segments), None, allowed)

    def bounds(self, query: WebQuery, segments: Sequence[int], stats: tuple[int, float, dict[str, int]]) -> DataFrame:
        """(segment, block, bound) of the blocks where every group of alternatives has one whose terms all occur, from the heads of the rows alone."""
        heads = self.postings(query.terms, segments).select("segment", "block", "term", F.col("most").cast("double").alias("most"), F.col("least").cast("double").alias("least"))
        part = reduce(lambda a, t: a.when(F.col("term") == t, self._part(t, F.col("most"), F.col("least"), stats)), query.terms, F.when(F.lit(False), 0.0))
        by_block = heads.withColumn("part", part).groupBy("segment", "block").agg(F.sum("part").alias("bound"), F.collect_set("term").alias("held"))
        occurs = lambda phrase: F.forall(F.array(*[F.lit(t) for t in phrase if t is not None]), lambda t: F.array_contains("held", t))
        fits = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [occurs(p) for p in group]) for group in query.any_of])
        return by_block.where(fits).select("segment", "block", (F.col("bound") + SLACK).alias("bound"))

    def search(self, query: WebQuery, k: int, without: WebQuery | None = None, allowed: DataFrame | None = None, first_blocks: int = FIRST_BLOCKS, digits: int = 9) -> DataFrame:
        """(doc, score, rank) of the best k matches among allowed (doc), if given; scores are rounded to so many digits, ties go by doc."""
        segments = self.segments()
        none = self.spark.createDataFrame([], "doc long, score double, rank long")
        if not query.any_of or not segments or k < 1:
            return none
        stats = self.statistics(query.terms, segments)
        if not stats[0]:
            return none
        best = lambda rows: rows.select("doc", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "doc").limit(k)
        bounds = written(self.bounds(query, segments, stats), "bounds")
        first = [(r["segment"], r["block"]) for r in bounds.orderBy(F.desc("bound")).limit(first_blocks).collect()]
        if not first:
            return none
        started = self.spark.createDataFrame(first, "segment long, block int")
        found = written(best(self._scored(query, without, segments, stats, F.broadcast(started), allowed)), "found")
        scores = [r["score"] for r in found.select("score").collect()]
        least = min(scores) if len(scores) == k else 0.0
        rest = bounds.where(F.col("bound") >= least - 10.0**-digits).join(F.broadcast(started), ["segment", "block"], "left_anti").select("segment", "block")
        more = best(self._scored(query, without, segments, stats, rest, allowed))
        top = best(found.unionByName(more))
        return top.select("doc", "score", F.row_number().over(Window.orderBy(F.desc("score"), "doc")).cast("long").alias("rank"))
