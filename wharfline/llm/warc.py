"""WARC archives and a normaliser for monolithic gzip files.

`records` plans the archives: which record of equal payloads is the response and which are revisits of it. `write_monolithic`
packs records into archives that are one gzip stream each, as some crawlers leave them; `read_files` takes such .warc.gz files from a folder. `normalise` inflates such a stream
once, front to back, rewrites every record as a gzip member of its own and notes its offset. `archive` writes the archives and, as a table of its own,
the sidecar index of offsets, by which a reader can fetch one record. `read_back` fetches records through that index.

Archives are rows of a Parquet table in the shared folder (archive name, bytes), so executors on other machines see them and
any store that Spark writes to will do. An archive closes at ARCHIVE_BYTES of records, so a task holds one archive and one page
at most, whatever its partition holds.

Scale: equal payloads meet as (digest, page id) in an aggregation that map tasks combine, so a payload that a third of all pages share is a row a
task. What tells revisits from responses then meets the pages in one join, in which payloads are shuffled once, by digest and one of SALTS salts, so that
a hot digest is no task's; where few payloads repeat, Spark sends that table to the tasks instead and nothing is shuffled. Archives meet their index by name.

Defined results: null html is an empty payload; a null url is written as empty. Of equal payloads, those with the smallest
page_id respond (rows that repeat that page_id all respond); a null page_id counts as larger than others and refers_to is then
as usual; if all page_ids of a payload are null, all respond. An archive that breaks off keeps its whole records and is named by `normalise`; records of other kinds or makers are read with a null page_id. Very long pages are records of their own archive. An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import count
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, shared_folder, written

ARCHIVE_BYTES = 4 << 20
#: Fixed value of the format's deduplication rule here: smaller payloads always respond.
LEAST_REVISIT = 100
SALTS = 16
GZIP = 31
LEVEL = 6
PIECE = 1 << 16
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

ARCHIVES = "archive string, content binary"
INDEX = "archive string, n long, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = "record_id string, target_uri string, refers_to_id string"


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to)."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    one = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = one.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that its size is known when it meets the pages
    first = written(first, "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    salted = one.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(first, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record_id(page_id: int | None, digest: str) -> str:
    """A name that the page's record has wherever it is written."""
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response holds an HTTP message, a revisit the headers of one; the headers of either tell the full payload's digest and length."""
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", *([] if page_id is None else [f"X-Page-ID: {page_id}"])]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    block = message if kind == "revisit" else message + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def write_monolithic(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """(archive, content): each content is one gzip stream over its records, all of one date (by default that of the call, so that a task that runs again writes the same bytes)."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, squeeze, parts, size = hashlib.sha256(), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0
        task, number = TaskContext.get().partitionId(), count()  # archives of equal records have names of their own

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"{names.hexdigest()[:24]}-{task}-{next(number)}.warc.gz"], "content": [b"".join([*parts, squeeze.flush()])]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "record_type", "refers_to")]
            for k in range(batch.num_rows):
                values = [c[k].as_py() for c in columns]
                data = record(*values, date)
                names.update(f"{values[0]}:{values[3]};".encode())
                parts.append(squeeze.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    names, squeeze, parts, size = hashlib.sha256(), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0
        if size:
            yield close()

    return map_arrow(planned, run, ARCHIVES)


def split_records(content: bytes) -> Iterator[bytes]:
    """The records of a whole-file gzip stream (or of several streams one after another), inflated once and piece by piece. Ends in a ValueError
    after the last whole record if the archive breaks off or what follows is no record."""
    inflate, held, need = zlib.decompressobj(GZIP), bytearray(), None
    data = memoryview(content)
    at = 0
    while at < len(data) or held:
        if at < len(data):
            piece = data[at : at + PIECE]
            at += len(piece)
            try:
                held += inflate.decompress(piece)
            except zlib.error as error:
                raise ValueError(f"the archive cannot be inflated: {error}") from error
            if inflate.eof:
                at -= len(inflate.unused_data)
                inflate = zlib.decompressobj(GZIP)
        elif need is None and END not in held or need is not None and len(held) < need:
            raise ValueError("the archive ends within a record")
        while True:
            if need is None:
                stop = held.find(END)
                if stop < 0:
                    break
                length = headers_of(bytes(held[:stop])).get("content-length", "")
                if not length.isdecimal():
                    raise ValueError("a record without a length")
                need = stop + len(END) + int(length) + len(END)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None


def headers_of(head: bytes) -> dict[str, str]:
    """A record's headers by lower-case name; lines that are none are left out."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, offsets, lengths, broken): every record is a gzip member of its own; offsets and lengths are the sidecar index. Of an archive
    that breaks off, or holds something else than records, the records before that place are kept, and broken names what is wrong (null otherwise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("broken", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                members, offsets, lengths, at, broken = [], [], [], 0, None
                try:
                    for data in split_records(content.as_buffer()):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        members.append(squeeze.compress(data) + squeeze.flush())
                        offsets.append(at)
                        lengths.append(len(members[-1]))
                        at += lengths[-1]
                except ValueError as error:
                    broken = str(error)
                row = {"archive": [name.as_py()], "content": [b"".join(members)], "offsets": [offsets], "lengths": [lengths], "broken": [broken]}
                yield pa.RecordBatch.from_pydict(row, schema=schema)

    return map_arrow(archives, run, f"{ARCHIVES}, offsets array<long>, lengths array<long>, broken string")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index alone, a row for each record."""
    return normalised.select("archive", F.posexplode(F.arrays_zip("offsets", "lengths"))).select("archive", F.col("pos").cast("long").alias("n"), F.col("col.offsets").alias("offset"), F.col("col.lengths").alias("length"))


def _read(member: bytes) -> tuple:
    head, _, rest = zlib.decompress(member, GZIP).partition(END)
    headers = headers_of(head)
    number = lambda name: int(headers[name]) if headers.get(name, "").removeprefix("-").isdecimal() else None
    kind, payload = headers.get("warc-type", ""), rest[: int(headers["content-length"])]
    if headers.get("content-type", "").lower().startswith("application/http"):
        payload = payload.partition(END)[2]
    if kind == "revisit":
        scheme, _, digest = headers.get("warc-payload-digest", "").partition(":")
        size, digest = number("x-payload-length"), digest.lower() if scheme.lower() == "sha256" else None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    names = (headers.get(n) for n in ("warc-record-id", "warc-target-uri", "warc-refers-to"))
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page"), *names


def read_back(archives: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """`read_records` without the records' names."""
    return read_records(archives, index).select(*(c.split()[0] for c in READ.split(", ")))


def read_records(archives: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A row for each record of any kind, fetched through the index (`sidecar`; without it, that in the archives' own rows). Digest and size come from the
    bytes read, those of a revisit from its headers. A record of other makers has no page_id, and its payload is what its HTTP message holds, as stored."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in f"{READ}, {NAMES}".split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets, lengths in zip(*(batch.column(n) for n in ("content", "offsets", "lengths")), strict=True):
                whole = content.as_buffer()
                rows = [_read(whole.slice(a, n).to_pybytes()) for a, n in zip(offsets.as_py(), lengths.as_py(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    if index is not None:
        asked = index.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))
        archives = archives.select("archive", "content").join(asked, "archive").select("content", F.col("places.offset").alias("offsets"), F.col("places.length").alias("lengths"))
    return map_arrow(archives.select("content", "offsets", "lengths"), run, f"{READ}, {NAMES}")


def resolved(read: DataFrame) -> DataFrame:
    """Revisits whose headers do not tell their payload's size or digest take them from the record that they refer to, where it was read: one join by record name."""
    named = read.where("record_type <> 'revisit' and record_id is not null").groupBy(F.col("record_id").alias("refers_to_id"))
    found = named.agg(F.min_by(F.struct("payload_bytes", "payload_digest"), F.struct("payload_digest", "payload_bytes")).alias("found"))
    of_revisits = F.col("record_type") == "revisit"
    filled = {n: F.when(of_revisits, F.coalesce(n, F.col(f"found.{n}"))).otherwise(F.col(n)) for n in ("payload_bytes", "payload_digest")}
    return read.join(found, "refers_to_id", "left").withColumns(filled).select(read.columns)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the .warc.gz files below path, for normalise. A file is one row, so 2 GB is the most; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the pages as monolithic archives, then those normalised and their offset index, into folder; returns archives and index as read from there."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_monolithic(records(pages)).write.option("compression", "none").parquet(f"{folder}/monolithic")
    normalise(spark.read.schema(ARCHIVES).parquet(f"{folder}/monolithic")).write.option("compression", "none").parquet(f"{folder}/records")
    sidecar(spark.read.parquet(f"{folder}/records")).write.parquet(f"{folder}/index")
    return spark.read.schema(ARCHIVES).parquet(f"{folder}/records"), spark.read.schema(INDEX).parquet(f"{folder}/index")
