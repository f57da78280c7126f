"""Media columns as baseline JPEG: parse markers, Huffman-decode the scans, rebuild DC-only luminance thumbnails in numpy.

`encode` stores bytes as a grey baseline JPEG whose DC-only thumbnail is those bytes: each byte is an 8x8 block of one value
(DC coefficient byte - 128 at a DC step of 8, no AC), 192 blocks a row, and each row of blocks is a restart interval. So the
stored form is a valid image, and reading its thumbnail back is lossless. A side of a JPEG has at most 65535 samples, so longer
payloads become several images one after another.

`thumbnails` decodes baseline JPEGs in general: any Huffman tables, restart intervals, sampling factors and interleaved
components. Huffman codes must be read one after another, but restart intervals do not depend on each other, so all intervals
of a group of images advance in step: each numpy operation reads one symbol of every interval.

Scale: both directions are map-only; work is cut into groups of GROUP_BYTES whatever the rows' sizes, and a longer text into its images (1.5 MB each), so memory does not
depend on a partition's rows, and on a text's length only as far as its bytes must be held. Copies cost what other rows cost, and nothing is gathered.

Defined results: equal texts have equal values, whatever rows stand beside them; null or empty text is stored as one row of 192 spaces; what is no baseline JPEG has null features;
repeated rows give repeated rows; an empty table gives an empty result; other columns of the input pass through untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.common import map_arrow

ROW = 192
MOST_ROWS = 8191
GROUP_BYTES = 1 << 20
FILL = 32

# --- the tables that encode() writes: DC categories 0 to 8 in four bits each, and one AC symbol, end of block, in one bit
DC_SYMBOLS = bytes(range(9))
DC_LENGTHS = bytes([0, 0, 0, 9] + [0] * 12)
AC_SYMBOLS = bytes([0])
AC_LENGTHS = bytes([1] + [0] * 15)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    """From the start of the image to its scan, for an image of rows x 192 blocks."""
    size = (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big")
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63)),
        _segment(0xC0, bytes([8]) + size + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + DC_LENGTHS + DC_SYMBOLS),
        _segment(0xC4, bytes([0x10]) + AC_LENGTHS + AC_SYMBOLS),
        _segment(0xDD, ROW.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference of d, at d + 255: the bits of its block (category, difference, end of block) and how many."""
    d = np.arange(-255, 256)
    size = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
    low = np.where(d > 0, d, d + (1 << size) - 1)
    return ((size << size | low) << 1).astype(np.uint32), (4 + size + 1).astype(np.int64)


CODES, LENGTHS = _block_codes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 192 bytes, as JPEG images one after another."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    values = data.astype(np.int16)
    step = np.diff(values, axis=1, prepend=np.int16(128)) + 255
    length = LENGTHS[step]
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) >> 3
    base = np.r_[0, np.cumsum(size)]
    at = ends - length + base[:-1, None] * 8
    word = (CODES[step].astype(np.int64) << (24 - length - (at & 7))).ravel()
    byte = (at >> 3).ravel()
    total = int(base[-1]) + 3
    bits = sum(np.bincount(byte + k, weights=(word >> (16 - 8 * k)) & 255, minlength=total) for k in range(3))[: base[-1]].astype(np.uint8)
    rest = size * 8 - ends[:, -1]
    bits[base[1:] - 1] |= ((1 << rest) - 1).astype(np.uint8)  # a row is filled up with ones
    # each FF is followed by 00, each row by its restart marker or, after the last of an image, by the end of the image
    full = bits == 255
    stuffed = np.r_[0, np.cumsum(full)]
    where = np.arange(len(bits)) + stuffed[:-1] + 2 * np.repeat(np.arange(len(size)), size)
    row_end = base[1:] + stuffed[base[1:]] + 2 * np.arange(1, len(size) + 1)
    out = np.zeros(int(row_end[-1]), np.uint8)
    out[where] = bits
    out[row_end - 2] = 255
    rows_of = np.array([len(p) // ROW for p in payloads])
    first = np.r_[0, np.cumsum(rows_of)]
    within = (np.arange(len(size)) - np.repeat(first[:-1], rows_of)) % MOST_ROWS
    out[row_end - 1] = 0xD0 + within % 8
    last = within == MOST_ROWS - 1
    last[first[1:] - 1] = True
    out[row_end[last] - 1] = 0xD9
    body, starts, images = out.tobytes(), np.r_[0, row_end], []
    for k in range(len(payloads)):
        parts = []
        for r in range(first[k], first[k + 1], MOST_ROWS):
            stop = min(r + MOST_ROWS, first[k + 1])
            parts += [header(int(stop - r)), body[starts[r] : starts[stop]]]
        images.append(b"".join(parts))
    return images


# --- reading


@dataclass
class Image:
    """What the markers of one baseline image say; scan is where its entropy-coded bytes start and stop."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantisation table)
    steps: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id): (lengths, symbols)
    chosen: dict = field(default_factory=dict)  # component id: (DC table, AC table)
    interval: int = 0
    start: int = 0
    stop: int = 0

    def blocks(self) -> list[tuple[int, int]]:
        """The blocks of a unit of the scan: (component, its number in the unit)."""
        if len(self.components) == 1:
            return [(0, 0)]
        return [(c, n) for c, (_, h, v, _) in enumerate(self.components) for n in range(h * v)]

    def units(self) -> tuple[int, int]:
        """Units across and down."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = (max(c[k] for c in self.components) for k in (1, 2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> list[Image]:
    """The images of data, or [] if it is no sequence of baseline JPEGs with one scan each."""
    images, at = [], 0
    try:
        while at < len(data):
            if data[at : at + 2] != b"\xff\xd8":
                return []
            image, at = Image(), at + 2
            while True:
                marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                body, at = data[at + 4 : at + 2 + n], at + 2 + n
                if marker == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        image.steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                        body = body[1 + 64 * (1 + wide) :]
                elif marker == 0xC0:
                    image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                    image.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
                elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    return []
                elif marker == 0xC4:
                    while body:
                        n = sum(body[1:17])
                        image.tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                        body = body[17 + n :]
                elif marker == 0xDD:
                    image.interval = int.from_bytes(body, "big")
                elif marker == 0xDA:
                    image.chosen = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                    break
            if not image.components or len(image.chosen) != len(image.components):
                return []
            image.start = at
            at = data.index(b"\xff\xd9", at) + 2
            image.stop = at - 2
            images.append(image)
    except (IndexError, ValueError):
        return []
    return images


def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + length of its code; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[code << (16 - n) : (code + 1) << (16 - n)] = symbols[k] * 32 + n
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and where each interval starts in them."""
    after = np.flatnonzero(data[:-1] == 255)
    follows = data[after + 1]
    drop = np.zeros(len(data), bool)
    drop[after[follows == 0] + 1] = True
    marks = after[(follows & 0xF8) == 0xD0]
    drop[marks] = drop[marks + 1] = True
    kept = np.cumsum(~drop)
    return data[~drop], np.r_[0, kept[marks]]


def decode_dc(datas: list[bytes], images: list[list[Image]]) -> list[list[np.ndarray]]:
    """For each image its DC-only luminance thumbnail, a sample for each block of the first component, uint8."""
    flat = [(k, image) for k, row in enumerate(images) for image in row]
    by_tables: dict = {}
    for n, (_, image) in enumerate(flat):
        key = (tuple(sorted(image.tables.items())), tuple(image.components), tuple(sorted(image.chosen.items())))
        by_tables.setdefault(key, []).append(n)
    out: dict[int, np.ndarray] = {}
    for group in by_tables.values():
        for n, thumb in zip(group, _decode_alike([(datas[flat[n][0]], flat[n][1]) for n in group]), strict=True):
            out[n] = thumb
    result: list[list[np.ndarray]] = [[] for _ in images]
    for n, (k, _) in enumerate(flat):
        result[k].append(out[n])
    return result


def _decode_alike(group: list[tuple[bytes, Image]]) -> list[np.ndarray]:
    """Thumbnails of images with the same tables and components; one symbol of every interval at a time."""
    lead = group[0][1]
    blocks = lead.blocks()
    kinds = sorted({(c, t) for pair in lead.chosen.values() for c, t in zip((0, 1), pair, strict=True)})
    tables = np.concatenate([lookup(*lead.tables[kind]) for kind in kinds])
    table_of = {kind: n << 16 for n, kind in enumerate(kinds)}
    dc_of = np.array([table_of[0, lead.chosen[lead.components[c][0]][0]] for c, _ in blocks])
    ac_of = np.array([table_of[1, lead.chosen[lead.components[c][0]][1]] for c, _ in blocks])
    component = np.array([c for c, _ in blocks])
    pieces, starts, todo, first, base, offset = [], [], [], [], 0, 0
    for data, image in group:
        bits, at = _intervals(np.frombuffer(data, np.uint8, image.stop - image.start, image.start))
        across, down = image.units()
        units = across * down
        each = image.interval or units
        if len(at) != -(-units // each):
            at = at[:1]
            each = units
        counts = np.minimum(each, units - each * np.arange(len(at))) * len(blocks)
        pieces += [bits, np.full(8, 255, np.uint8)]
        starts.append(at + base)
        todo.append(counts)
        first.append(offset + each * len(blocks) * np.arange(len(at)))
        base += len(bits) + 8
        offset += units * len(blocks)
    data = np.concatenate(pieces).astype(np.int64)
    wide = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # 32 bits from each byte on
    at, left, slot = np.concatenate(starts) * 8, np.concatenate(todo), np.concatenate(first)
    value = np.zeros(offset, np.int32)
    limit, k = len(wide) - 1, np.zeros(len(at), np.int64)
    block, previous = np.zeros(len(at), np.int64), np.zeros((len(at), len(lead.components)), np.int64)
    alone = len(blocks) == 1
    while len(at):
        window = wide[np.minimum(at >> 3, limit)] << (at & 7)
        dc = k == 0
        entry = tables[(window >> 16 & 0xFFFF) + (np.where(dc, dc_of[0], ac_of[0]) if alone else np.where(dc, dc_of[block], ac_of[block]))]
        symbol, used = entry >> 5, entry & 31
        size = np.where(dc, symbol, symbol & 15)
        at = at + used
        if dc.any():
            on = np.flatnonzero(dc)
            n = size[on]
            raw = (wide[np.minimum(at[on] >> 3, limit)] << (at[on] & 7) >> (32 - n)) & ((1 << n) - 1)
            diff = np.where((n > 0) & (raw < 1 << np.maximum(n - 1, 0)), raw - (1 << n) + 1, raw)
            c = 0 if alone else component[block[on]]
            previous[on, c] += diff
            value[slot[on]] = previous[on, c]
        at = at + size
        k = np.where(dc, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        k = np.where(used == 0, 64, k)  # no such code: the image is damaged, go on
        done = k >= 64
        if done.any():
            k = np.where(done, 0, k)
            slot = slot + done
            left = left - done
            block = block if alone else (block + done) % len(blocks)
            if not left.all():
                keep = left > 0
                at, left, slot, k, block, previous = at[keep], left[keep], slot[keep], k[keep], block[keep], previous[keep]
    thumbs, offset = [], 0
    for _, image in group:
        across, down = image.units()
        n = across * down * len(blocks)
        mine = value[offset : offset + n].reshape(down, across, len(blocks))[:, :, [k for k, (c, _) in enumerate(blocks) if c == 0]]
        offset += n
        h, v = (1, 1) if alone else image.components[0][1:3]
        grid = mine.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        rows, columns = (-(-image.height // 8), -(-image.width // 8)) if not alone else grid.shape
        samples = grid[:rows, :columns] * image.steps.get(image.components[0][3], 1) / 8 + 128
        thumbs.append(np.clip(np.rint(samples), 0, 255).astype(np.uint8))
    return thumbs


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than their mean."""
    rows, columns = (np.linspace(0, n, 9).astype(int)[:-1] for n in thumb.shape)
    sums = np.add.reduceat(np.add.reduceat(thumb, rows, axis=0, dtype=np.int64), columns, axis=1)
    heights, widths = (np.maximum(np.diff(np.r_[at, n]), 1) for at, n in zip((rows, columns), thumb.shape, strict=True))
    cells = sums / np.outer(heights, widths)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def _grouped(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes([FILL]) * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def encode_long(data: bytes) -> bytes:
    """encode of one payload, an image at a time."""
    return b"".join(encode([data[at : at + MOST_ROWS * ROW]])[0] for at in range(0, len(data), MOST_ROWS * ROW))


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its text (and any columns of these names) replaced by n_bytes and media, the text's payload as JPEG."""
    others = [f for f in df.schema.fields if f.name not in (text_col, "n_bytes", "media")]
    df = df.select(*[f.name for f in others], text_col)
    schema = T.StructType([*others, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.names.index(text_col)).cast(pa.binary())
            rest = batch.drop_columns([text_col])
            sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in raw])
            for a, b in _grouped(sizes.tolist(), GROUP_BYTES):
                media = [encode_long(payload(raw[a].as_py()))] if b - a == 1 else encode([payload(raw[k].as_py()) for k in range(a, b)])
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes[a:b], pa.int64()), pa.array(media, pa.binary())], names=[*part.schema.names, "n_bytes", "media"])

    return map_arrow(df, run, schema)


FEATURES = [("width", T.LongType()), ("height", T.LongType()), ("thumb_hash", T.StringType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())]
ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with its media replaced by dimensions, thumbnail hash, and digests of the thumbnail's samples (payload) and of the media.
    Columns of these names are replaced."""
    made = {n for n, _ in FEATURES}
    others = [f for f in df.schema.fields if f.name != media_col and f.name not in made]
    df = df.select(*[f.name for f in others], media_col)
    schema = T.StructType([*others, *[T.StructField(n, t) for n, t in FEATURES]])

    def row(data: bytes | None, images: list[Image], thumbs: list[np.ndarray]) -> tuple:
        if data is None or not thumbs:
            return (None,) * 6 + ((None,) * 2 if data is None else (len(data), hashlib.sha256(data).hexdigest()))
        whole = thumbs[0] if len(thumbs) == 1 else np.concatenate([t for t in thumbs if t.shape[1] == thumbs[0].shape[1]])
        back = b"".join(t.tobytes() for t in thumbs)
        return images[0].width, sum(i.height for i in images), average_hash(whole), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.schema.names.index(media_col))
            rest = batch.drop_columns([media_col])
            for a, b in _grouped([x.as_buffer().size if x.is_valid else 0 for x in media], GROUP_BYTES):
                datas = [media[k].as_py() for k in range(a, b)]
                images = [parse(x) if x else [] for x in datas]
                # the images of a long text one after another
                thumbs = [[t for i in images[0] for t in decode_dc([datas[0]], [[i]])[0]]] if len(images) == 1 else decode_dc([x or b"" for x in datas], images)
                rows = [row(*x) for x in zip(datas, images, thumbs, strict=True)]
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([r[k] for r in rows], ARROW[t]) for k, (_, t) in enumerate(FEATURES)]], names=[*part.schema.names, *[n for n, _ in FEATURES]])

    return map_arrow(df, run, schema)


def digest(featured: DataFrame, id_col: str = "doc_id") -> DataFrame:
    feature = F.format_string("%dx%d:%s", "width", "height", "thumb_hash")
    return featured.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
