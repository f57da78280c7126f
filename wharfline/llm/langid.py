"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are the runs of 2, 3 and 4 bytes of a text in which ASCII letters are lower-cased and other ASCII is a space; each has a bucket
among BUCKETS. A text is the mean of its subwords' embeddings. `fit` learns embeddings and softmax together by stochastic
gradient descent in numpy, on a sample of at most SAMPLE_ROWS labelled rows (this bound is the only one): an equal share of each
language, one row at least (so of more languages than SAMPLE_ROWS only that many are learned), chosen by hash, so the sample depends on the rows alone and not on how they are partitioned. A fifth of it, held
back, sets the temperature of the softmax and the score below which a prediction is rejected: the least one from which on PRECISION of the
predictions are right, and never less than half the way from chance to the lowest score of a held-back row that is right. So a
text of a language never learned, or of no language, can be rejected even where the learned ones are told apart without fault.

`predict` is map-only. What is broadcast is the model: BUCKETS x DIMENSION embeddings (1 MB) and a layer of DIMENSION numbers a language.
Texts go through whole, BLOCK_BYTES at a time, longer ones in pieces that overlap by a subword, so memory does not grow with a text.

Defined results: null text or no letter (Unicode L; `½` and `Ⅳ` are numbers): `und`, score 0, rejected. No labelled rows: everything is `und`, score 0, rejected. A null
label is not learned from; nor are rows with a null id in `fit_documents`. Of equal scores the first language by name is predicted. Repeated rows give repeated rows;
an empty table an empty result; extra columns pass through `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import map_arrow, written

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
DIMENSION = 8
SAMPLE_ROWS = 2000
EPOCHS = 12
#: Small samples are gone over more often, for at least so many steps.
LEAST_STEPS = 800
BATCH = 32
RATE = 1.0
SEED = 7
#: Of the predictions that are not rejected, this share shall be right on the calibration rows.
PRECISION = 0.98
UNKNOWN = "und"
BLOCK_BYTES = 1 << 19
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Letters, and numbers that are written with letters or fractions, which `has_letter` sorts out.
LETTER = re.compile(r"[^\W\d_]")
GAP = bytes(max(SIZES) - 1)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # an embedding for each bucket and, last, one of zeros
    layer: np.ndarray  # a column for each language
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected


def pieces_of(text: bytes) -> Iterator[tuple[bytes, int]]:
    """The text, or its pieces of BLOCK_BYTES, each with the bytes after it that a subword needs; and how many of those there are."""
    for at in range(0, max(1, len(text)), BLOCK_BYTES):
        piece = text[at : at + BLOCK_BYTES + len(GAP)]
        yield piece, max(0, len(piece) - BLOCK_BYTES)


def subwords(pieces: list[tuple[bytes, int]]) -> Iterator[np.ndarray]:
    """For each size: the bucket at each byte of the pieces, end to end with GAPs (BUCKETS where a run does not fit or the next piece has it)."""
    data = np.frombuffer(b"".join(t.translate(FOLD) + GAP for t, _ in pieces), np.uint8).astype(np.uint32)
    left = np.concatenate([np.arange(len(t), -len(GAP), -1) for t, _ in pieces])
    after = np.repeat([n for _, n in pieces], [len(t) + len(GAP) for t, _ in pieces])
    h = data.copy()
    for size in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ data[size - 1 :]
        if size in SIZES:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            yield np.where((left[: len(h)] >= size) & (left[: len(h)] > after[: len(h)]), mixed >> np.uint32(17), BUCKETS).astype(np.int64)


def counts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and the share of its subwords in each."""
    total = sum(np.bincount(b, minlength=BUCKETS + 1)[:BUCKETS] for piece in pieces_of(text) for b in subwords([piece]))
    on = np.flatnonzero(total)
    return on, total[on] / max(1, total.sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """From (buckets, shares, language) rows."""
    languages = sorted({r[2] for r in rows})
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS + 1, DIMENSION), np.float32), np.zeros((DIMENSION, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(SEED)
    label = np.array([languages.index(r[2]) for r in rows])
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    learn = order[len(rows) // 5 :]
    embed, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSION)), rng.normal(0, 0.1, (DIMENSION, k)), np.zeros(k)

    def gathered(ids: np.ndarray) -> tuple:
        size = np.array([len(rows[i][0]) for i in ids])
        return np.concatenate([rows[i][0] for i in ids]), np.concatenate([rows[i][1] for i in ids]), np.repeat(np.arange(len(ids)), size)

    def means(buckets: np.ndarray, share: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, embed[buckets, d] * share, minlength=n) for d in range(DIMENSION)], axis=1)

    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(learn))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            ids = learn[at : at + BATCH]
            buckets, share, owner = gathered(ids)
            h = means(buckets, share, owner, len(ids))
            error = softmax(h @ layer + bias)
            error[np.arange(len(ids)), label[ids]] -= 1
            error /= len(ids)
            back = error @ layer.T
            layer -= rate * 10 * (h.T @ error)
            bias -= rate * error.sum(axis=0)
            for d in range(DIMENSION):
                np.subtract.at(embed[:, d], buckets, rate * 100 * share * back[owner, d])
    test = held if len(held) else order
    logits = np.concatenate([means(*gathered(test[a : a + BATCH]), len(test[a : a + BATCH])) @ layer + bias for a in range(0, len(test), BATCH)])
    truth = label[test]
    loss = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(test)), truth], 1e-12)).mean() for t in np.geomspace(0.1, 5, 40)}
    temperature = float(min(loss, key=loss.get))
    scores = softmax(logits / temperature)
    return Model(languages, np.vstack([embed, np.zeros((1, DIMENSION))]).astype(np.float32), layer, bias, temperature, max(threshold(scores, truth), least_score(scores, truth)))


def threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The least score from which on PRECISION of the predictions are right; 1 if there is none."""
    best, right = scores.max(axis=1), scores.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    if not len(good):
        return 1.0
    return float(best[order[good[-1]]]) if good[-1] < len(order) - 1 else 0.0


def least_score(scores: np.ndarray, truth: np.ndarray) -> float:
    """Half the way from chance to the lowest score of a right prediction."""
    right = scores.argmax(axis=1) == truth
    chance = 1 / scores.shape[1]
    return float(chance + (scores.max(axis=1)[right].min() - chance) / 2) if right.any() and scores.shape[1] > 1 else 0.0


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """From (id, text, lang), null labels and texts left out. Only bucket counts of the sampled rows reach the driver."""
    known = labelled.where("lang is not null and text is not null")
    # written, so that its size is known when it meets the texts: they stay where they are unless labels are very many
    languages = written(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    n = languages.count()
    if not n:
        return train([])
    each = max(1, rows // n)
    # half as many again as wanted on average, then exactly the least draws
    share = languages.select("lang", F.least(F.lit(1.0), (1.5 * each + 50) / F.col("rows")).alias("share"))
    drawn = known.withColumn("draw", F.xxhash64("id", "text")).join(share, "lang").where(F.pmod("draw", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    schema = pa.schema([("lang", pa.string()), ("draw", pa.int64()), ("buckets", pa.binary()), ("shares", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, number, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
                buckets, shares = counts_of(text.as_py())
                yield pa.RecordBatch.from_pydict({"lang": [lang.as_py()], "draw": [number.as_py()], "buckets": [buckets.astype(np.uint16).tobytes()], "shares": [shares.astype(np.float32).tobytes()]}, schema=schema)

    found = map_arrow(drawn.select("lang", "draw", "text"), features, "lang string, draw long, buckets binary, shares binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 40)), "draw", "buckets"))
    chosen = found.withColumn("place", place).where(F.col("place") <= each).orderBy("place", "draw", "lang").limit(rows)
    taken = [(r["lang"], r["place"], np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in chosen.toLocalIterator()]
    return train([(b, s, lang) for lang, _, b, s in sorted(taken, key=lambda r: r[:2])])


def score_block(model: Model, texts: list[bytes]) -> np.ndarray:
    """Calibrated probabilities, a row for each text."""
    sums, n = np.zeros((len(texts), DIMENSION)), np.zeros(len(texts))
    pieces, owner, size = [], [], 0

    def add() -> None:
        starts = np.cumsum([0] + [len(p) + len(GAP) for p, _ in pieces])[:-1]
        for buckets in subwords(pieces):
            if not len(buckets):  # one empty text
                continue
            at = np.minimum(starts, len(buckets) - 1)
            np.add.at(sums, owner, np.add.reduceat(model.table[buckets], at, axis=0))
            np.add.at(n, owner, np.add.reduceat((buckets != BUCKETS).astype(np.int64), at))

    for k, text in enumerate(texts):
        for piece in pieces_of(text):
            if pieces and size + len(piece[0]) > BLOCK_BYTES:
                add()
                pieces, owner, size = [], [], 0
            pieces.append(piece)
            owner.append(k)
            size += len(piece[0])
    if pieces:
        add()
    return softmax((sums / np.maximum(n, 1)[:, None] @ model.layer + model.bias) / model.temperature)


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then lang_pred, score (0 to 1) and rejected."""
    # its parts, since a broadcast names a class of this package by its module, which executors need not have
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.table, model.layer, model.bias, model.temperature, model.least))

    def answer(text: str | None, p: np.ndarray, m: Model) -> tuple[str, float, bool]:
        if text is None or not m.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        k = int(p.argmax())
        return m.languages[k], float(p[k]), bool(p[k] < m.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rest, a = batch.select(list(range(batch.num_columns - 1))), 0
            while a < len(texts):
                b, size, block = a, 0, []
                while b < len(texts) and (b == a or size < BLOCK_BYTES):
                    block.append((texts[b] or "").encode("utf-8", "replace"))
                    size += len(block[-1])
                    b += 1
                scores = score_block(m, block) if m.languages else np.zeros((len(block), 0))
                rows = [answer(t, p, m) for t, p in zip(texts[a:b], scores, strict=True)]
                new = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *new], names=[*rest.schema.names, "lang_pred", "score", "rejected"])
                a = b

    source = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return map_arrow(source, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Every third document by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """On the documents that are not held out and have an id."""
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"))


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose prediction is not rejected, with their own columns, whatever those are called."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return predict(packed, model, keep=("row",)).where("not rejected").select("row.*")
