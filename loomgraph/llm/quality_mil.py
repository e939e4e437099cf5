"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention weights
are learned from the documents' labels alone, and the weighted passage encoding is
scored. The model is learned from a bounded sample of labelled documents; every
document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import fresh, give_back, hashed_words, text_buffers

PASSAGE_WORDS = 48
#: Labelled documents that a model is learned from, at most; which ones follows from a hash of doc_id.
SAMPLE = 12_000
#: Passages of one document that are learned from, at most; they lie evenly over its text. Scores are of all passages.
BAG = 400
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 128, 3e-3, 1e-4

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = ("the of and a to in is it that for was on are as with be by at this from or an not le la les de des du un une et en que qui dans pour sur au pas par der die das und zu den von mit ist nicht ein eine auf el los las y del se con no su es al").split()

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!?", b".,;:", b"#$%&*@^~", b"'\"()-", b"<>[]{}=+/\\_`", b"\n"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)  # last: other bytes, of letters beyond ASCII for the most part
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2
HASHED = 48  # numbers into which a passage's words are hashed
FEATURES = _KINDS + 8 + HASHED


def _stop_hashes() -> np.ndarray:
    column = pa.array([" ".join(STOP_WORDS)], pa.large_string())
    return np.sort(next(hashed_words(*text_buffers(column), lower=True))[1])


def passage_features(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text in turn, a row of numbers a passage of 48 words; a text without words has one row of zeros.

    Shares of kinds of characters, word length, stop words, repetition, distinct
    words, capitals, the ends of words, the passage's length, and its words: each is
    added, with a sign, to one of ``HASHED`` numbers that its hash chooses.
    """
    data, offsets = text_buffers(column)
    stops = _stop_hashes()
    for first, hashes, at in hashed_words(data, offsets, lower=True):
        stop = np.isin(hashes, stops)
        for i in range(len(at) - 1):
            n = int(at[i + 1] - at[i])
            if n == 0:
                yield np.zeros((1, FEATURES), np.float32)
                continue
            raw = data[offsets[first + i] : offsets[first + i + 1]]
            yield _features(raw, hashes[at[i] : at[i + 1]], stop[at[i] : at[i + 1]])


def _features(raw: np.ndarray, words: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = len(words)
    cuts = np.arange(0, max(1, n - PASSAGE_WORDS // 3), PASSAGE_WORDS)  # a short rest belongs to the passage before
    kinds = _CLASS[raw]
    solid = (kinds < _KINDS - 1) & (raw != 10)
    begins = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
    ends = np.flatnonzero(solid & np.r_[~solid[1:], True])
    byte_at = begins[cuts]
    passage = np.zeros(len(raw), np.int64)
    passage[byte_at[1:]] = 1
    np.cumsum(passage, out=passage)
    shape = (len(cuts), _KINDS)
    shares = np.bincount(passage * _KINDS + kinds, minlength=shape[0] * shape[1]).reshape(shape).astype(np.float64)
    sizes = np.diff(np.r_[cuts, n]).astype(np.float64)
    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.float64), cuts) / sizes

    owner = np.repeat(np.arange(len(cuts)), sizes.astype(int))
    own = np.unique(words ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(owner[own], minlength=len(cuts))
    again = np.r_[False, words[1:] == words[:-1]]
    again2 = np.r_[[False] * min(2, n), words[2:] == words[:-2]] if n > 2 else np.zeros(n, bool)
    lengths = (ends - begins + 1)[:n]
    rest = [mean(lengths) / 10, mean(stop), mean(again), mean(again2), distinct / sizes, mean((kinds[begins] == 1)[:n]), mean((kinds[ends] > 2)[:n]), np.log1p(sizes) / 4]
    sign = np.where(words >> np.uint64(63) != 0, 1.0, -1.0)
    hashed = np.bincount(owner * HASHED + (words % np.uint64(HASHED)).astype(np.int64), sign, len(cuts) * HASHED).reshape(-1, HASHED) / np.sqrt(sizes)[:, None]
    return np.hstack([shares, np.stack(rest, axis=1), hashed]).astype(np.float32)


# ---------------------------------------------------------------- model


@dataclass
class AttentionModel:
    """tanh encoder, gated attention (tanh times sigmoid), logistic score of the weighted encoding."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # encoder W, b; attention V, U, w; score c, d

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        W, b, V, U, w, c, d = self.weights
        h = np.tanh(x @ W + b)
        t, s = np.tanh(h @ V), 1 / (1 + np.exp(-np.clip(h @ U, -30, 30)))
        e = (t * s) @ w
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))
        return p, z, a, h, t, s, owner

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(bags).astype(np.float64) - self.mean) / self.scale
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        return self.forward(x, starts)[0]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        W, b, V, U, w, c, d = self.weights
        p, z, a, h, t, s, owner = self.forward(x, starts)
        r = (p - y) / len(y)
        dz = r[:, None] * c
        da = (dz[owner] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        dh = a[:, None] * dz[owner]
        dts = de[:, None] * w
        dt, dsig = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh += dt @ V.T + dsig @ U.T
        dpre = dh * (1 - h**2)
        return [x.T @ dpre, dpre.sum(axis=0), h.T @ dt, h.T @ dsig, (t * s).T @ de, z.T @ r, np.array([r.sum()])]


def learn(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> AttentionModel | None:
    """A model from bags of passages and their documents' labels, by Adam; none if there are no bags."""
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3
    del every
    shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
    model = AttentionModel(mean, scale, [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] > 1 else np.zeros(s) for s in shapes])
    model.weights[1] = np.zeros(HIDDEN)
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            starts = np.r_[0, np.cumsum([len(bags[i]) for i in pick])[:-1]]
            step += 1
            for j, g in enumerate(model.gradients(np.concatenate([bags[i] for i in pick]).astype(np.float64), starts, labels[pick])):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g**2
                model.weights[j] = model.weights[j] - rate * (m[j] / (1 - 0.9**step) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8) + DECAY * model.weights[j])
    return model


# ---------------------------------------------------------------- on tables


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | None:
    """Learns from at most about ``sample`` labelled documents outside fold 1.

    Labels that repeat or disagree are averaged; null labels and ids count as none. Of
    rows that repeat an id the least text is learned from, and of a text ``BAG`` passages
    at most, so that what comes to the driver is bounded.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [x[np.linspace(0, len(x) - 1, BAG).astype(int)] if len(x) > BAG else x for x in passage_features(batch.column(1))]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in bags], pa.binary())], names=["doc_id", "quality", "bag"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # the sample's size bounds what is sent
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = chosen.mapInArrow(run, "doc_id long, quality double, bag binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return learn(bags, np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, model: AttentionModel | None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with its score (0 to 1) and whether that is 0.5 or more, under ``names``; without a model every score is 0.5.

    Null and empty texts are scored like a text of nothing. Columns of such names are replaced. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in names]
    at = own.index("text")
    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                bags = list(passage_features(part.column(at)))
                scores = held.value.scores(bags) if held.value and bags else np.full(len(bags), 0.5)
                yield pa.record_batch([*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*own, *names])
        give_back()

    return docs.select(*own).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, unchanged in every column."""
    names = fresh("score", docs.columns), fresh("predicted", docs.columns)
    return score(docs, fit(docs, labels), names).where(F.col(names[1]) == 1).select(*docs.columns)
