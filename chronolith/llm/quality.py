"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: hashed words, word pairs and
character trigrams, as many as there are in the whole text.  A softmax layer on the mean gives
the probability of label 1.  Vectors and layer are trained by minibatch gradient descent
in numpy on the driver, on the labelled documents that come first by a hash of the id:
``SAMPLE`` of them at most, and as many as have ``SAMPLE_BYTES`` of text together (a longer
document is left out, the next are tried).  Only the hashed counts of those travel.

The layer is linear, so a document's score is the mean of one number per feature.  The
executors get that table (one float for each hash bucket) and score whole texts.

A pair of equal words counts as one feature of its own, whatever the word.

Defined results: null and empty texts have no features and get the score of the bias;
documents with null ids are scored and never used to learn; labels other than 0 and 1
and null labels are ignored; of several labels of an id, each counts; repeated rows are rows
of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import streamed
from .words import Words, blocks, mix

BITS = 17
DIMENSIONS = 8
SAMPLE = 5000
#: Counts of a text take some four times its bytes at the driver.
SAMPLE_BYTES = 24 << 20
EPOCHS = 8
BATCH = 50
RATE = 6.0
THRESHOLD = 0.3
_U = np.uint64
_SAME = 1
#: Bytes of a character of 0 to 4 bytes.
_CHARACTER = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all texts, the text of each, and the number of features of each text."""
    words = Words(texts)
    mask = _U((1 << BITS) - 1)
    h = words.hashes(3)
    of_word = np.repeat(np.arange(len(texts)), words.counts)
    pair = of_word[1:] == of_word[:-1]
    pairs = np.where(h[1:] == h[:-1], _U(_SAME), mix(h[1:] * _U(0x9FB21C651E98DF25) + h[:-1]) & mask)[pair]
    raw = words.buf
    first = np.flatnonzero((raw[:-8] & 0xC0) != 0x80)  # bytes that begin a character
    size = np.diff(np.append(first, len(raw) - 8))
    view = np.lib.stride_tricks.as_strided(raw[:4].view(np.uint32), (len(raw) - 7,), (1,))
    chars = (view[first] & _CHARACTER[np.minimum(size, 4)]).astype(np.uint64)
    of_char = np.searchsorted(words.bounds, first, "right") - 1
    n = max(len(chars) - 2, 0)
    grams = mix((chars[:n] * _U(0x9E3779B97F4A7C15) + chars[1 : n + 1]) * _U(0xC2B2AE3D27D4EB4F) + chars[2 : n + 2]) & mask
    inside = of_char[:n] == of_char[2 : n + 2]
    found = np.concatenate([h & mask, pairs, grams[inside]]).astype(np.int64)
    owner = np.concatenate([of_word, of_word[1:][pair], of_char[:n][inside]])
    return found, owner, np.bincount(owner, minlength=len(texts))


@dataclass(frozen=True)
class Classifier:
    #: What a feature adds to the logit of label 1, times the number of features.
    table: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, j in blocks(texts, 1 << 20):
            found, owner, n = features(texts[i:j])
            out[i:j] += np.bincount(owner, self.table[found], minlength=j - i) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-out))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder mod 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of at most ``sample`` labelled documents that are not held out, with at most ``sample_bytes`` of text."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"))
    first = known.orderBy(*order).limit(sample)
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(first), "doc_id").groupBy("doc_id", "quality").agg(F.sum("size").alias("size")).orderBy(*order).collect()
    fits, held = [], 0
    for r in sizes:
        if held + (r["size"] or 0) <= sample_bytes:
            fits.append((r["doc_id"], r["quality"]))
            held += r["size"] or 0
    chosen = docs.sparkSession.createDataFrame(fits, "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(batch.column(1), 1 << 20):
                found, owner, n = features(batch.column(1)[i:j])
                order = np.argsort(owner, kind="stable")
                ids, counts = zip(*(np.unique(x, return_counts=True) for x in np.split(found[order], np.cumsum(n)[:-1])), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array([x.astype(np.int32).tobytes() for x in ids], pa.binary()), pa.array([(c / max(c.sum(), 1)).astype(np.float32).tobytes() for c in counts], pa.binary())],
                    ["doc_id", "quality", "ids", "shares"],
                )

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(streamed(run), "doc_id long, quality int, ids binary, shares binary")
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("ids", "ascending")])
    return [(q, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for q, i, s in zip(got["quality"].to_pylist(), got["ids"].to_pylist(), got["shares"].to_pylist(), strict=True)]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Classifier:
    """Train vectors and softmax layer; without rows, or with one class only, the prior is the score."""
    size = 1 << BITS
    ones = sum(q for q, _, _ in rows)
    prior = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    if not rows or ones in (0, len(rows)):
        return Classifier(np.zeros(size, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.array([0.0, prior], np.float32)
    steps = epochs * -(-len(rows) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            pace = rate * (1 - step / steps)
            step += 1
            label = np.array([q for q, _, _ in part])
            sizes = np.array([len(i) for _, i, _ in part])
            ids = np.concatenate([i for _, i, _ in part])
            share = np.concatenate([s for _, _, s in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            weighted = vectors[ids] * share[:, None]
            mean = np.stack([np.bincount(doc, weighted[:, k], len(part)) for k in range(DIMENSIONS)], 1).astype(np.float32)
            logit = mean @ layer + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), label] -= 1
            p /= len(part)
            back = p @ layer.T
            layer -= pace * (mean.T @ p)
            bias -= 0.1 * pace * p.sum(0)
            touched, inverse = np.unique(ids, return_inverse=True)
            change = back[doc] * share[:, None]
            grad = np.stack([np.bincount(inverse, change[:, k], len(touched)) for k in range(DIMENSIONS)], 1)
            vectors[touched] -= (pace * len(part) * grad).astype(np.float32)
    return Classifier((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(streamed(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
