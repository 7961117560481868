"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import GOLDEN, IS_WORD, Words, mix64, slices
from ._names import Named

#: Weights, labelled documents used at most, passes over them.
BUCKETS, MAX_TRAINING_DOCS, EPOCHS = 1 << 18, 4000, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Byte classes of a word's shape: lower case and UTF-8 tails, capitals, digits, others.
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[33:128] = np.arange(33, 128)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text: bucket numbers, and the offsets of the texts.

    A word gives its letters (A-Z lower-cased) and its shape, which is its runs of
    byte classes: capitals, small letters, digits, and each mark by itself.  N-grams:
    the word, the pair of words, one, two and three shapes, and whether a word repeats
    one of the two before it.
    """
    words = Words(texts)
    n = len(words.hash)
    if not n:
        return np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    data = words.data
    cls = np.where(IS_WORD[data], _CLASS[data], 0)
    change = np.empty(len(data), dtype=bool)
    change[0] = True
    change[1:] = cls[1:] != cls[:-1]
    at = np.flatnonzero(change & (cls > 0))
    order = np.searchsorted(at, words.starts)
    within = np.arange(len(at)) - np.repeat(order, np.diff(np.append(order, len(at))))
    coded = mix64((cls[at].astype(np.uint64) << np.uint64(8)) + np.minimum(within, 7).astype(np.uint64))
    shape = np.add.reduceat(coded, order)
    low = Words([_LOWER[np.frombuffer(t, dtype=np.uint8)].tobytes() for t in texts]).hash
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))

    def gram(parts: list[np.ndarray], salt: int) -> np.ndarray:
        """Of a word and those before it; 0 stands for what is before the text."""
        h = np.full(n, salt, dtype=np.uint64)
        for back, x in enumerate(parts):
            y = np.zeros(n, dtype=np.uint64)
            y[back:] = np.where(owner[back:] == owner[:n - back], x[:n - back], np.uint64(0))
            h = mix64((h ^ y) * GOLDEN)
        return h

    def before(x: np.ndarray, back: int) -> np.ndarray:
        y = np.zeros(n, dtype=bool)
        y[back:] = (x[back:] == x[:n - back]) & (owner[back:] == owner[:n - back])
        return y

    again = (before(low, 1).astype(np.uint64) + np.uint64(2) * before(low, 2).astype(np.uint64))
    grams = np.stack([gram([low], 1), gram([low, low], 2), gram([shape], 3), gram([shape] * 2, 4),
                      gram([shape] * 3, 5), gram([again, again], 6)], axis=1)
    return (grams.reshape(-1) % np.uint64(buckets)).astype(np.int64), words.offsets * grams.shape[1]


@dataclass
class Ftrl:
    """Follow-the-regularised-leader: per-coordinate rates, L1 and L2 in closed form."""

    buckets: int = BUCKETS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.buckets + 1), np.zeros(self.buckets + 1)

    def weights(self, at: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if at is None else (self.z[at], self.n[at])
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


#: Shares of n-grams are multiplied by it, so that a weight and the bias move alike.
SCALE = 10.0


def train(texts: list[bytes], labels: list[int], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) from a sample, in a fixed pseudo-random order."""
    rows = []
    for a, b in slices(texts):
        found, at = features(texts[a:b], buckets)
        for i in range(b - a):
            where, count = np.unique(found[at[i]:at[i + 1]], return_counts=True)
            rows.append((np.append(where, buckets), np.append(SCALE * count / max(count.sum(), 1), 1.0)))
    model, order = Ftrl(buckets), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], labels[i])
    return model.weights().astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "label", max_docs: int = MAX_TRAINING_DOCS, buckets: int = BUCKETS) -> np.ndarray:
    """Train on at most ``max_docs`` labelled documents, those with the least id hashes.

    ``labels`` has ids and 0/1 labels; null labels are left out, of several for an id the
    least counts.  The sample is bounded by that parameter, so its ids are broadcast and
    one task trains on it; only the weights (``buckets`` + 1 floats, 1 MB) come back.
    Without any labelled document all weights are 0 and every score is 0.5.
    """
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("label"))
              .orderBy(F.xxhash64(id_col), id_col).limit(max_docs))
    sample = (docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
              .select("text", "label", F.col(id_col).alias("id")))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(batch.column(2).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist(),
                        batch.column(1).to_pylist(), strict=True)
        if rows:
            rows.sort()
            weights = train([r[1] for r in rows], [r[2] for r in rows], buckets)
            yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()]})

    found = sample.repartition(1).mapInArrow(learn, "weights binary").collect()  # one row at most
    return np.frombuffer(found[0][0], dtype=np.float32) if found else np.zeros(buckets + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on) to ``docs``.

    Each text is scored whole, as a sparse dot product of its n-gram shares and the
    broadcast weights (1 MB, whatever the input).  Null and empty texts get the score of
    the bias alone.  Repeated rows get equal scores.  Columns may have any names; those with
    the names of added ones are replaced.
    """
    named = Named(docs, ["score", "predicted"])
    text_col, columns = named.plain(text_col), named.kept
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        buckets, bias = len(w) - 1, float(w[-1])
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            parts = [np.empty(0)]
            for a, b in slices(texts):
                found, at = features(texts[a:b], buckets)
                sums = np.concatenate(([0.0], np.cumsum(w[found], dtype=np.float64)))
                parts.append(SCALE * (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1))
            value = np.round(1 / (1 + np.exp(-np.clip(np.concatenate(parts) + bias, -35, 35))), 9)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(value, pa.float64()),
                 pa.array((value >= cut).astype(np.int32), pa.int32())], names=[*columns, "score", "predicted"])

    schema = T.StructType(named.fields() + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return named.back(named.df.mapInArrow(apply, schema), "score", "predicted")
