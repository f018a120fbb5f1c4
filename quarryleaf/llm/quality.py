"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm import textbuf
from quarryleaf.llm.common import batches, kept_rows, texts, written

BITS = 18
#: Labelled rows that a model is fitted on, at most; those with the smallest hash of their id, and of these no more than
#: have so many features together (16 bytes each on the driver).
FIT_ROWS, FIT_FEATURES = 4096, 1 << 23
_SCALE = 20.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48


def ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of each n-gram occurrence of all rows, and the rows' offsets.

    Of each word: the word (A-Z lower-cased), its shape (runs of capitals, other letters and digits as one character
    each), the pairs of words and of shapes with the word before, and whether it repeats that word.
    """
    data, off = textbuf.raw_bytes(text)
    starts, ends = textbuf.spans(data, off, textbuf.SPACES)
    word = textbuf.hash_spans(textbuf.LOWER[data], starts, ends)
    row_of = np.searchsorted(starts, off, side="left")
    shape = _SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    form = textbuf.hash_spans(shape[keep], upto[starts], upto[ends])
    chained = np.ones(len(word), dtype=bool)
    chained[row_of[:-1][row_of[:-1] < len(word)]] = False
    before_w, before_f = np.roll(word, 1), np.roll(form, 1)
    u = np.uint64
    kinds = np.stack([
        word, textbuf.mix(form + u(1)),
        np.where(chained, textbuf.mix(before_w * u(3) + word), u(2)),
        np.where(chained, textbuf.mix(before_f * u(5) + form + u(3)), u(4)),
        np.where(chained & (before_w == word), u(6), u(8)),
    ], axis=1) if len(word) else np.zeros((0, 5), np.uint64)
    return (textbuf.mix(kinds.reshape(-1)) >> u(64 - BITS)).astype(np.int32), row_of * 5


class FollowTheLeader:
    """FTRL-proximal logistic regression: per-coordinate rates, L1 and L2; the last weight is the intercept."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows open to training: crc32 of the id's text, modulo 3, is not 1; contradicting labels
    of one id count as their majority, 1 on a tie; nulls don't count."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label is not null")
    return known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, epochs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of a model of the label, fitted on at most fit_rows labelled documents of the open folds.

    Executors turn the chosen texts (whole) into sparse counts; the driver runs the updates, in the order of the ids'
    hashes, as far as fit_features last (one document at least). Of a repeated id the text with the smallest hash is
    learnt. Null texts count as empty; without a labelled document the weights are 0 and every score 0.5.
    """
    chosen = labelled(labels, label_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def counts(it):
        for b in batches(it):
            feature, off = ngrams(b.column("text"))
            at, x = [], []
            for i, j in zip(off[:-1], off[1:], strict=True):
                ids, n = np.unique(feature[i:j], return_counts=True)
                at.append(ids)
                x.append((n * (_SCALE / max(1, j - i))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32())), pa.array([len(a) for a in at], pa.int32())], ["doc_id", "label", "at", "x", "n"])

    # at most fit_rows ids of 16 bytes: a proven bound for the broadcast
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    made = written(rows.mapInArrow(counts, "doc_id long, label int, at array<int>, x array<float>, n int"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sizes = made.select("doc_id", "n").orderBy(*order).collect()  # fit_rows rows
    some = max(1, int(np.searchsorted(np.cumsum([r.n for r in sizes] or [0]), fit_features, side="right")))
    seen = made.orderBy(*order).limit(some).toArrow()
    model = FollowTheLeader()
    at, x, y = seen.column("at").combine_chunks(), seen.column("x").combine_chunks(), seen.column("label").to_pylist()
    for _ in range(epochs):
        for k, label in enumerate(y):
            model.learn(at[k].values.to_numpy(), x[k].values.to_numpy().astype(np.float64), label)
    return model.weights().astype(np.float32)


def logits(text: pa.Array, w: np.ndarray) -> np.ndarray:
    """Sparse dot products of all rows with the weights."""
    feature, off = ngrams(text)
    n = np.diff(off)
    return np.bincount(np.repeat(np.arange(len(n)), n), weights=w[feature], minlength=len(n)) * _SCALE / np.maximum(n, 1) + w[-1]


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (double, 0 to 1), predicted (1 if score >= 0.5) of each row, over its whole text.

    A score is a sparse dot product: mean weight of the text's n-grams, and the intercept. Null text counts as empty;
    rows with a null id are scored as well."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def dot(it):
        w = shared.value
        for b in batches(it):
            s = 1 / (1 + np.exp(-np.clip(logits(b.column("text"), w), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(dot, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents predicted good, all columns, in one pass without a shuffle; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def good(text: pa.Array) -> np.ndarray:
        return logits(text, shared.value) >= 0

    return kept_rows(docs, text_col, good)
