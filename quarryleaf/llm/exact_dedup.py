"""Exact duplicate detection by counting quotient filters that merge by their sorted remainders."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm import textbuf
from quarryleaf.llm.common import Rows, batches, bitmap, bits_for, heavy_left_join, in_bits, written

#: A fingerprint's high bits are its quotient, the others its remainder.
QUOTIENT_BITS = 26
_REMAINDER = np.uint64(64 - QUOTIENT_BITS)
_FLUSH = 1 << 21


class CountingQuotientFilter:
    """Fingerprints as runs of ascending remainders under ascending quotients, each with its count; lossless."""

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        c = np.ones(len(f), dtype=np.int64) if counts is None else counts[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(f)), bool), f[1:] != f[:-1])))
        f, c = f[at], np.add.reduceat(c, at) if len(f) else c
        q, lengths = _lengths(f >> _REMAINDER)
        return cls(q, lengths, f & ((np.uint64(1) << _REMAINDER) - np.uint64(1)), c)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.lengths) << _REMAINDER) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Two by two, sorted runs take their places in one another, in the order of quotient and remainder; counts of
        equal fingerprints add up. Nothing is sorted again."""
        runs = [(x.fingerprints(), x.counts) for x in filters]
        while len(runs) > 1:
            runs = [_interleaved(*runs[k : k + 2]) for k in range(0, len(runs), 2)]
        f, c = runs[0]
        q, lengths = _lengths(f >> _REMAINDER)
        return cls(q, lengths, f & ((np.uint64(1) << _REMAINDER) - np.uint64(1)), c)

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]

    def blocks(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """The filter cut by the highest quotient bits, each part packed: quotients, run lengths, remainders, counts."""
        end = np.cumsum(self.lengths)
        block = (self.quotients >> np.uint64(QUOTIENT_BITS - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(block)), bool), block[1:] != block[:-1])))
        for a, b in zip(first, [*first[1:], len(block)], strict=True):
            lo, hi = end[a] - self.lengths[a], end[b - 1]
            parts = (self.quotients[a:b], self.lengths[a:b].astype(np.uint32), self.remainders[lo:hi], self.counts[lo:hi].astype(np.uint64))
            yield int(block[a]), np.uint32(b - a).tobytes() + zlib.compress(b"".join(p.tobytes() for p in parts), 1)

    @classmethod
    def unpacked(cls, packed: bytes) -> CountingQuotientFilter:
        n, raw = int(np.frombuffer(packed[:4], np.uint32)[0]), zlib.decompress(packed[4:])
        q, lengths = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)
        m = int(lengths.sum())
        rest = np.frombuffer(raw, np.uint64, 2 * m, 12 * n)
        return cls(q, lengths, rest[:m], rest[m:].astype(np.int64))


def _lengths(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and how often each stands there."""
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(ascending)), bool), ascending[1:] != ascending[:-1])))
    return ascending[at], np.diff(np.append(at, len(ascending))).astype(np.int64)


def _interleaved(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending runs with counts as one: where a value of b stands in a its count is added, else it is put between."""
    if b is None:
        return a
    (x, n), (y, m) = a, b
    at = np.searchsorted(x, y)
    same = np.zeros(len(y), dtype=bool)
    inside = at < len(x)
    same[inside] = x[at[inside]] == y[inside]
    n = n.copy()
    n[at[same]] += m[same]
    return np.insert(x, at[~same], y[~same]), np.insert(n, at[~same], m[~same])


def block_bits_for(rows: int) -> int:
    """log2 of the blocks of the quotient range, so that a merged block holds some 2**20 fingerprints."""
    return min(QUOTIENT_BITS - 2, max(4, (rows >> 20).bit_length()))


def repeated_fingerprints(prints: DataFrame, block_bits: int = 10) -> DataFrame:
    """The fingerprints (one long column) that occur more than once. Each partition builds filters of at most 2**21
    fingerprints; they merge block by block, 2**block_bits blocks of the quotient range."""
    name = prints.columns[0]

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush():
            made = CountingQuotientFilter.of(np.concatenate(held))
            held.clear()
            return pd.DataFrame(list(made.blocks(block_bits)), columns=["block", "filter"])

        for pdf in it:
            held.append(pdf[name].to_numpy(dtype=np.int64).view(np.uint64))
            if sum(map(len, held)) >= _FLUSH:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.unpacked(x) for x in pdf["filter"]])
        return pd.DataFrame({"fp": whole.repeated().view(np.int64)})

    filters = prints.select(name).mapInPandas(build, "block int, filter binary")
    return filters.groupBy("block").applyInPandas(merge, "fp long")


def normalised(text: pa.Array) -> pa.Array:
    """The texts without the six ASCII white-space characters, as bytes."""
    data, off = textbuf.raw_bytes(text)
    keep = ~textbuf.SPACES[data]
    left = np.concatenate(([0], np.cumsum(keep)))[off].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(left), pa.py_buffer(data[keep])])


def _digests(norm: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """SHA-256 of each row, and its first eight bytes as the fingerprint."""
    view, off = memoryview(norm.buffers()[2] or b""), np.frombuffer(norm.buffers()[1], dtype=np.int64)
    raw = b"".join(hashlib.sha256(view[a:b]).digest() for a, b in zip(off[:-1], off[1:], strict=True))
    return pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()), np.frombuffer(raw, dtype="<i8")[::4].copy()


def _decided(rows: Rows) -> DataFrame:
    """A light table: key, doc_id, sha, and of rows in a group of equal texts group_size, keep_id and keep_key."""

    def light_rows(it):
        for b in batches(it):
            sha, fp = _digests(normalised(b.column("text")))
            points = pc.utf8_length(b.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), points, pa.array(fp), sha], ["key", "doc_id", "points", "fp", "sha"])

    light = written(rows.source.mapInArrow(light_rows, "key long, doc_id long, points long, fp long, sha binary"))
    total = light.count()
    repeated = written(repeated_fingerprints(light.select("fp"), block_bits_for(total)))
    size = bits_for(repeated.count())
    mask = (1 << size) - 1
    bits = rows.spark.sparkContext.broadcast(bitmap(repeated.select(F.col("fp").bitwiseAND(F.lit(mask)).alias("pos")), size))

    def candidates(it):
        for b in batches(it):
            norm = normalised(b.column("text"))
            _, fp = _digests(norm)
            some = np.flatnonzero(in_bits(bits.value, fp & mask))
            if len(some):
                at = pa.array(some)
                points = pc.utf8_length(b.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("doc_id").take(at), points.take(at), pa.array(fp[some]), norm.take(at).cast(pa.binary())], ["key", "doc_id", "points", "fp", "norm"])

    met = rows.source.mapInArrow(candidates, "key long, doc_id long, points long, fp long, norm binary")
    groups = (
        met.groupBy("fp", "norm")
        .agg(F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), "key")).alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), F.bitwise_not("best.id").alias("keep_id"), F.col("best.key").alias("keep_key"), "group_size")
    )
    return heavy_left_join(light, written(groups), ["fp", "sha"], "group_size", total)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting the six ASCII white-space characters; null counts as empty. Of equal
    texts the one with the most code points before that stays, then the smallest doc_id, a null id last. Rows with the
    same id and text count in group_size each and share the decision; rows that share an id only are documents of their
    own. Fingerprints counted twice route their rows to the grouping by whole bytes; other texts are not shuffled.
    """
    out = _decided(Rows(docs, id_col, text_col))
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("key") == F.col("keep_key"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns: the row that `exact_duplicates` keeps; of rows with
    the same id and text one, any. Rows of other texts stay, whatever their ids. An empty table gives an empty one."""
    rows = Rows(docs, id_col, text_col)
    return rows.without(_decided(rows).where("key <> keep_key").select("key"))
