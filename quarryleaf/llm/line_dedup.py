"""Removal of repeated passages by content-defined chunks of lines, which overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm import textbuf
from quarryleaf.llm.common import Rows, batches, bit_of, bitmap, bits_for, heavy_left_join, in_bits, member, members, written

#: Chunks have so many words at least: bare separators and braces are no passages.
MIN_WORDS = 10


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines of all rows (one at least for each row), and the row of each line."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1))
    starts = np.concatenate((off[:-1], breaks + 1))
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = off[1:][row[last]]
    return starts, ends, row


def chunks(text: pa.Array) -> dict[str, np.ndarray]:
    """Chunks of all rows: row, at (first line), lines, start and end bytes, fp (64-bit hash of the bytes).

    From each line on, the fewest lines with MIN_WORDS words, and up to each line, the fewest lines with as many. A run of
    lines with MIN_WORDS words or more is covered by chunks inside it, whatever stands around it: those that start at its
    lines and that which ends at its last line."""
    data, off = textbuf.raw_bytes(text)
    starts, ends, row = line_spans(data, off)
    lines = len(row)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    last = np.append(first[1:], lines)
    word_starts, _ = textbuf.spans(data, off, textbuf.SPACES)
    words = np.append(np.searchsorted(word_starts, starts), len(word_starts))  # before each line
    line = np.arange(lines)
    onward = np.searchsorted(words, words[:-1] + MIN_WORDS)
    back = np.searchsorted(words, words[1:] - MIN_WORDS, side="right") - 1
    fits, fits_back = onward <= last[row], back >= first[row]
    at = np.concatenate((line[fits], back[fits_back]))
    end = np.concatenate((onward[fits], line[fits_back] + 1))
    order = np.lexsort((end, at))  # then both are in order: of two chunks, none is inside the other
    at, end = at[order], end[order]
    new = np.append(True, (at[1:] != at[:-1]) | (end[1:] != end[:-1]))[: len(at)]
    at, end = at[new], end[new]
    b0, b1 = starts[at], ends[end - 1]
    return {"row": row[at], "at": at - first[row[at]], "lines": end - at, "b0": b0, "b1": b1, "fp": textbuf.hash_spans(data, b0, b1).view(np.int64), "data": data}


def runs(it):
    """Overlapping and adjoining (at, lines) of each row, in order, as disjoint ones."""
    for batch in it:
        removed = batch.column("removed")
        found, row = removed.flatten(), np.repeat(np.arange(len(removed)), pc.list_value_length(removed).to_numpy())
        at = found.field("at").to_numpy() + (row << 40)
        reach = np.maximum.accumulate(at + found.field("lines").to_numpy())
        opens = np.flatnonzero(np.append(True, (at[1:] > reach[:-1]) | (row[1:] != row[:-1]))[: len(at)])
        end = reach[np.append(opens[1:], len(at))[: len(opens)] - 1]
        off = np.searchsorted(row[opens], np.arange(len(removed) + 1)).astype(np.int32)
        cuts = pa.StructArray.from_arrays([pa.array(at[opens] & ((1 << 40) - 1)), pa.array(end - at[opens])], ["at", "lines"])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(off), cuts)], ["key", "removed"])


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_lines, n_removed_lines, removed (array of first line and number of lines).

    Lines end at \\n. Of a run of lines with ten words or more that stands in several places with the same bytes, the place
    with the smallest doc_id, then first line, stays; the lines of the others are taken out of their texts, but for places
    that overlap the first. Every line that is taken out stands in an earlier place, so each stays somewhere.
    Null text counts as empty; of places in documents with null or repeated ids the one of the smallest key (see Rows)
    stays. Rows are cut one by one, also those that share an id; rows with the same id and text are cut alike. Text of
    documents without a repeated chunk is not shuffled. Chunks are the same if their 64-bit hash and SHA-256 are.
    """
    rows = Rows(docs, id_col, text_col)
    source, spark = rows.source, rows.spark

    def prints(it):
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([pa.array(chunks(b.column("text"))["fp"])], ["fp"])

    again = written(source.mapInArrow(prints, "fp long").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    size = bits_for(again.count())
    mask = (1 << size) - 1
    bits = spark.sparkContext.broadcast(bitmap(again.select(F.col("fp").bitwiseAND(F.lit(mask)).alias("pos")), size))

    def shas(it):
        for b in batches(it):
            c = chunks(b.column("text"))
            raw = memoryview(c.pop("data"))
            maybe = in_bits(bits.value, c["fp"] & mask)
            c = {k: v[maybe] for k, v in c.items()}
            sha = pa.array([hashlib.sha256(raw[i:j]).digest() for i, j in zip(c["b0"], c["b1"], strict=True)], pa.binary())
            at = pa.array(c["row"])
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("doc_id").take(at), pa.array(c["at"]), pa.array(c["lines"]), pa.array(c["fp"]), sha], ["key", "doc_id", "at", "lines", "fp", "sha"])

    # long chunks are as light as short ones: their SHA-256 stands for their bytes
    light = written(source.mapInArrow(shas, "key long, doc_id long, at long, lines long, fp long, sha binary"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    groups = written(light.groupBy("fp", "sha").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1"))
    met = heavy_left_join(light.drop("doc_id"), groups, ["fp", "sha"], "places", light.count()).where("first is not null")
    gone = met.where(~((F.col("key") == F.col("first.key")) & (F.col("at") < F.col("first.at") + F.col("lines"))))
    cuts = gone.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "lines"))).alias("removed"))
    cuts = written(cuts.mapInArrow(runs, "key long, removed array<struct<at:bigint,lines:bigint>>"))

    lines = F.split("text", "\n", -1)
    none = F.array().cast("array<struct<at:bigint,lines:bigint>>")
    found, size = members(cuts)
    marked = source.withColumn("_maybe", member(spark, found)(bit_of(F.col("key"), size)))
    whole = marked.where("not _maybe").select("doc_id", "text", none.alias("removed"))
    # merged at any size: cuts grow with the documents, so a broadcast of few would not last
    some = marked.where("_maybe").select("key", "doc_id", "text").join(cuts.hint("merge"), "key", "left").select("doc_id", "text", F.coalesce("removed", none).alias("removed"))
    out = whole.unionByName(some)
    # what stays lies between the runs, which are disjoint and in order: a slice each, so that no line meets every run
    end = F.transform("removed", lambda c: (c["at"] + c["lines"]).cast("int"))
    first = F.concat(F.array(F.lit(0)), end)
    stop = F.concat(F.transform("removed", lambda c: c["at"].cast("int")), F.array(F.size("lines")))
    left = F.flatten(F.zip_with(first, stop, lambda a, b: F.slice("lines", a + 1, b - a)))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, c: acc + c["lines"])
    return out.withColumn("lines", lines).select(
        "doc_id", F.when(F.size("removed") > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), n.alias("n_removed_lines"), "removed")
