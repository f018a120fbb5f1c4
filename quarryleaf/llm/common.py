"""Shared building blocks: lineage cuts, bitmaps of bounded size, skew-safe joins, rows with keys of their own."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TaskContext.get() is not None:
    pa.set_memory_pool(pa.system_memory_pool())  # in workers only: they give freed batches back

#: log2 of the bits of a broadcast membership bitmap: at least 8 KiB, at most 128 MiB, 16 bits a member between; a
#: fuller bitmap only lets more rows through to the exact join behind it.
LEAST_BITS, MOST_BITS = 16, 30
_BLOCK = 1 << 12  # bytes of one of Spark's partial bitmaps
BATCH_ROWS = 512
#: A key with more than this share of the rows is heavy: at most 1 / HEAVY_SHARE keys can be, so they may be broadcast.
HEAVY_SHARE = 0.001
_held: dict[str, int] = {}
_lock = threading.Lock()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; where none is set, a folder of this process, on local masters only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a step runs, Arrow batches of BATCH_ROWS rows at most: rows hold whole texts, and both sides of the Python
    boundary hold several batches at once. Steps of several threads share the setting; the last one restores it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _lock:
        if _held.get("steps", 0) == 0:
            _held["before"] = int(spark.conf.get(key))
        _held["steps"] = _held.get("steps", 0) + 1
        if not 0 < _held["before"] <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        with _lock:
            _held["steps"] -= 1
            if _held["steps"] == 0:
                spark.conf.set(key, str(_held["before"]))


def written(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table under the shared checkpoint folder and read it again; columns stay prunable."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if file.rsplit("/", 1)[1].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bits_for(n: int) -> int:
    """log2 of the bits of a bitmap for n members."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * max(n, 1) - 1).bit_length()))


def bit_of(col: Column, bits: int) -> Column:
    return F.xxhash64(col).bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """The bitmap (2 ** bits bits) of the positions in the only column of the input; partial bitmaps are combined before
    the one shuffle."""
    pos = F.col(positions.columns[0]) + 1  # Spark counts these positions from 1
    blocks = positions.where(F.col(positions.columns[0]).isNotNull()).groupBy(F.bitmap_bucket_number(pos).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bits"))
    out = np.zeros(max(1 << bits - 3, _BLOCK), dtype=np.uint8)
    with small_batches(positions.sparkSession):
        for row in blocks.collect():  # 2 ** (bits - 15) rows of 4 KiB at most
            out[(row.block - 1) * _BLOCK : row.block * _BLOCK] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def members(table: DataFrame, col: str = "key") -> tuple[np.ndarray, int]:
    """The bitmap of a column's values, sized by their number, and log2 of its bits."""
    bits = bits_for(table.count())
    return bitmap(table.select(bit_of(F.col(col), bits).alias("pos")), bits), bits


def in_bits(bits: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def member(spark: SparkSession, bits: np.ndarray):
    """A column function: is the bit at this position set?"""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(pos: pd.Series) -> pd.Series:
        return pd.Series(in_bits(shared.value, pos.to_numpy(dtype=np.int64)))

    return test


def heavy_left_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """left LEFT JOIN right on keys (unique in right, none null), safe for heavy keys.

    right[rows] is how many left rows have the key. Keys above HEAVY_SHARE of total are at most 1 / HEAVY_SHARE in
    number and are joined by broadcast; their rows then spread over all tasks of the shuffled join with the others.
    """
    more = [c for c in right.columns if c not in keys]
    heavy = F.col(rows) > F.lit(max(1.0, total * HEAVY_SHARE))
    hot = right.where(heavy).select(*keys, F.struct(*more).alias("_hot"))
    rest = right.where(~heavy).select(*keys, F.lit(0).alias("_salt"), F.struct(*more).alias("_rest"))
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("int"))
    return (
        left.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread)
        .join(rest, [*keys, "_salt"], "left")
        .select(*left.columns, *(F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in more))
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Rows:
    """Documents whose rows have keys of their own, one long each: the id where no other row has it, else (repeated and
    null ids) a 64-bit hash of id and text. Only rows with the same id and the same text share a key.

    No id decides over a row of another text: what is dropped, linked or cut is so by key. The ids' own table is
    shuffled once to find repeated ones; a bitmap of these, sized by their number, is broadcast.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.spark = docs, docs.sparkSession
        self.id, self.text = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
        again = written(docs.select(self.id.alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null").select("key"))
        self.any = again.limit(1).count() > 0
        self.shared = F.lit(False)
        if self.any:
            found, bits = members(again.where("key is not null"))
            test = member(self.spark, found)
            self.shared = F.coalesce(test(bit_of(F.coalesce(self.id, F.lit(0)), bits)) | self.id.isNull(), F.lit(True))
        self.key = F.when(self.shared, F.xxhash64(self.id, self.text)).otherwise(self.id) if self.any else self.id
        #: key, doc_id and text: other columns cannot clash. A null text counts as empty.
        self.source = docs.select(self.key.alias("key"), self.id.alias("doc_id"), self.text.alias("text"))
        #: The same with what may share its key instead of the id.
        self.marked = docs.select(self.key.alias("key"), self.text.alias("text"), self.shared.alias("shared"))

    def without(self, dropped: DataFrame) -> DataFrame:
        """The rows, all columns, whose key is not in the column `key` of dropped; of rows that share a key one stays.

        A row outside the bitmap of dropped keys surely stays; one inside, whose bit no other key has, surely goes. Only
        rows that are left open, and those of repeated or null ids, are shuffled to an exact anti join."""
        docs, columns = self.docs, self.docs.columns
        key, open_ = fresh(docs, "key"), fresh(docs, "open")
        ids = written(dropped.select("key").where("key is not null").distinct())
        bits, size = members(ids)
        mine = docs.where(~self.shared).select(self.id.alias("key")) if self.any else docs.select(self.id.alias("key"))
        near = mine.where(member(self.spark, bits)(bit_of(F.col("key"), size))).join(ids, "key", "left_anti")
        others = bitmap(near.select(bit_of(F.col("key"), size).alias("pos")), size)
        shared_bits, shared_others = self.spark.sparkContext.broadcast(bits), self.spark.sparkContext.broadcast(others)

        @F.pandas_udf("int")
        def state(pos: pd.Series) -> pd.Series:
            at = pos.to_numpy(dtype=np.int64)
            inside = in_bits(shared_bits.value, at)
            return pd.Series(np.where(inside, np.where(in_bits(shared_others.value, at), 1, 2), 0))

        is_open = F.when(self.shared, F.lit(1)).otherwise(state(bit_of(F.coalesce(self.id, F.lit(0)), size))) if self.any else state(bit_of(self.id, size))
        sure = docs.withColumn(open_, is_open).where(F.col(open_) == 0).select(*columns)
        rest = docs.withColumn(open_, is_open).withColumn(key, self.key).where(F.col(open_) == 1)
        # rows alike are combined before their key is joined, however many they are
        once = rest.dropDuplicates([key]) if self.any else rest
        kept = once.join(ids.select(F.col("key").alias(key)), key, "left_anti")
        return sure.unionByName(kept.select(*columns))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names: other columns cannot clash. A null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def batches(it: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slice batches by the bytes of their text column, so that memory follows `most` or the longest text."""
    for batch in it:
        if not batch.num_rows:
            continue
        size = offsets_of(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(size, size[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, whose text (null as empty) `keep` accepts; it gets small slices of the column."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()), "")
            place = pa.RecordBatch.from_arrays([text, pa.array(np.arange(len(text)))], ["text", "row"])
            good = [b.column("row").to_numpy()[keep(b.column("text"))] for b in batches(iter([place]))]
            if good:
                yield batch.take(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def offsets_of(text: pa.Array) -> np.ndarray:
    """Byte offsets of a string column's rows (one more than rows)."""
    wide = pa.types.is_large_string(text.type)
    return np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
