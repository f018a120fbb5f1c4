"""Streams of append-only observations: the same functions work on batches and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, by: str, value: str, late: str | None = None) -> DataFrame:
    """(start, by, n, total) per window; on a stream, rows later than the watermark are dropped."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, by: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    """(by, start, end, n): runs of rows less than `gap` apart; the end is the last row's time and the gap."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark (streams), or of all (batches)."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def latest_state(events: DataFrame, key: str, at: str, value: str, late: str = "10 minutes") -> DataFrame:
    """(key, at, value): a stream of each key's newest observation; older ones that arrive late change nothing."""
    kind = events.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for pdf in frames:
            for t, v in zip(pdf[at], pdf[value], strict=True):
                micros = int(pd.Timestamp(t).value // 1000)
                if best is None or micros > best[0]:
                    best = (micros, float(v))
        if best is not None:
            state.update(best)
            yield pd.DataFrame({key: [group[0]], "at": [pd.Timestamp(best[0], unit="us")], "value": [best[1]]})

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at timestamp, value double", "at long, value double", "update", "NoTimeout")


def append_new(target: str, key: str):
    """A foreachBatch sink that appends rows whose key the Parquet table at `target` lacks: a batch that is run again
    adds nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        rows = batch.dropDuplicates([key])
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")
        rows.write.mode("append").parquet(target)

    return sink
