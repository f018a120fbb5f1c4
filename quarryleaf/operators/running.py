"""Running totals over any number of rows: ranges of the order are summed apart, and the sums of earlier ranges added."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; a folder of this process on local masters only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """df with the running total of each column, the row's own included, in a strict order. Rows are dealt to tasks by
    ranges of the order once; each range has a running total of its own, and one row of sums is broadcast for each."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in totals.items()))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals))  # a row a range
    rows = ranged.select("*", *(F.sum(c).over(own).alias(n) for n, c in totals.items()))
    return rows.join(F.broadcast(starts), "_range").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in totals))
