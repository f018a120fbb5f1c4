"""Counts, pivots, completeness, distributions. Every operator takes and returns a DataFrame; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_source(sources: Sequence[str], agg, source: str = "source") -> list[Column]:
    """One aggregate for each source, and one over all rows under `total` (never the sum of the others)."""
    return [agg(F.col(source) == s).alias(s) for s in sources] + [agg(F.lit(True)).alias("total")]


def source_counts_by(df: DataFrame, key: str, sources: Sequence[str]) -> DataFrame:
    """Rows per key and source; `total` counts rows of every source."""
    return df.groupBy(key).agg(*per_source(sources, lambda test: F.count_if(test)))


def source_means(df: DataFrame, value: str, sources: Sequence[str]) -> DataFrame:
    """Mean of a value per source and over all rows, nulls left out."""
    return df.agg(*per_source(sources, lambda test: F.avg(F.when(test, F.col(value)))))


def in_domain(column: str, domain: Sequence[str], other: str = "other") -> Column:
    """The value where it is in a fixed domain, else (and for null) the catch-all."""
    return F.when(F.col(column).isin(*domain), F.col(column)).otherwise(other)


def domain_totals(df: DataFrame, column: str, domain: Sequence[str], other: str = "other") -> DataFrame:
    """Rows of each value of a fixed domain, zero for absent ones; unknown and null values count as the catch-all."""
    names = [*domain, *([] if other in domain else [other])]
    counts = df.agg(*(F.count_if(in_domain(column, domain, other) == n).alias(n) for n in names))
    return counts.unpivot([], names, column, "n")


def domain_counts_by(df: DataFrame, key: str, column: str, domain: Sequence[str], other: str = "other") -> DataFrame:
    """Rows per key and value of a fixed domain, zero-filled, with their total; rows without a key are left out."""
    names = [*domain, *([] if other in domain else [other])]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *(F.count_if(in_domain(column, domain, other) == n).alias(n) for n in names), F.count("*").alias("total"))


def present(df: DataFrame, column: str) -> Column:
    """Whether a field holds something: a non-empty list, true, a non-blank string, or any other non-null value."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("array"):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(F.col(column), F.lit(False))
    if kind == "string":
        return F.coalesce(F.trim(column) != "", F.lit(False))
    return F.col(column).isNotNull()


def coverage_matrix(df: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """(by, field, n_total, n_present, coverage) in one aggregation; fields that the frame lacks are skipped."""
    have = [f for f in fields if f in df.columns]
    counted = df.groupBy(by).agg(F.count("*").alias("n_total"), *(F.count_if(present(df, f)).alias(f) for f in have))
    return counted.unpivot([by, "n_total"], have, "field", "n_present").withColumn("coverage", F.col("n_present") / F.col("n_total"))


def distinct_by(df: DataFrame, by: str, key: str, sources: Sequence[str]) -> DataFrame:
    """Distinct keys per `by` and source; a key of two sources counts once in `total`."""
    return df.groupBy(by).agg(*per_source(sources, lambda test: F.count_distinct(F.when(test, F.col(key)))))


def funnel(layers: dict[str, DataFrame], by: str) -> DataFrame:
    """Rows per layer and key, of several frames."""
    out = None
    for name, df in layers.items():
        part = df.groupBy(by).agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), by, "n")
        out = part if out is None else out.unionByName(part)
    return out


def drift(funnel_df: DataFrame, by: str, later: str, earlier: str) -> DataFrame:
    """Rows of a later layer less those of an earlier one, per key."""
    return funnel_df.groupBy(by).agg(
        (F.sum(F.when(F.col("layer") == later, F.col("n")).otherwise(0)) - F.sum(F.when(F.col("layer") == earlier, F.col("n")).otherwise(0))).alias("drift"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin (1 to bins; the last holds `high` too) of values in [low, high]."""
    v = F.col(value)
    b = F.least(F.floor((v - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where((v >= low) & (v <= high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Exact linear-interpolated quartiles, mean, extremes and count per group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        *(F.percentile(value, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))),
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))


def top_groups(df: DataFrame, by: str, k: int, sources: Sequence[str] = (), source: str = "source", value: str | None = None, least: int = 1) -> DataFrame:
    """The k largest groups by rows (or by mean value among groups of `least` rows), with their modal source.

    Ties: the smaller key first. The mode is the smallest of the most frequent sources."""
    more = [F.count_if(F.col(source) == s).alias(s) for s in sources]
    aggs = [F.count("*").alias("n"), F.mode(source, True).alias("modal_source"), *more]
    if value:
        aggs.append(F.avg(value).alias("mean_value"))
    got = df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs).where(F.col("n") >= least)
    order = F.col("mean_value").desc_nulls_last() if value else F.desc("n")
    return got.orderBy(order, by).limit(k)


def summary(df: DataFrame, distinct: Sequence[str], means: Sequence[str], filled: Sequence[str]) -> DataFrame:
    """One row of key figures: rows, distinct values, means and non-blank counts."""
    return df.agg(
        F.count("*").alias("n"), *(F.count_distinct(c).alias(f"n_{c}") for c in distinct),
        *(F.avg(c).alias(f"mean_{c}") for c in means), *(F.count_if(present(df, c)).alias(f"with_{c}") for c in filled))


def share_within(df: DataFrame, group: str, key: str, n: str = "n") -> DataFrame:
    """A count's share of its group's total."""
    from pyspark.sql.window import Window

    return df.select(group, key, n, (F.col(n) / F.sum(n).over(Window.partitionBy(group))).alias("share"))


def explode_values(df: DataFrame, column: str, keep: Sequence[str], fold: bool = True) -> DataFrame:
    """One row per list element, trimmed (and lower-cased), blanks dropped, repeats within a list kept."""
    v = F.trim(F.col("value"))
    rows = df.select(*keep, F.explode(column).alias("value"))
    return rows.withColumn("value", F.lower(v) if fold else v).where("value <> ''")


def list_statistics(df: DataFrame, column: str) -> DataFrame:
    """Elements in all, mean elements per row and the share of rows without any; null lists are empty."""
    size = F.coalesce(F.size(column), F.lit(0))
    return df.agg(F.sum(size).alias("occurrences"), F.avg(size).alias("mean_per_row"), F.avg((size == 0).cast("double")).alias("share_empty"))


def first_appearance(df: DataFrame, key: str, year: str, least: int) -> DataFrame:
    return df.groupBy(key).agg(F.min(year).alias("first_year"), F.count("*").alias("n")).where(F.col("n") >= least)
