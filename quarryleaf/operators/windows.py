"""Cumulative, ranking and cohort windows over groups already small, and citation histories.

Global running windows are applied to aggregates (years, venues, distinct values), never to raw rows; partitioned
windows carry their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.operators.counts import source_counts_by
from quarryleaf.operators.running import running_totals


def running(order: str, by: Sequence[str] = ()):
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_by_source(df: DataFrame, year: str, sources: Sequence[str]) -> DataFrame:
    """Running totals per year and source over the years present."""
    counts = source_counts_by(df.where(F.col(year).isNotNull()), year, sources)
    return counts.select(year, *(F.sum(c).over(running(year)).alias(c) for c in (*sources, "total")))


def cumulative_by_category(df: DataFrame, year: str, category: str, top: int = 10, rest: str = "Others") -> DataFrame:
    """(year, bucket, n, running): the `top` categories by rows (ties: smaller first), others as one bucket, over the
    full grid of years and buckets present, absent cells zero."""
    rows = df.where(F.col(year).isNotNull() & F.col(category).isNotNull())
    best = rows.groupBy(category).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), category).limit(top).select(category, F.lit(True).alias("_top"))
    counts = rows.groupBy(year, category).agg(F.count("*").alias("n")).join(F.broadcast(best), category, "left")  # at most `top` rows
    cells = counts.groupBy(year, F.when(F.col("_top"), F.col(category)).otherwise(rest).alias("bucket")).agg(F.sum("n").alias("n"))
    # a year has a handful of buckets: each bucket's missing years come from the array of all years
    years = cells.agg(F.array_sort(F.collect_set(year)).alias("_years"))
    grid = cells.select("bucket").distinct().join(years).select("bucket", F.explode("_years").alias(year))
    full = grid.join(cells, ["bucket", year], "left").fillna(0, ["n"])
    return full.select(year, "bucket", "n", F.sum("n").over(running(year, ["bucket"])).alias("running"))


def cumulative_new_keys(df: DataFrame, key: str, year: str) -> DataFrame:
    """(year, new, running): keys by the year they first appear in."""
    first = df.where(F.col(year).isNotNull()).groupBy(key).agg(F.min(year).alias(year))
    counts = first.groupBy(year).agg(F.count("*").alias("new"))
    return counts.select(year, "new", F.sum("new").over(running(year)).alias("running"))


def age_normalised(df: DataFrame, year: str, cites: str, observed: int) -> DataFrame:
    """annual_rate: citations (null as 0) over years since publication, at least 1; z: against the year's cohort, sample
    deviation, 1 where it is zero or unknown; pct: average rank over the cohort's known values."""
    cohort = Window.partitionBy(year)
    ordered = cohort.orderBy(cites)
    c = F.col(cites)
    sd = F.stddev_samp(cites).over(cohort)
    ties = F.count(cites).over(Window.partitionBy(year, cites))
    rank = F.rank().over(cohort.orderBy(F.col(cites).asc_nulls_last()))
    return df.select(
        "*", (F.coalesce(c, F.lit(0)) / F.greatest(F.lit(observed) - F.col(year) + 1, F.lit(1))).alias("annual_rate"),
        ((c - F.avg(cites).over(cohort)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd)).alias("z"),
        F.when(c.isNotNull(), (rank + (ties - 1) / 2) / F.count(cites).over(cohort)).alias("pct"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """(people, output): cumulative shares of owners, smallest first, and of what they hold, from the origin on; one
    point for each distinct value."""
    counts = value_counts(df, value)
    points = running_totals(counts, [F.asc("v")], {"p": F.col("n"), "o": F.col("n") * F.col("v")})
    totals = counts.agg(F.sum("n").alias("pn"), F.sum(F.col("n") * F.col("v")).alias("on"))
    shares = points.join(F.broadcast(totals)).select((F.col("p") / F.col("pn")).alias("people"), F.try_divide("o", "on").alias("output"))  # one row
    return shares.unionByName(totals.select(F.lit(0.0).alias("people"), F.lit(0.0).alias("output")))


def gini(df: DataFrame, value: str) -> DataFrame:
    """2 * sum(i * x_i) / (n * sum(x)) - (n + 1) / n over ascending x; 0 for fewer than two values or a zero sum."""
    counts = running_totals(value_counts(df, value), [F.asc("v")], {"upto": F.col("n")})
    # ranks of one value's copies run from upto - n + 1 to upto
    weighted = F.sum(F.col("v") * F.col("n") * (2 * F.col("upto") - F.col("n") + 1) / 2)
    sums = counts.agg(weighted.alias("ix"), F.sum(F.col("v") * F.col("n")).alias("x"), F.sum("n").alias("n"))
    n = F.col("n")
    return sums.select(F.when(n.isNull() | (n < 2) | (F.col("x") == 0), 0.0).otherwise(2 * F.col("ix") / (n * F.col("x")) - (n + 1) / n).alias("gini"))


def bradford_zones(counts: DataFrame, key: str, n: str, zones: int = 3) -> DataFrame:
    """(zone, venues, articles, multiplier): keys by descending count (ties: key) fill zones of equal shares in turn; a
    key may open one zone at most. Input: one row per key, of which any number are ordered by ranges."""
    whole = counts.agg(F.sum(n).alias("_whole"))
    placed = running_totals(counts.select(F.col(key).cast("string").alias("k"), F.col(n).alias("n")), [F.desc("n"), F.asc("k")], {"upto": F.col("n"), "place": F.lit(1)})
    due = 1 + F.floor((F.col("upto") - F.col("n")) * zones / F.col("_whole"))
    zone = F.least(due, F.col("place"), F.lit(zones)).cast("int")  # a key as large as a zone stands among the first ones
    rows = placed.join(F.broadcast(whole)).select(zone.alias("zone"), "n")  # one row
    sums = rows.groupBy("zone").agg(F.count("*").alias("venues"), F.sum("n").alias("articles"))
    return sums.withColumn("multiplier", F.col("venues") / F.lag("venues").over(Window.partitionBy(F.lit(0)).orderBy("zone")))


def moving_share(cells: DataFrame, group: str, year: str, n: str, window: int) -> DataFrame:
    """(year, group, share, smooth): a group's share of its year; a centred moving mean of `window` years (fewer at the
    ends), renormalised within the year. Input: the full grid of counts."""
    within = Window.partitionBy(year)
    share = cells.select(year, group, F.coalesce(F.try_divide(F.col(n), F.sum(n).over(within)), F.lit(0.0)).alias("share"))
    half = window // 2
    mean = F.avg("share").over(Window.partitionBy(group).orderBy(year).rowsBetween(-half, half))
    smooth = share.withColumn("smooth", mean)
    return smooth.withColumn("smooth", F.coalesce(F.try_divide(F.col("smooth"), F.sum("smooth").over(within)), F.lit(0.0)))


def price_index(refs: DataFrame, window: int = 5, least_works: int = 10, least_dated: float = 0.8) -> DataFrame:
    """(year, works, price): of works with `least_dated` of their references dated, the share of dated references not
    older than `window` years; references over a year in the future leave both sides. refs: doi, year, reference_year."""
    age = F.col("year") - F.col("reference_year")
    usable = refs.where(F.col("reference_year").isNull() | (age >= -1))
    works = usable.groupBy("doi", "year").agg(
        F.count("*").alias("listed"), F.count("reference_year").alias("dated"), F.count_if(age <= window).alias("recent"))
    kept = works.where((F.col("dated") > 0) & (F.col("dated") >= least_dated * F.col("listed")))
    return kept.groupBy("year").agg(F.count("*").alias("works"), (F.sum("recent") / F.sum("dated")).alias("price")).where(F.col("works") >= least_works)


def citation_series(trajectories: DataFrame, last_year: int) -> DataFrame:
    """(doi, t, c): dense yearly citations from publication (t = 0) to last_year; earlier ones fold into t = 0, later
    ones are left out. trajectories: doi, publication_year, year, citations."""
    known = trajectories.where(F.col("publication_year").isNotNull() & (F.col("publication_year") <= last_year) & (F.col("year") <= last_year))
    hits = known.groupBy("doi", "publication_year", F.greatest(F.col("year") - F.col("publication_year"), F.lit(0)).alias("t")).agg(F.sum("citations").alias("c"))
    works = trajectories.where(F.col("publication_year") <= last_year).select("doi", "publication_year").distinct()
    grid = works.select("doi", "publication_year", F.explode(F.sequence(F.lit(0), F.lit(last_year) - F.col("publication_year"))).alias("t"))
    return grid.join(hits, ["doi", "publication_year", "t"], "left").select("doi", "t", F.coalesce("c", F.lit(0)).alias("c"))


def half_lives(series: DataFrame, least_age: int = 5, least_citations: int = 10) -> DataFrame:
    """(doi, half_life, total): the first t with half of all citations."""
    each = Window.partitionBy("doi")
    rows = series.select("doi", "t", F.sum("c").over(each.orderBy("t")).alias("upto"), F.sum("c").over(each).alias("total"), F.max("t").over(each).alias("age"))
    got = rows.where((F.col("age") >= least_age) & (F.col("total") >= least_citations) & (F.col("upto") >= F.col("total") / 2))
    return got.groupBy("doi", "total").agg(F.min("t").alias("half_life"))


def sleeping_beauties(series: DataFrame, least_citations: int = 10) -> DataFrame:
    """(doi, beauty, peak, awakening): the sum over t up to the first peak of (line - c) / max(1, c), the line joining
    the start and the peak; awakening: the t farthest from it, null (and beauty 0) for a peak at 0."""
    works = series.groupBy("doi").agg(
        F.sum("c").alias("total"), F.max(F.struct("c", (-F.col("t")).alias("back"))).alias("top"), F.max(F.when(F.col("t") == 0, F.col("c"))).alias("c0"))
    rows = series.join(works.where(F.col("total") >= least_citations), "doi").withColumn("peak", -F.col("top.back")).where(F.col("t") <= F.col("peak"))
    rise = (F.col("top.c") - F.col("c0")) / F.when(F.col("peak") > 0, F.col("peak"))
    line = F.coalesce(rise, F.lit(0.0)) * F.col("t") + F.col("c0")
    away = F.abs((F.col("top.c") - F.col("c0")) * F.col("t") - F.col("peak") * F.col("c") + F.col("peak") * F.col("c0"))
    beauty = F.sum(F.when(F.col("peak") > 0, (line - F.col("c")) / F.greatest(F.lit(1), F.col("c"))).otherwise(0.0))
    far = F.max(F.when(F.col("peak") > 0, F.struct(away.alias("d"), (-F.col("t")).alias("back"))))
    return rows.groupBy("doi", "peak").agg(beauty.alias("beauty"), far.alias("far")).select("doi", "beauty", "peak", (-F.col("far.back")).alias("awakening"))


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, value, share): the share of a group's values up to each distinct one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    return counts.select(by, value, (F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w)).alias("share"))


