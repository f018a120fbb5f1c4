"""Citation-graph coverage and consistency, access evidence, venue tiers, keyword trends, map distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.operators.authors import correlations
from quarryleaf.operators.joins import latest


def _flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean: whether its key is in the other frame."""
    return df.join(other.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(name, F.coalesce(f"_{name}", F.lit(False))).drop(f"_{name}")


def graph_coverage(works: DataFrame, backward: DataFrame, forward: DataFrame, truncated: DataFrame) -> DataFrame:
    """One row: works, those with backward lists, forward crawls, cut-off crawls, and usable ones (both, not cut off)."""
    w = _flag(_flag(_flag(works.select("work_id").distinct(), backward, "work_id", "b"), forward, "work_id", "f"), truncated, "work_id", "t")
    usable = F.col("b") & F.col("f") & ~F.col("t")
    s = w.agg(F.count("*").alias("works"), F.count_if("b").alias("backward"), F.count_if("f").alias("forward"), F.count_if("t").alias("truncated"), F.count_if(usable).alias("usable"))
    return s.withColumn("usable_share", F.coalesce(F.try_divide("usable", "works"), F.lit(0.0)))


def contradicted_zeros(zeros: DataFrame, deposited: DataFrame, counted: DataFrame) -> DataFrame:
    """Works whose zero count another source contradicts. zeros: doi; deposited and counted: doi, n."""
    proof = deposited.where("n > 0").select("doi").unionByName(counted.where("n > 0").select("doi")).distinct()
    return zeros.join(proof, "doi", "left_semi")


def trajectory_population(works: DataFrame, series: DataFrame, never_cited: DataFrame, contradicted: DataFrame) -> DataFrame:
    """(work_id, known, left_censored, complete). known: with a series, or never cited and uncontradicted; left-censored:
    published before the first year that any series has."""
    w = _flag(_flag(_flag(works.select("work_id", "year").distinct(), series, "work_id", "s"), never_cited, "work_id", "z"), contradicted, "work_id", "c")
    first = series.agg(F.min("year").alias("first"))
    known = F.col("s") | (F.col("z") & ~F.col("c"))
    rows = w.join(F.broadcast(first)).select("work_id", known.alias("known"), (known & F.coalesce(F.col("year") < F.col("first"), F.lit(False))).alias("left_censored"))
    return rows.withColumn("complete", F.col("known") & ~F.col("left_censored"))


def citation_years(edges: DataFrame, years: DataFrame, other_years: DataFrame) -> DataFrame:
    """One row over distinct edges (citing, cited): pairs, pairs with both years, consistent ones (cited up to a year
    after citing), and of works in both sources those whose years agree within one."""
    y = lambda side: years.select(F.col("work_id").alias(side), F.col("year").alias(f"{side}_year"))
    pairs = edges.select("citing", "cited").distinct().join(y("citing"), "citing", "left").join(y("cited"), "cited", "left")
    both = F.col("citing_year").isNotNull() & F.col("cited_year").isNotNull()
    p = pairs.agg(F.count("*").alias("pairs"), F.count_if(both).alias("dated"), F.count_if(both & (F.col("cited_year") <= F.col("citing_year") + 1)).alias("consistent"))
    known = years.where("year is not null").join(other_years.where("year is not null").select("work_id", F.col("year").alias("o")), "work_id")
    return p.join(known.agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("year") - F.col("o")) <= 1).alias("agreeing")))  # one row each


def reference_years(refs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row over refs (doi, year, reference_year): references, dated ones, works, works with `least` dated, and dated
    references that aren't over a year later than the work."""
    works = refs.groupBy("doi").agg(F.count("*").alias("n"), F.count("reference_year").alias("d"), F.count_if(F.col("reference_year") <= F.col("year") + 1).alias("ok"))
    return works.agg(F.sum("n").alias("references"), F.sum("d").alias("dated"), F.count("*").alias("works"), F.count_if(F.col("d") >= least * F.col("n")).alias("well_dated"), F.sum("ok").alias("consistent"))


def access_agreement(licences: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: works with a licence and an access observation (the latest), open by each, and agreement. licences: doi,
    is_open; observations: doi, observed_at, is_open."""
    last = latest(observations, ["doi"], ["observed_at"]).select("doi", F.col("is_open").alias("seen"))
    j = licences.join(last, "doi")
    return j.agg(F.count("*").alias("works"), F.count_if("is_open").alias("licensed_open"), F.count_if("seen").alias("seen_open"), F.count_if(F.col("is_open") == F.col("seen")).alias("agree"))


def price_interval(refs: DataFrame, window: int = 5, least_works: int = 10, least_dated: float = 0.8, draws: int = 500, seed: int = 0) -> DataFrame:
    """(year, low, high): 95 % of draws of whole works, of the share of recent references. Works are counted by their
    (recent, dated) pair first, so a task holds one year's distinct pairs."""
    age = F.col("year") - F.col("reference_year")
    works = refs.where(F.col("reference_year").isNull() | (age >= -1)).groupBy("doi", "year").agg(F.count("*").alias("listed"), F.count("reference_year").alias("dated"), F.count_if(age <= window).alias("recent"))
    cells = works.where((F.col("dated") > 0) & (F.col("dated") >= least_dated * F.col("listed"))).groupBy("year", "recent", "dated").agg(F.count("*").alias("n"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["recent", "dated"])
        n = pdf["n"].to_numpy()
        if n.sum() < least_works:
            return pd.DataFrame({"year": [], "low": [], "high": []})
        drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), draws)
        share = drawn @ pdf["recent"].to_numpy() / (drawn @ pdf["dated"].to_numpy())
        low, high = np.quantile(share, [0.025, 0.975])
        return pd.DataFrame({"year": [key[0]], "low": [low], "high": [high]})

    return cells.groupBy("year").applyInPandas(run, "year int, low double, high double")


# Venue tiers, best first.
TIERS = ("A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "C")


def with_tier(articles: DataFrame, tiers: DataFrame, venue: str = "venue") -> DataFrame:
    """Articles with their venue's tier, where it has one, and the tier's rank. tiers: venue, tier; the best of several."""
    rank = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    best = tiers.where(F.col("tier").isin(*TIERS)).groupBy(F.col("venue").alias(venue)).agg(F.min(F.struct(rank.alias("r"), "tier")).alias("b"))
    return articles.join(best, venue, "left").select(*articles.columns, F.col("b.tier").alias("tier"), F.col("b.r").cast("int").alias("tier_rank"))


def tier_volume(articles: DataFrame, tiers: Sequence[str], year: str = "year") -> DataFrame:
    """(year, tier, n) of the tiers asked for."""
    return articles.where(F.col("tier").isin(*tiers)).groupBy(year, "tier").agg(F.count("*").alias("n"))


def keyword_share_trend(keyword_years: DataFrame, least: int = 20) -> DataFrame:
    """(value, n, slope): least-squares slope of a keyword's share of its year's keywords, over all years present, zero
    where it is absent. keyword_years: value, year, one row each time."""
    counts = keyword_years.where("year is not null").groupBy("value", "year").agg(F.count("*").alias("c"))
    totals = counts.groupBy("year").agg(F.sum("c").alias("t"))
    shares = counts.join(totals, "year").select("value", "year", "c", (F.col("c") / F.col("t")).alias("share"))
    # years without the keyword add nothing to the sums of shares; the sums over years are the same for all
    grid = totals.agg(F.count("*").alias("k"), F.sum("year").alias("sy"), F.sum(F.col("year") * F.col("year")).alias("syy"))
    s = shares.groupBy("value").agg(F.sum("c").alias("n"), F.sum("share").alias("s"), F.sum(F.col("share") * F.col("year")).alias("sx")).where(F.col("n") >= least)
    slope = (F.col("k") * F.col("sx") - F.col("sy") * F.col("s")) / (F.col("k") * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.join(F.broadcast(grid)).select("value", "n", slope.alias("slope"))


def cognitive_distance(rows: DataFrame, points: DataFrame, cites: str, doi: str = "doi", author: str = "author") -> DataFrame:
    """(n, pearson, spearman) of a paper's citations with the mean distance of its authors' centres on a map. points:
    doi, x, y. Pairs stay within a byline."""
    placed = rows.select(doi, author, cites).distinct().join(points, doi)
    centre = placed.groupBy(author).agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    near = placed.select(doi, author, cites).join(centre, author)
    other = near.select(doi, F.col(author).alias("_b"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    gap = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2)))
    papers = near.join(other, doi).where(F.col(author) < F.col("_b")).groupBy(doi).agg(F.round(F.avg(gap), 9).alias("distance"), F.first(cites).alias("cites"))
    return correlations(papers, "distance", "cites")


def described(subjects: DataFrame, context: DataFrame, key: str, separator: str = "::", part: int = -1) -> DataFrame:
    """Review subjects with the context of the key that their id ends in."""
    parts = F.split("subject_id", separator)
    return subjects.withColumn(key, F.element_at(parts, part)).join(context, key, "left")


def first_titles(rows: DataFrame, by: str, title: str, order: str, k: int = 3) -> DataFrame:
    """(by, titles): the first k titles of each, joined by bars."""
    w = Window.partitionBy(by).orderBy(order, title)
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return few.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(title).alias("t")))), lambda x: x["t"]), " | ").alias("titles"))


def screening_report(scored: DataFrame, margin: str, has_abstract: Column, key: str, k: int = 25) -> DataFrame:
    """The k rows nearest to a margin of zero, with the corpus's median margin (of rows with an abstract) and the number
    below zero."""
    facts = scored.agg(F.percentile(F.when(has_abstract, F.col(margin)), 0.5).alias("median"), F.count_if(F.col(margin) < 0).alias("below"))
    return scored.where(F.col(margin).isNotNull()).orderBy(F.abs(F.col(margin)), key).limit(k).join(F.broadcast(facts)).select(key, margin, "median", "below")


def requested(wanted: DataFrame, found: DataFrame, key: str = "doi") -> DataFrame:
    """A provider's answer to a batch: every key asked for, `not_found` where the answer lacks it."""
    return wanted.select(key).distinct().join(found.withColumn("status", F.lit("success")), key, "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def batches_of(keys: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, keys): keys in the order of their hash, dealt into batches of `size` within hash buckets: no single task
    orders them all."""
    n = keys.agg(F.greatest(F.ceil(F.count("*") / (size * 64)), F.lit(1)).alias("n"))
    rows = keys.select(key).distinct().join(F.broadcast(n)).withColumn("bucket", F.pmod(F.xxhash64(key), F.col("n")))
    w = Window.partitionBy("bucket").orderBy(F.sha2(F.col(key).cast("string").cast("binary"), 256))
    dealt = rows.withColumn("part", F.floor((F.row_number().over(w) - 1) / size))
    return dealt.groupBy(F.concat_ws("-", F.col("bucket").cast("string"), F.col("part").cast("string")).alias("batch")).agg(F.array_sort(F.collect_list(key)).alias("keys"))
