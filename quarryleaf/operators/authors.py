"""Authors: bylines, productivity, impact indices, collaboration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.functions.names import author_key
from quarryleaf.operators.running import running_totals


def bylines(df: DataFrame, authors: str = "authors") -> DataFrame:
    """One row per article and author with the position in the byline (from 0); blank names are dropped afterwards."""
    keep = [c for c in df.columns if c != authors]
    rows = df.select(*keep, F.posexplode(authors).alias("position", "author"))
    return rows.withColumn("author", F.trim("author")).where("author <> ''")


def with_identity(rows: DataFrame, author: str = "author") -> DataFrame:
    """author_key, and author_display: the longest spelling of the key (ties: the smallest)."""
    keyed = rows.withColumn("author_key", author_key(F.col(author)))
    names = keyed.groupBy("author_key").agg(F.min(F.struct((-F.length(author)).alias("n"), F.col(author).alias("name"))).alias("b"))
    return keyed.join(names.select("author_key", F.col("b.name").alias("author_display")), "author_key")


def by_year(rows: DataFrame, author: str = "author", year: str = "year", doi: str = "doi") -> DataFrame:
    """Distinct articles per author and year, long form; pivot it at the edge if at all."""
    return rows.where(F.col(year).isNotNull()).groupBy(author, year).agg(F.count_distinct(doi).alias("n"))


def top(rows: DataFrame, k: int, author: str = "author", doi: str = "doi", most_position: int | None = None) -> DataFrame:
    """The k authors of most distinct articles (ties: smaller first), lead authors only where a position is given."""
    kept = rows if most_position is None else rows.where(F.col("position") <= most_position)
    return kept.groupBy(author).agg(F.count_distinct(doi).alias("n")).orderBy(F.desc("n"), author).limit(k)


def emerging(rows: DataFrame, last_year: int, author: str = "author") -> DataFrame:
    """First year, papers, and papers of the last five years, of authors with two or more."""
    return rows.groupBy(author).agg(
        F.min("year").alias("first_year"), F.count("*").alias("papers"), F.count_if(F.col("year") >= last_year - 4).alias("recent")).where("papers >= 2")


def volume_and_impact(rows: DataFrame, cites: str, author: str = "author") -> DataFrame:
    """Papers, mean and sum of citations of authors with two papers or more; unknown citations are left out."""
    return rows.groupBy(author).agg(F.count("*").alias("papers"), F.avg(cites).alias("mean"), F.sum(cites).alias("sum")).where("papers >= 2")


def correlations(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """Pearson and Spearman of two columns over complete rows, null for fewer than `least`. Ranks are given to distinct
    values from their counts, by ranges of the values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranks(c: str) -> DataFrame:
        counts = running_totals(rows.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")), [F.asc("v")], {"upto": F.col("n")})
        return counts.select(F.col("v").alias(c), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))

    both = rows.join(ranks("x"), "x").join(ranks("y"), "y")
    got = both.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))
    return got.select("n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman")))


def correlations_by(df: DataFrame, by: str, x: str, y: str, least: int = 3) -> DataFrame:
    """(by, n, pearson, spearman) of each group's complete rows, null for fewer than `least`; ranks are given to distinct
    values within a group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(by, c).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(by).orderBy(c))
        return counts.select(by, c, (upto - (F.col("n") - 1) / 2).alias(f"r{c}"))

    both = rows.join(ranks("x"), [by, "x"]).join(ranks("y"), [by, "y"])
    got = both.groupBy(by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    return got.select(by, "n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman")))


def impact_indices(rows: DataFrame, cites: str, least: int = 2, author: str = "author") -> DataFrame:
    """papers, total, mean, h, g, e, i10 of each author; unknown citations count as 0.

    h: papers with as many citations as their rank; g: the largest i whose i best papers have i * i in all;
    e: the root of what the h best have beyond h * h; i10: papers with ten or more."""
    c = F.coalesce(F.col(cites), F.lit(0))
    ordered = Window.partitionBy(author).orderBy(c.desc()).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(Window.partitionBy(author).orderBy(c.desc()))
    ranked = rows.select(author, c.alias("c"), rank.alias("i"), F.sum(c).over(ordered).alias("upto"))
    out = ranked.groupBy(author).agg(
        F.count("*").alias("papers"), F.sum("c").alias("total"), F.avg("c").alias("mean"),
        F.coalesce(F.max(F.when(F.col("c") >= F.col("i"), F.col("i"))), F.lit(0)).alias("h"),
        F.coalesce(F.max(F.when(F.col("upto") >= F.col("i") * F.col("i"), F.col("i"))), F.lit(0)).alias("g"),
        F.coalesce(F.max(F.when(F.col("c") >= F.col("i"), F.col("upto"))), F.lit(0)).alias("core"),
        F.count_if(F.col("c") >= 10).alias("i10"))
    return out.where(F.col("papers") >= least).withColumn("e", F.sqrt(F.greatest(F.col("core") - F.col("h") * F.col("h"), F.lit(0)))).drop("core")


def m_quotients(rows: DataFrame, cites: str, observed: int, least: int = 2, author: str = "author", unknown_year: int = 2015) -> DataFrame:
    """h over the years since the first paper (at least 1), rounded half to even."""
    first = rows.groupBy(author).agg(F.min(F.coalesce("year", F.lit(unknown_year))).alias("first_year"))
    age = F.greatest(F.lit(1), F.lit(observed) - F.col("first_year") + 1)
    return impact_indices(rows, cites, least, author).join(first, author).select(author, "papers", "h", "first_year", F.bround(F.col("h") / age, 2).alias("m"))


def lotka(papers: DataFrame, n: str = "n") -> DataFrame:
    """alpha, c and r2 of frequency = c / papers ** alpha, a weighted log-log fit over the levels of productivity (the
    frequency's square as weight); null for fewer than three levels."""
    levels = papers.groupBy(F.col(n).alias("level")).agg(F.count("*").alias("f"))
    x, y = F.log10("level"), F.log10("f")
    w = F.col("f").cast("double") * F.col("f")
    s = levels.agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.avg(y).alias("my"), F.collect_list(F.struct(x.alias("x"), y.alias("y"))).alias("p"))
    slope = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    fit = s.where("k >= 3").withColumn("slope", slope).withColumn("cut", (F.col("y") - F.col("slope") * F.col("x")) / F.col("w"))
    zero = F.lit(0.0)
    residual = F.aggregate("p", zero, lambda a, q: a + F.pow(q["y"] - F.col("cut") - F.col("slope") * q["x"], F.lit(2)))
    total = F.aggregate("p", zero, lambda a, q: a + F.pow(q["y"] - F.col("my"), F.lit(2)))
    return fit.select((-F.col("slope")).alias("alpha"), F.pow(F.lit(10.0), "cut").alias("c"), F.when(total > 0, 1 - residual / total).alias("r2"), F.col("k").alias("levels"))


def team_sizes(articles: DataFrame, size: str, by: list[str]) -> DataFrame:
    """Mean, median and share of one, of team sizes; articles without authors are left out."""
    return articles.where(F.col(size) > 0).groupBy(*by).agg(
        F.avg(size).alias("mean"), F.percentile(size, 0.5).alias("median"), F.avg((F.col(size) == 1).cast("double")).alias("solo"), F.count("*").alias("n"))


def pairs(rows: DataFrame, author: str = "author", doi: str = "doi", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per article and unordered pair of its authors (a < b); an author twice in a byline counts once. The
    pairs stay within a byline, whose length bounds them."""
    once = rows.select(doi, author, *keep).distinct()
    other = once.select(F.col(doi).alias("_d"), F.col(author).alias("b"))
    return once.join(other, (F.col(doi) == F.col("_d")) & (F.col(author) < F.col("b"))).select(F.col(author).alias("a"), "b", doi, *keep)


def edges(rows: DataFrame, author: str = "author", doi: str = "doi") -> DataFrame:
    """(a, b, weight): articles together."""
    return pairs(rows, author, doi).groupBy("a", "b").agg(F.count("*").alias("weight"))


def partners(edge: DataFrame, k: int = 5) -> DataFrame:
    """Per author: partners, those of two articles or more, and the first k as "name (n)", most articles first."""
    both = edge.select(F.col("a").alias("author"), F.col("b").alias("partner"), "weight").unionByName(edge.select(F.col("b").alias("author"), F.col("a").alias("partner"), "weight"))
    rank = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("weight"), "partner"))
    counted = both.withColumn("r", rank).groupBy("author").agg(
        F.count("*").alias("partners"), F.count_if(F.col("weight") >= 2).alias("recurrent"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", F.concat(F.col("partner").cast("string"), F.lit(" ("), F.col("weight").cast("string"), F.lit(")")).alias("s"))))).alias("first"))
    return counted.select("author", "partners", "recurrent", F.array_join(F.col("first.s"), ", ").alias("top"))


def period_ties(rows: DataFrame, periods: int = 3, author: str = "author") -> DataFrame:
    """(period, first_year, last_year, ties, new, repeated): distinct pairs per equal block of the years present, new
    where the pair's first year lies in the block."""
    years = rows.where("year is not null").select("year").distinct().withColumn("period", F.ntile(periods).over(Window.partitionBy(F.lit(0)).orderBy("year")))
    met = pairs(rows.where("year is not null"), author, keep=("year",)).join(years, "year").groupBy("period", "a", "b").agg(F.min("year").alias("y"))
    first = Window.partitionBy("a", "b")
    flagged = met.withColumn("is_new", F.col("period") == F.min("period").over(first))
    spans = years.groupBy("period").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return flagged.groupBy("period").agg(F.count("*").alias("ties"), F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("repeated")).join(spans, "period")


def productivity_trend(counts: DataFrame, author: str = "author", year: str = "year", n: str = "n") -> DataFrame:
    """(author, slope, trend): least-squares slope of the yearly counts from first to last year, gaps as zero; growing
    above 0.15, falling below -0.15, else stable."""
    ends = counts.groupBy(author).agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    grid = ends.select(author, F.explode(F.sequence("lo", "hi")).alias(year))
    full = grid.join(counts, [author, year], "left").select(author, year, F.coalesce(n, F.lit(0)).alias(n))
    slope = F.coalesce(F.regr_slope(F.col(n).cast("double"), F.col(year).cast("double")), F.lit(0.0))
    return full.groupBy(author).agg(slope.alias("slope")).withColumn(
        "trend", F.when(F.col("slope") > 0.15, "growing").when(F.col("slope") < -0.15, "falling").otherwise("stable"))
