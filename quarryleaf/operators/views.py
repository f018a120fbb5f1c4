"""Top lists, research lines, keyword profiles, coverage of metadata and of chunks, positions on a map.

Lines and profiles are made for all keywords or authors at once; a reader of one filters by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.operators.statistics import adjusted_p, slope_intervals, trends
from quarryleaf.operators.windows import age_normalised


def first_rows(df: DataFrame, by: str, key: str, k: int, least: float | None = None) -> DataFrame:
    """The k rows with the largest known value (ties: the smaller key), above `least` where given."""
    known = df.where(F.col(by).isNotNull() if least is None else F.col(by) > least)
    return known.orderBy(F.desc(by), key).limit(k)


def most_cited(articles: DataFrame, k: int = 20, cites: str = "citation_count", key: str = "doi") -> DataFrame:
    return first_rows(articles, cites, key, k, 0)


def longest_bibliographies(articles: DataFrame, k: int = 20, refs: str = "reference_count", key: str = "doi") -> DataFrame:
    return first_rows(articles, refs, key, k, 0)


def fastest_cited(articles: DataFrame, observed: int, k: int = 20, year: str = "year", cites: str = "citation_count", key: str = "doi") -> DataFrame:
    """The k articles of the highest yearly rate of citations, with their place in the year's cohort, rounded."""
    rated = age_normalised(articles, year, cites, observed)
    best = first_rows(rated, "annual_rate", key, k)
    return best.select(*articles.columns, *(F.round(c, 2).alias(c) for c in ("annual_rate", "z", "pct")))


def delayed_recognition(scores: DataFrame, articles: DataFrame, k: int = 10, key: str = "doi", title: str = "title") -> DataFrame:
    """The k works of the highest beauty coefficient with their titles; works without a known article keep a null one."""
    best = first_rows(scores, "beauty", key, k)
    titles = articles.join(F.broadcast(best.select(key)), key, "left_semi").groupBy(key).agg(F.min(title).alias(title))  # k rows
    return best.join(titles, key, "left")


def recognition_summary(scores: DataFrame, last_age: Column) -> DataFrame:
    """One row: works scored, median beauty, and works whose peak is in their last year (peak = last_age)."""
    return scores.agg(F.count("*").alias("works"), F.median("beauty").alias("median_beauty"), F.count_if(F.col("peak") == last_age).alias("peak_last"))


def observation_year(observations: DataFrame, at: str, fallback: int, basis: str) -> DataFrame:
    """One row: the year of the latest observation and where it comes from, else the fallback and its own basis."""
    last = F.year(F.max(at))
    return observations.agg(F.coalesce(last, F.lit(fallback)).alias("year"), F.when(last.isNotNull(), "latest observation").otherwise(basis).alias("basis"))


def keyword_lines(keywords: DataFrame, k: int = 60) -> DataFrame:
    """The k keywords of most mentions (ties: the smaller). keywords: value, doi, one row each mention."""
    return keywords.groupBy("value").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "value").limit(k)


def line_articles(keywords: DataFrame, k: int = 60) -> DataFrame:
    """(value, doi): the articles of each of the k lines, once each."""
    lines = keyword_lines(keywords, k).select("value")
    return keywords.join(F.broadcast(lines), "value", "left_semi").where("doi is not null").select("value", "doi").distinct()  # k rows


def line_leaders(lines: DataFrame, rows: DataFrame, k: int = 10, author: str = "author") -> DataFrame:
    """(value, author, articles, rank): the k authors of most articles in each line (ties: the smaller)."""
    counts = lines.join(rows.select("doi", author), "doi").groupBy("value", author).agg(F.count_distinct("doi").alias("articles"))
    w = Window.partitionBy("value").orderBy(F.desc("articles"), author)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def line_trend(lines: DataFrame, rows: DataFrame, year: str = "year") -> DataFrame:
    """(value, year, articles): distinct articles with a known author a year."""
    dated = rows.where(F.col(year).isNotNull()).select("doi", year).distinct()
    return lines.join(dated, "doi").groupBy("value", year).agg(F.count_distinct("doi").alias("articles"))


def line_researchers(lines: DataFrame, rows: DataFrame, author: str = "author", year: str = "year") -> DataFrame:
    """(value, year, researchers, newcomers, so_far): distinct authors a year, those not seen in the line before, and all
    up to it."""
    known = lines.join(rows.where(F.col(year).isNotNull()).select("doi", author, year), "doi").select("value", author, year).distinct()
    each = known.groupBy("value", year).agg(F.count("*").alias("researchers"))
    new = known.groupBy("value", author).agg(F.min(year).alias(year)).groupBy("value", year).agg(F.count("*").alias("newcomers"))
    both = each.join(new, ["value", year], "left").fillna(0, ["newcomers"])
    return both.withColumn("so_far", F.sum("newcomers").over(Window.partitionBy("value").orderBy(year)))


def line_ranking(lines: DataFrame, articles: DataFrame, rows: DataFrame, cites: str = "citation_count") -> DataFrame:
    """(value, article columns, rank): articles with a known author, by citations, unknown ones last (ties: the smaller doi)."""
    authored = articles.join(rows.select("doi").distinct(), "doi", "left_semi")
    w = Window.partitionBy("value").orderBy(F.col(cites).desc_nulls_last(), "doi")
    return lines.join(authored, "doi").withColumn("rank", F.row_number().over(w))


def keyword_explorer(articles: DataFrame, keywords: str, asked: Sequence[str], cites: str = "citation_count") -> DataFrame:
    """Articles with any of the keywords asked for, sorted by citations, unknown ones last. A null list has none."""
    wanted = F.array(*(F.lit(x) for x in asked)).cast("array<string>")
    found = articles.where(F.coalesce(F.arrays_overlap(keywords, wanted), F.lit(False)))
    return found.drop(keywords).orderBy(F.col(cites).desc_nulls_last(), "doi")


def prolific(rows: DataFrame, least: int = 3, author: str = "author") -> DataFrame:
    """(author, articles): authors with so many distinct articles."""
    return rows.groupBy(author).agg(F.count_distinct("doi").alias("articles")).where(F.col("articles") >= least)


def author_keywords(rows: DataFrame, keywords: DataFrame, least: int = 3, author: str = "author") -> DataFrame:
    """(author, value, year): mentions in the articles of each author with `least` articles; keywords: value, doi, year."""
    mine = rows.select(author, "doi").distinct().join(prolific(rows, least, author).select(author), author, "left_semi")
    return mine.join(keywords.where("year is not null").select("value", "doi", "year"), "doi").select(author, "value", "year")


def keyword_profile(working: DataFrame, k: int = 10, author: str = "author") -> DataFrame:
    """(author, value, mentions, rank): an author's k most frequent keywords (ties: the smaller)."""
    counts = working.groupBy(author, "value").agg(F.count("*").alias("mentions"))
    w = Window.partitionBy(author).orderBy(F.desc("mentions"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_shift(working: DataFrame, k: int = 10, author: str = "author") -> DataFrame:
    """(author, value, split, early, late, rank): mentions up to and after the whole part of the median year of an
    author's mentions, for authors with two years or more; the k of most late mentions (ties: the smaller keyword)."""
    split = working.groupBy(author).agg(F.floor(F.median("year")).cast("int").alias("split"), F.count_distinct("year").alias("_n")).where("_n >= 2").drop("_n")
    counts = working.join(split, author).groupBy(author, "value", "split").agg(F.count_if(F.col("year") <= F.col("split")).alias("early"), F.count_if(F.col("year") > F.col("split")).alias("late"))
    w = Window.partitionBy(author).orderBy(F.desc("late"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rising_falling(keyword_years: DataFrame, least: int = 20, shown: int = 7, serial: bool = True) -> DataFrame:
    """Keywords with the lowest and highest slopes: (value, slope, low, high, direction, excludes_zero, p, p_adjusted, sen,
    and with `serial` p_serial, p_serial_adjusted).

    The slope is that of a keyword's yearly share (percent, years with the keyword, three at least), with its 95 %
    interval. Mann-Kendall runs over zero-filled counts of every keyword with `least` mentions, and p-values are adjusted
    in that whole family before the few shown are picked. keyword_years: value, year, one row each mention."""
    rows = keyword_years.where("value is not null and year is not null")
    counts = rows.groupBy("value", "year").agg(F.count("*").alias("c"))
    eligible = counts.groupBy("value").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    kept = counts.join(eligible.select("value"), "value", "left_semi")
    totals = counts.groupBy("year").agg(F.sum("c").alias("t"))
    shares = kept.join(totals, "year").select("value", "year", (100 * F.col("c") / F.col("t")).alias("share"))
    enough = shares.groupBy("value").agg(F.count("*").alias("k")).where("k >= 3").select("value")
    fits = slope_intervals(shares.join(enough, "value", "left_semi"), "value", "year", "share").where(F.col("slope").isNotNull() & ~F.isnan("slope"))
    years = totals.agg(F.array_sort(F.collect_set("year")).alias("ys"))  # the years of a corpus: one short array
    full = eligible.select("value").join(F.broadcast(years)).select("value", F.explode("ys").alias("year")).join(kept, ["value", "year"], "left").select("value", "year", F.coalesce("c", F.lit(0)).alias("c"))
    tested = trends(full, "value", "year", "c", serial=serial).select("value", "p", "p_serial", F.col("slope").alias("sen"))
    family = adjusted_p(tested, "p", "p_adjusted")
    if serial:
        family = adjusted_p(family, "p_serial", "p_serial_adjusted")
    low, high = (fits.orderBy(F.asc("slope") if up else F.desc("slope"), "value").limit(shown).select("value") for up in (True, False))
    picked = fits.drop("p", "stderr").join(F.broadcast(low.union(high).distinct()), "value", "left_semi")  # 2 * shown rows
    extra = ["p_serial", "p_serial_adjusted"] if serial else []
    return picked.join(family, "value").select(
        "value", "slope", "low", "high", F.when(F.col("slope") >= 0, "rising").otherwise("falling").alias("direction"),
        ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"), "p", "p_adjusted", "sen", *extra)


def growth_ranking(forecasts: DataFrame, k: int, variation: str = "variation", key: str = "keyword") -> DataFrame:
    """The k keywords of the largest projected change, ranked (ties: the smaller)."""
    w = Window.orderBy(F.desc(variation), key)
    return first_rows(forecasts, variation, key, k).withColumn("rank", F.row_number().over(w))


def countries(articles: DataFrame, column: str = "countries", k: int = 15) -> DataFrame:
    """(country, articles): an article counts once for each country it names (ties: the smaller)."""
    named = articles.select(F.explode(F.array_distinct(column)).alias("country")).where("country is not null")
    return named.groupBy("country").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "country").limit(k)


def by_month(articles: DataFrame, at: str) -> DataFrame:
    """(month, articles), the first day of each month with any; rows without a date are left out."""
    return articles.where(F.col(at).isNotNull()).groupBy(F.trunc(F.col(at).cast("date"), "month").alias("month")).agg(F.count("*").alias("articles"))


def declared(articles: DataFrame, column: str, mark: str) -> DataFrame:
    """One row: rows with a declared value, distinct values, and rows whose value holds the mark (open licences)."""
    return articles.agg(F.count(column).alias("declared"), F.count_distinct(column).alias("kinds"), F.count_if(F.contains(column, F.lit(mark))).alias("marked"))


def source_fields(articles: DataFrame, source: str, countries_col: str, date_col: str) -> DataFrame:
    """One row over the articles of one source: all, with a country, with a date, and its share of all articles."""
    mine = F.col("source") == source
    return articles.agg(
        F.count_if(mine).alias("articles"), F.count_if(mine & (F.coalesce(F.size(countries_col), F.lit(0)) > 0)).alias("with_country"),
        F.count_if(mine & F.col(date_col).isNotNull()).alias("with_date"), F.coalesce(F.avg(F.coalesce(mine, F.lit(False)).cast("double")), F.lit(0.0)).alias("share"))


def embedding_readiness(chunks: DataFrame, kind: str = "chunk_type", has: str = "has_embedding") -> DataFrame:
    """(kind, total, embedded, pending) of each type, and over all under a null type."""
    done = F.count_if(F.coalesce(F.col(has), F.lit(False)))
    return chunks.rollup(kind).agg(F.count("*").alias("total"), done.alias("embedded"), (F.count("*") - done).alias("pending"), F.grouping(kind).alias("_all")).where(F.col("_all").eqNullSafe(1) | F.col(kind).isNotNull()).drop("_all")


def modal_model(chunks: DataFrame, model: str = "embed_model") -> DataFrame:
    """One row: the most frequent model (ties: the smallest), null without any."""
    return chunks.agg(F.mode(model, True).alias("model"))


def chunk_kinds(chunks: DataFrame, kind: str = "chunk_type") -> DataFrame:
    return chunks.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n"))


def fulltext_funnel(articles: DataFrame, chunks: DataFrame, has_pdf: str = "has_pdf", kind: str = "chunk_type", key: str = "doi") -> DataFrame:
    """(stage, n): all articles, those with a linked file, those with full-text chunks; and files without any text."""
    full = chunks.where(F.col(kind) == "fulltext").select(F.col(key)).distinct().withColumn("_full", F.lit(True))
    n = articles.join(full, key, "left").agg(F.count("*").alias("all"), F.count_if(F.coalesce(F.col(has_pdf), F.lit(False))).alias("pdf"), F.count("_full").alias("fulltext"))
    empty = F.greatest(F.col("pdf") - F.col("fulltext"), F.lit(0)).alias("without_text")
    return n.select("all", "pdf", "fulltext", empty).unpivot([], ["all", "pdf", "fulltext", "without_text"], "stage", "n")


def venue_positions(articles: DataFrame, semantics: DataFrame, least: int = 3, key: str = "doi") -> DataFrame:
    """(venue, map_x, map_y, articles, margin, source): centroids of venues with `least` placed articles, their mean
    margin and most frequent source (ties: the smallest)."""
    placed = articles.join(semantics, key).where("map_x is not null and map_y is not null and venue is not null")
    got = placed.groupBy("venue").agg(F.avg("map_x").alias("map_x"), F.avg("map_y").alias("map_y"), F.count("*").alias("articles"), F.avg("margin").alias("margin"), F.mode("source", True).alias("source"))
    return got.where(F.col("articles") >= least)


def theme_positions(points: DataFrame, theme: str = "theme") -> DataFrame:
    """(theme, map_x, map_y): the median place of a theme's points."""
    return points.where(F.col(theme).isNotNull()).groupBy(theme).agg(F.median("map_x").alias("map_x"), F.median("map_y").alias("map_y"))


def headline_totals(funnel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of column sums, zero for none."""
    return funnel.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def low_tail(scored: DataFrame, score: str, percent: float = 10.0) -> DataFrame:
    """Rows below the percentile of a score (interpolated), with the cut and the median."""
    cut = scored.agg(F.percentile(score, percent / 100).alias("cut"), F.median(score).alias("middle"))
    return scored.join(F.broadcast(cut)).where(F.col(score) < F.col("cut"))  # one row


def reference_coverage(articles: DataFrame, refs: DataFrame, key: str = "doi", source: str = "source") -> DataFrame:
    """(source, works, listed, share): works with a known key, and those with a reference list; keys in lower case."""
    have = refs.select(F.lower(key).alias("_k")).distinct()
    works = articles.where(F.col(key).isNotNull()).withColumn("_k", F.lower(key))
    marked = works.join(have.withColumn("_in", F.lit(1)), "_k", "left")
    return marked.groupBy(source).agg(F.count("*").alias("works"), F.count("_in").alias("listed"), F.avg(F.coalesce("_in", F.lit(0))).alias("share"))


def prefix_coverage(articles: DataFrame, refs: DataFrame, prefix: str, key: str = "doi", origin: str = "reference_source") -> DataFrame:
    """(origin, works): the works of a registrant (key prefix) by where their list comes from, and all of them under null."""
    mine = articles.where(F.lower(key).startswith(prefix)).select(F.lower(key).alias("_k")).distinct()
    first = refs.where(F.lower(key).startswith(prefix)).groupBy(F.lower(key).alias("_k")).agg(F.min(origin).alias(origin))
    listed = mine.join(first, "_k").groupBy(origin).agg(F.count("*").alias("works"))
    return listed.unionByName(mine.agg(F.lit(None).cast("string").alias(origin), F.count("*").alias("works")))


def duplicate_queue(pairs: DataFrame, articles: DataFrame, key: str = "doi", title: str = "title") -> DataFrame:
    """Pairs with both titles (null where unknown) and a similarity of four digits; show them by it, descending."""
    names = articles.groupBy(F.col(key).alias("_k")).agg(F.min(title).alias("_t"))
    one = names.select(F.col("_k").alias("a"), F.col("_t").alias("title_a"))
    two = names.select(F.col("_k").alias("b"), F.col("_t").alias("title_b"))
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", "title_a", "title_b", F.round("similarity", 4).alias("similarity"))


def missing_keys(asked: DataFrame, known: DataFrame, key: str = "doi") -> DataFrame:
    """Keys asked for that are not known, once each."""
    return asked.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
