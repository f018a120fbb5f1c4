"""Queries of operators/authors.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import authors as op
from quarryleaf.plans.adapters import ARTICLES, AUTHORS, articles, author_rows, table
from quarryleaf.registry import query


def rounded(df, digits, *columns):
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


@query("author_year_counts", f"WITH {AUTHORS} SELECT author, year, count(DISTINCT doi) AS n FROM author_rows WHERE year IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return op.by_year(author_rows(spark, d))


@query("author_year_matrix", f"WITH {AUTHORS} SELECT author, {', '.join(f'count(DISTINCT doi) FILTER (year = {y}) AS y{y}' for y in range(1995, 2002))}, count(DISTINCT doi) AS total FROM author_rows GROUP BY 1")
def _(spark, d):
    rows = author_rows(spark, d)
    years = range(1995, 2002)
    return rows.groupBy("author").agg(*(F.count_distinct(F.when(F.col("year") == y, F.col("doi"))).alias(f"y{y}") for y in years), F.count_distinct("doi").alias("total"))


@query("top_authors", f"WITH {AUTHORS} SELECT author, count(DISTINCT doi) AS n FROM author_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return op.top(author_rows(spark, d), 15)


@query("lead_authors", f"WITH {AUTHORS} SELECT author, count(DISTINCT doi) AS n FROM author_rows WHERE position <= 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return op.top(author_rows(spark, d), 15, most_position=1)


@query("author_bylines", "SELECT doc_id, CAST(i - 1 AS INT) AS position, trim(w[i]) AS author FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), ','), ',') AS w FROM documents)) WHERE trim(w[i]) <> ''")
def _(spark, d):
    lists = table(spark, d, "documents").select("doc_id", F.split("text", "[,\n]", -1).alias("authors"))
    return op.bylines(lists)


@query("author_display_names", "WITH n AS (SELECT s_name AS author, lower(substr(s_name, 1, 1)) || ' ' || lower(split_part(s_name, '#', 2)) AS k FROM supplier) SELECT count(*) AS suppliers, count(DISTINCT author) AS names FROM n")
def _(spark, d):
    rows = op.with_identity(table(spark, d, "supplier").select(F.col("s_name").alias("author")))
    return rows.agg(F.count("*").alias("suppliers"), F.count_distinct("author_display").alias("names"))


@query("emerging_authors", f"WITH {AUTHORS} SELECT author, min(year) AS first_year, count(*) AS papers, count(*) FILTER (year >= 1997) AS recent FROM author_rows GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return op.emerging(author_rows(spark, d), 2001)


@query("volume_vs_impact", f"WITH {AUTHORS} SELECT author, count(*) AS papers, round(avg(citation_count), 6) AS mean, round(sum(citation_count), 4) AS sum FROM author_rows GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return rounded(rounded(op.volume_and_impact(author_rows(spark, d), "citation_count"), 6, "mean"), 4, "sum")


_CORR = f"{AUTHORS}, v AS (SELECT author, count(*) AS x, avg(citation_count) AS y FROM author_rows GROUP BY 1), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)"


@query("output_impact_correlation", f"WITH {_CORR} SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r")
def _(spark, d):
    rows = author_rows(spark, d).groupBy("author").agg(F.count("*").alias("x"), F.avg("citation_count").alias("y"))
    return rounded(op.correlations(rows, "x", "y"), 6, "pearson", "spearman")


_RANKED = f"{AUTHORS}, k AS (SELECT author, coalesce(citation_count, 0) AS c, row_number() OVER (PARTITION BY author ORDER BY coalesce(citation_count, 0) DESC) AS i, sum(coalesce(citation_count, 0)) OVER (PARTITION BY author ORDER BY coalesce(citation_count, 0) DESC ROWS UNBOUNDED PRECEDING) AS u FROM author_rows), x AS (SELECT author, count(*) AS papers, sum(c) AS total, avg(c) AS mean, CAST(coalesce(max(i) FILTER (c >= i), 0) AS INT) AS h, CAST(coalesce(max(i) FILTER (u >= i * i), 0) AS INT) AS g, count(*) FILTER (c >= 10) AS i10, max(u) FILTER (c >= i) AS core FROM k GROUP BY 1 HAVING count(*) >= 2)"


@query("author_impact_indices", f"WITH {_RANKED} SELECT author, papers, round(total, 4) AS total, round(mean, 6) AS mean, h, g, i10, round(sqrt(greatest(coalesce(core, 0) - h * h, 0)), 5) AS e FROM x")
def _(spark, d):
    return rounded(rounded(rounded(op.impact_indices(author_rows(spark, d), "citation_count"), 6, "mean"), 4, "total"), 5, "e")


@query("author_m_quotients", f"WITH {_RANKED}, f AS (SELECT author, min(year) AS first_year FROM author_rows GROUP BY 1) SELECT author, papers, h, first_year, round_even(CAST(h AS DOUBLE) / greatest(1, 2002 - first_year + 1), 2) AS m FROM x JOIN f USING (author)")
def _(spark, d):
    return op.m_quotients(author_rows(spark, d), "citation_count", 2002)


@query("lotka_law", f"""WITH {AUTHORS}, p AS (SELECT author, count(DISTINCT doi) // 10 + 1 AS n FROM author_rows GROUP BY 1), l AS (SELECT log10(n) AS x, log10(count(*)) AS y, CAST(count(*) AS DOUBLE) * count(*) AS w FROM p GROUP BY n),
s AS (SELECT (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b, count(*) AS levels, avg(y) AS my FROM l),
c AS (SELECT b, levels, my, (SELECT (sum(w * y) - b * sum(w * x)) / sum(w) FROM l) AS a FROM s)
SELECT round(-b, 6) AS alpha, round(pow(10, a), 4) AS c, levels, round(1 - (SELECT sum(pow(y - a - b * x, 2)) FROM l) / (SELECT sum(pow(y - my, 2)) FROM l), 6) AS r2 FROM c""")
def _(spark, d):
    papers = author_rows(spark, d).groupBy("author").agg((F.floor(F.count_distinct("doi") / 10) + 1).alias("n"))
    return rounded(rounded(op.lotka(papers), 6, "alpha", "r2"), 4, "c")


@query("team_size_statistics", f"WITH {AUTHORS}, t AS (SELECT doi, any_value(source) AS source, count(DISTINCT author) AS size FROM author_rows GROUP BY 1) SELECT source, round(avg(size), 6) AS mean, quantile_cont(size, 0.5) AS median, round(avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END), 6) AS solo, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    teams = author_rows(spark, d).groupBy("doi").agg(F.first("source").alias("source"), F.count_distinct("author").alias("size"))
    return rounded(op.team_sizes(teams, "size", ["source"]), 6, "mean", "solo")


_EDGES = f"{AUTHORS}, o AS (SELECT DISTINCT doi, author, year FROM author_rows), e AS (SELECT x.author AS a, y.author AS b, count(*) AS weight FROM o x JOIN o y ON x.doi = y.doi AND x.author < y.author GROUP BY 1, 2)"


@query("coauthor_edges", f"WITH {_EDGES} SELECT * FROM e")
def _(spark, d):
    return op.edges(author_rows(spark, d))


@query("coauthor_partners", f"""WITH {_EDGES}, b AS (SELECT a AS author, b AS partner, weight FROM e UNION ALL SELECT b, a, weight FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY weight DESC, partner) AS i FROM b)
SELECT author, count(*) AS partners, count(*) FILTER (weight >= 2) AS recurrent, string_agg(partner || ' (' || weight || ')', ', ' ORDER BY i) FILTER (i <= 5) AS top FROM r GROUP BY 1""")
def _(spark, d):
    return op.partners(op.edges(author_rows(spark, d)))


@query("collaboration_periods", f"""WITH {_EDGES}, y AS (SELECT year, ntile(3) OVER (ORDER BY year) AS period FROM (SELECT DISTINCT year FROM o)),
m AS (SELECT DISTINCT y.period, p.author AS a, q.author AS b FROM o p JOIN o q ON p.doi = q.doi AND p.author < q.author JOIN y ON y.year = p.year), f AS (SELECT *, period = min(period) OVER (PARTITION BY a, b) AS n FROM m)
SELECT CAST(f.period AS INT) AS period, count(*) AS ties, count(*) FILTER (n) AS new, count(*) FILTER (NOT n) AS repeated, any_value(s.lo) AS first_year, any_value(s.hi) AS last_year FROM f JOIN (SELECT period, min(year) AS lo, max(year) AS hi FROM y GROUP BY 1) s ON s.period = f.period GROUP BY f.period""")
def _(spark, d):
    return op.period_ties(author_rows(spark, d))


@query("author_productivity_trend", f"""WITH {AUTHORS}, c AS (SELECT author, year, count(DISTINCT doi) AS n FROM author_rows GROUP BY 1, 2), g AS (SELECT author, unnest(range(lo, hi + 1)) AS year FROM (SELECT author, min(year) AS lo, max(year) AS hi FROM c GROUP BY 1)),
s AS (SELECT g.author, coalesce(regr_slope(coalesce(n, 0), g.year), 0) AS b FROM g LEFT JOIN c ON c.author = g.author AND c.year = g.year GROUP BY 1)
SELECT author, round(b, 6) AS slope, CASE WHEN b > 0.15 THEN 'growing' WHEN b < -0.15 THEN 'falling' ELSE 'stable' END AS trend FROM s""")
def _(spark, d):
    return rounded(op.productivity_trend(op.by_year(author_rows(spark, d))), 6, "slope")


@query("correlation_by_source", f"WITH {ARTICLES}, k AS (SELECT source, citation_count AS x, reference_count AS y FROM articles WHERE citation_count IS NOT NULL AND reference_count IS NOT NULL), r AS (SELECT source, x, y, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY source ORDER BY y) + (count(*) OVER (PARTITION BY source, y) - 1) / 2.0 AS ry FROM k) SELECT source, count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r GROUP BY 1")
def _(spark, d):
    out = op.correlations_by(articles(spark, d), "source", "citation_count", "reference_count")
    return out.select("source", "n", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))
