"""Queries of operators/windows.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import windows as op
from quarryleaf.plans.adapters import ARTICLES, AUTHORS, SOURCES, articles, author_rows, table
from quarryleaf.registry import query


@query("cumulative_by_source", f"""WITH {ARTICLES}, c AS (SELECT year, count(*) FILTER (source = 'F') AS f, count(*) FILTER (source = 'O') AS o, count(*) AS t FROM articles GROUP BY year)
SELECT year, CAST(sum(f) OVER w AS BIGINT) AS "F", CAST(sum(o) OVER w AS BIGINT) AS "O", CAST(sum(t) OVER w AS BIGINT) AS total FROM c WINDOW w AS (ORDER BY year ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return op.cumulative_by_source(articles(spark, d), "year", SOURCES)


@query("cumulative_by_category", f"""WITH {ARTICLES}, top AS (SELECT category FROM articles GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3),
c AS (SELECT year, CASE WHEN category IN (SELECT category FROM top) THEN category ELSE 'Others' END AS bucket, count(*) AS n FROM articles GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT year FROM c), (SELECT DISTINCT bucket FROM c))
SELECT year, bucket, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY bucket ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM g LEFT JOIN c USING (year, bucket)""")
def _(spark, d):
    return op.cumulative_by_category(articles(spark, d), "year", "category", 3)


@query("cumulative_new_authors", f"""WITH {AUTHORS}, f AS (SELECT author, min(year) AS year FROM author_rows GROUP BY 1), c AS (SELECT year, count(*) AS new FROM f GROUP BY 1)
SELECT year, new, CAST(sum(new) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c""")
def _(spark, d):
    return op.cumulative_new_keys(author_rows(spark, d), "author", "year")


@query("age_normalised_citations", f"""WITH {ARTICLES} SELECT doi, round(coalesce(citation_count, 0) / greatest(2002 - year + 1, 1), 6) AS annual_rate,
round((citation_count - avg(citation_count) OVER y) / (CASE WHEN coalesce(stddev_samp(citation_count) OVER y, 0) = 0 THEN 1 ELSE stddev_samp(citation_count) OVER y END), 5) AS z,
round(CASE WHEN citation_count IS NOT NULL THEN (rank() OVER (PARTITION BY year ORDER BY citation_count NULLS LAST) + (count(citation_count) OVER (PARTITION BY year, citation_count) - 1) / 2.0) / count(citation_count) OVER y END, 6) AS pct
FROM articles WINDOW y AS (PARTITION BY year)""")
def _(spark, d):
    return op.age_normalised(articles(spark, d), "year", "citation_count", 2002).select("doi", F.round("annual_rate", 6).alias("annual_rate"), F.round("z", 5).alias("z"), F.round("pct", 6).alias("pct"))


_OUTPUT = f"{AUTHORS}, o AS (SELECT author, count(DISTINCT doi) AS v FROM author_rows GROUP BY 1)"


def _output(spark, d):
    return author_rows(spark, d).groupBy("author").agg(F.count_distinct("doi").alias("v"))


@query("lorenz_curve", f"""WITH {_OUTPUT}, c AS (SELECT v, count(*) AS n FROM o GROUP BY v), t AS (SELECT sum(n) AS pn, sum(n * v) AS tn FROM c)
SELECT round(sum(n) OVER w / pn, 9) AS people, round(sum(n * v) OVER w / tn, 9) AS output FROM c, t WINDOW w AS (ORDER BY v) UNION ALL SELECT 0, 0""")
def _(spark, d):
    return op.lorenz(_output(spark, d), "v").select(F.round("people", 9).alias("people"), F.round("output", 9).alias("output"))


@query("gini", f"WITH {_OUTPUT}, r AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM o) SELECT round(2.0 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 9) AS gini FROM r")
def _(spark, d):
    return op.gini(_output(spark, d), "v").select(F.round("gini", 9).alias("gini"))


@query("bradford_zones", """WITH c AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, sum(n) OVER w - n AS before, row_number() OVER w AS place, sum(n) OVER () AS whole FROM c WINDOW w AS (ORDER BY n DESC, CAST(k AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
z AS (SELECT CAST(least(1 + floor(before * 3 / whole), place, 3) AS INT) AS zone, n FROM r), s AS (SELECT zone, count(*) AS venues, CAST(sum(n) AS BIGINT) AS articles FROM z GROUP BY 1) SELECT zone, venues, articles, round(venues / lag(venues) OVER (ORDER BY zone), 6) AS multiplier FROM s""")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return op.bradford_zones(rows, "l_partkey", "n").withColumn("multiplier", F.round("multiplier", 6))


@query("theme_share_smoothed", f"""WITH {ARTICLES}, g AS (SELECT * FROM (SELECT DISTINCT year FROM articles), (SELECT DISTINCT category FROM articles)),
c AS (SELECT g.year, g.category, count(a.doi) AS n FROM g LEFT JOIN articles a ON a.year = g.year AND a.category = g.category GROUP BY 1, 2),
s AS (SELECT year, category, n / sum(n) OVER (PARTITION BY year) AS share FROM c), m AS (SELECT *, avg(share) OVER (PARTITION BY category ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM s)
SELECT year, category, round(share, 9) AS share, round(smooth / sum(smooth) OVER (PARTITION BY year), 9) AS smooth FROM m""")
def _(spark, d):
    rows = op.cumulative_by_category(articles(spark, d), "year", "category", 100).withColumnRenamed("bucket", "category")
    return op.moving_share(rows, "category", "year", "n", 3).select("year", "category", F.round("share", 9).alias("share"), F.round("smooth", 9).alias("smooth"))


_REFS = f"{ARTICLES}, refs AS (SELECT l_orderkey AS doi, a.year, CASE WHEN l_quantity < 5 THEN NULL ELSE a.year - CAST(l_quantity AS INT) % 12 + 1 END AS reference_year FROM lineitem JOIN articles a ON a.doi = l_orderkey)"


def _refs(spark, d):
    year = F.when(F.col("l_quantity") >= 5, F.col("year") - F.col("l_quantity").cast("int") % 12 + 1)
    return table(spark, d, "lineitem").join(articles(spark, d), F.col("l_orderkey") == F.col("doi")).select("doi", "year", year.alias("reference_year"))


@query("price_index", f"""WITH {_REFS}, w AS (SELECT doi, year, count(*) AS listed, count(reference_year) AS dated, count(*) FILTER (year - reference_year <= 5) AS recent FROM refs
WHERE reference_year IS NULL OR year - reference_year >= -1 GROUP BY 1, 2)
SELECT year, count(*) AS works, round(sum(recent) / sum(dated), 9) AS price FROM w WHERE dated > 0 AND dated >= 0.8 * listed GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, d):
    return op.price_index(_refs(spark, d)).withColumn("price", F.round("price", 9))


_SERIES = """tr AS (SELECT l_suppkey AS doi, 1995 + l_suppkey % 3 AS publication_year, CAST(year(l_shipdate) AS INT) AS year, count(*) AS citations FROM lineitem GROUP BY 1, 2, 3),
h AS (SELECT doi, greatest(year - publication_year, 0) AS t, sum(citations) AS c FROM tr WHERE year <= 2001 GROUP BY 1, 2),
g AS (SELECT doi, unnest(range(0, 2001 - publication_year + 1)) AS t FROM (SELECT DISTINCT doi, publication_year FROM tr)),
s AS (SELECT g.doi, CAST(g.t AS INT) AS t, CAST(coalesce(h.c, 0) AS BIGINT) AS c FROM g LEFT JOIN h ON h.doi = g.doi AND h.t = g.t)"""


def _series(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doi"), (1995 + F.col("l_suppkey") % 3).cast("int").alias("publication_year"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("citations"))
    return op.citation_series(rows, 2001)


@query("citation_series", f"WITH {_SERIES} SELECT * FROM s")
def _(spark, d):
    return _series(spark, d)


@query("citation_half_lives", f"""WITH {_SERIES}, u AS (SELECT doi, t, sum(c) OVER (PARTITION BY doi ORDER BY t) AS upto, sum(c) OVER (PARTITION BY doi) AS total, max(t) OVER (PARTITION BY doi) AS age FROM s)
SELECT doi, CAST(total AS BIGINT) AS total, min(t) AS half_life FROM u WHERE age >= 5 AND total >= 10 AND upto >= total / 2 GROUP BY 1, 2""")
def _(spark, d):
    return op.half_lives(_series(spark, d))


@query("sleeping_beauties", f"""WITH {_SERIES}, w AS (SELECT doi, sum(c) AS total, max(c) AS cm, max(c) FILTER (t = 0) AS c0 FROM s GROUP BY 1 HAVING sum(c) >= 10),
p AS (SELECT s.doi, min(t) AS peak FROM s JOIN w USING (doi) WHERE c = cm GROUP BY 1),
r AS (SELECT s.doi, t, c, peak, cm, c0 FROM s JOIN w USING (doi) JOIN p USING (doi) WHERE t <= peak),
a AS (SELECT doi, peak, CASE WHEN peak > 0 THEN ((cm - c0) / peak * t + c0 - c) / greatest(1, c) ELSE 0 END AS b, t, abs((cm - c0) * t - peak * c + peak * c0) AS away FROM r)
SELECT doi, peak, round(sum(b), 6) AS beauty, CASE WHEN peak > 0 THEN (SELECT min(t) FROM a x WHERE x.doi = a.doi AND x.away = (SELECT max(away) FROM a y WHERE y.doi = a.doi)) END AS awakening FROM a GROUP BY doi, peak""")
def _(spark, d):
    return op.sleeping_beauties(_series(spark, d)).withColumn("beauty", F.round("beauty", 6))


@query("reference_ecdf", f"""WITH {ARTICLES}, c AS (SELECT source, reference_count, count(*) AS n FROM articles WHERE reference_count IS NOT NULL GROUP BY 1, 2)
SELECT source, reference_count, round(sum(n) OVER (PARTITION BY source ORDER BY reference_count) / sum(n) OVER (PARTITION BY source), 9) AS share FROM c""")
def _(spark, d):
    return op.ecdf(articles(spark, d), "reference_count", "source").withColumn("share", F.round("share", 9))
