"""Queries of operators/counts.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import counts as op
from quarryleaf.plans.adapters import ARTICLES, AUTHORS, SOURCES, articles, author_rows, table
from quarryleaf.registry import query

CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query("counts_by_source_year", f"WITH {ARTICLES} SELECT year, count(*) FILTER (source = 'F') AS \"F\", count(*) FILTER (source = 'O') AS \"O\", count(*) AS total FROM articles GROUP BY year")
def _(spark, d):
    return op.source_counts_by(articles(spark, d), "year", SOURCES)


@query("cited_counts_by_year", f"WITH {ARTICLES} SELECT year, count(*) FILTER (source = 'F') AS \"F\", count(*) FILTER (source = 'O') AS \"O\", count(*) AS total FROM articles WHERE citation_count > 100 GROUP BY year")
def _(spark, d):
    return op.source_counts_by(articles(spark, d).where("citation_count > 100"), "year", SOURCES)


@query("source_means", f"WITH {ARTICLES} SELECT round(avg(citation_count) FILTER (source = 'F'), 6) AS \"F\", round(avg(citation_count) FILTER (source = 'O'), 6) AS \"O\", round(avg(citation_count), 6) AS total FROM articles")
def _(spark, d):
    return op.source_means(articles(spark, d), "citation_count", SOURCES).select(*(F.round(c, 6).alias(c) for c in (*SOURCES, "total")))


@query("category_totals", f"WITH {ARTICLES}, k(category) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('other')) SELECT k.category, count(a.doi) AS n FROM k LEFT JOIN (SELECT doi, CASE WHEN category IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN category ELSE 'other' END AS category FROM articles) a USING (category) GROUP BY 1")
def _(spark, d):
    return op.domain_totals(articles(spark, d), "category", CATEGORIES)


@query("category_counts_by_year", f"WITH {ARTICLES} SELECT year, count(*) FILTER (category = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (category = '2-HIGH') AS \"2-HIGH\", count(*) FILTER (category = '3-MEDIUM') AS \"3-MEDIUM\", count(*) FILTER (category NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS other, count(*) AS total FROM articles GROUP BY year")
def _(spark, d):
    return op.domain_counts_by(articles(spark, d), "year", "category", CATEGORIES)


@query("metadata_coverage", f"""WITH {ARTICLES}, c AS (SELECT source, count(*) AS n_total, count(citation_count) AS citation_count, count(*) FILTER (trim(venue) <> '') AS venue FROM articles GROUP BY source)
SELECT source, n_total, 'citation_count' AS field, citation_count AS n_present, round(citation_count / n_total, 6) AS coverage FROM c UNION ALL SELECT source, n_total, 'venue', venue, round(venue / n_total, 6) FROM c""")
def _(spark, d):
    return op.coverage_matrix(articles(spark, d), "source", ["citation_count", "venue", "absent_field"]).withColumn("coverage", F.round("coverage", 6))


@query("distinct_authors_by_year", f"WITH {AUTHORS} SELECT year, count(DISTINCT author) FILTER (source = 'F') AS \"F\", count(DISTINCT author) FILTER (source = 'O') AS \"O\", count(DISTINCT author) AS total FROM author_rows GROUP BY year")
def _(spark, d):
    return op.distinct_by(author_rows(spark, d), "year", "author", SOURCES)


_FUNNEL = """f AS (SELECT 'orders' AS layer, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY 2 UNION ALL
SELECT 'lines', o_orderstatus, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2)"""


def _funnel(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "source")
    return op.funnel({"orders": orders, "lines": table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))}, "source")


@query("layer_funnel", f"WITH {_FUNNEL} SELECT * FROM f")
def _(spark, d):
    return _funnel(spark, d)


@query("layer_drift", f"WITH {_FUNNEL} SELECT source, CAST(sum(n) FILTER (layer = 'lines') - sum(n) FILTER (layer = 'orders') AS BIGINT) AS drift FROM f GROUP BY source")
def _(spark, d):
    return op.drift(_funnel(spark, d), "source", "lines", "orders")


@query("text_length_histogram", "SELECT lang, CAST(least(floor((n_chars - 0.0) / 500.0) + 1, 40) AS INT) AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 20000 GROUP BY 1, 2")
def _(spark, d):
    return op.histogram(table(spark, d, "documents"), "n_chars", 0.0, 20000.0, 40, ["lang"])


@query("citation_quartiles", f"WITH {ARTICLES} SELECT source, round(quantile_cont(citation_count, 0.25), 6) AS q1, round(quantile_cont(citation_count, 0.5), 6) AS median, round(quantile_cont(citation_count, 0.75), 6) AS q3, round(avg(citation_count), 6) AS mean, min(citation_count) AS low, max(citation_count) AS high, count(*) AS n FROM articles WHERE citation_count IS NOT NULL GROUP BY source")
def _(spark, d):
    return op.quartiles(articles(spark, d), "citation_count", ["source"]).select("source", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "mean")), "low", "high", "n")


_BRANDS = "b AS (SELECT p_brand AS venue, o_orderstatus AS source, l_quantity AS citation_count FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
_MODE = "(SELECT venue, source AS modal_source FROM (SELECT venue, source, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, source) AS r FROM b GROUP BY 1, 2) WHERE r = 1)"


def _brands(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("p_brand").alias("venue"), F.col("o_orderstatus").alias("source"), F.col("l_quantity").alias("citation_count"))


@query("top_venues", f"WITH {_BRANDS} SELECT venue, count(*) AS n, any_value(modal_source) AS modal_source, count(*) FILTER (source = 'F') AS \"F\", count(*) FILTER (source = 'O') AS \"O\" FROM b JOIN {_MODE} USING (venue) GROUP BY venue ORDER BY n DESC, venue LIMIT 15")
def _(spark, d):
    return op.top_groups(_brands(spark, d), "venue", 15, SOURCES)


@query("top_venues_by_mean", f"WITH {_BRANDS} SELECT venue, count(*) AS n, any_value(modal_source) AS modal_source, round(avg(citation_count), 6) AS mean_value FROM b JOIN {_MODE} USING (venue) GROUP BY venue HAVING count(*) >= 3 ORDER BY avg(citation_count) DESC, venue LIMIT 15")
def _(spark, d):
    return op.top_groups(_brands(spark, d), "venue", 15, value="citation_count", least=3).withColumn("mean_value", F.round("mean_value", 6))


@query("corpus_summary", f"WITH {ARTICLES} SELECT count(*) AS n, count(DISTINCT venue) AS n_venue, count(DISTINCT year) AS n_year, round(avg(citation_count), 6) AS mean_citation_count, count(*) FILTER (trim(venue) <> '') AS with_venue FROM articles")
def _(spark, d):
    return op.summary(articles(spark, d), ["venue", "year"], ["citation_count"], ["venue"]).withColumn("mean_citation_count", F.round("mean_citation_count", 6))


_KW = "k AS (SELECT doc_id, lang, source, string_split(replace(text, chr(10), ' '), ' ') AS keywords FROM documents), v AS (SELECT doc_id, lang, source, lower(trim(u)) AS value FROM (SELECT doc_id, lang, source, unnest(keywords) AS u FROM k) WHERE trim(u) <> '')"


def _keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.split("text", "[ \n]", -1).alias("keywords"))


@query("keyword_counts", f"WITH {_KW} SELECT value, count(*) AS n, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1 FROM v GROUP BY value ORDER BY n DESC, value LIMIT 20")
def _(spark, d):
    rows = op.explode_values(_keywords(spark, d), "keywords", ["source"])
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "src0").alias("src0"), F.count_if(F.col("source") == "src1").alias("src1")).orderBy(F.desc("n"), "value").limit(20)


@query("keyword_statistics", f"WITH {_KW} SELECT CAST(sum(len(keywords)) AS BIGINT) AS occurrences, round(avg(len(keywords)), 6) AS mean_per_row, round(avg(CASE WHEN len(keywords) = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_empty FROM k")
def _(spark, d):
    return op.list_statistics(_keywords(spark, d), "keywords").select("occurrences", F.round("mean_per_row", 6).alias("mean_per_row"), F.round("share_empty", 6).alias("share_empty"))


@query("keyword_share", f"WITH {_KW}, c AS (SELECT lang, value, count(*) AS n FROM v GROUP BY 1, 2) SELECT lang, value, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM c")
def _(spark, d):
    rows = op.explode_values(_keywords(spark, d), "keywords", ["lang"]).groupBy("lang", "value").agg(F.count("*").alias("n"))
    return op.share_within(rows, "lang", "value").withColumn("share", F.round("share", 9))


@query("first_appearance", f"WITH {AUTHORS} SELECT author, min(year) AS first_year, count(*) AS n FROM author_rows GROUP BY author HAVING count(*) >= 15")
def _(spark, d):
    return op.first_appearance(author_rows(spark, d), "author", "year", 15)


@query("nation_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
