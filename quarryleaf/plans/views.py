"""Queries of operators/views.py. An article's keywords are the names of the parts in its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import views as op
from quarryleaf.operators import windows
from quarryleaf.plans.adapters import ARTICLES, AUTHORS, KEYWORDS, articles, author_rows, keyword_rows, table
from quarryleaf.plans.text import rounded
from quarryleaf.plans.windows import _SERIES, _series
from quarryleaf.registry import query

_ROWS = AUTHORS.replace(ARTICLES + ", ", "")  # beside the keywords, which name the articles


def _top(column: str) -> str:
    return f"WITH {ARTICLES} SELECT doi, year, venue, source, citation_count, reference_count FROM articles WHERE {column} > 0 ORDER BY {column} DESC, doi LIMIT 20"


_SHOWN = ("doi", "year", "venue", "source", "citation_count", "reference_count")


@query("most_cited", _top("citation_count"))
def _(spark, d):
    return op.most_cited(articles(spark, d)).select(*_SHOWN)


@query("longest_bibliographies", _top("reference_count"))
def _(spark, d):
    return op.longest_bibliographies(articles(spark, d)).select(*_SHOWN)


@query("fastest_cited", f"""WITH {ARTICLES}, r AS (SELECT doi, year, coalesce(citation_count, 0) / greatest(2002 - year + 1, 1) AS rate,
  (rank() OVER (PARTITION BY year ORDER BY citation_count NULLS LAST) + (count(citation_count) OVER (PARTITION BY year, citation_count) - 1) / 2.0) / count(citation_count) OVER (PARTITION BY year) AS pct, citation_count FROM articles)
SELECT doi, year, round(rate, 2) AS annual_rate, round(CASE WHEN citation_count IS NOT NULL THEN pct END, 2) AS pct FROM r ORDER BY rate DESC, doi LIMIT 20""")
def _(spark, d):
    return op.fastest_cited(articles(spark, d), 2002).select("doi", "year", "annual_rate", "pct")


_BEAUTY = f"""{_SERIES}, w AS (SELECT doi, sum(c) AS total, max(c) AS cm, max(c) FILTER (t = 0) AS c0 FROM s GROUP BY 1 HAVING sum(c) >= 10),
p AS (SELECT s.doi, min(t) AS peak FROM s JOIN w USING (doi) WHERE c = cm GROUP BY 1),
b AS (SELECT s.doi, peak, sum(CASE WHEN peak > 0 THEN ((cm - c0) / peak * t + c0 - c) / greatest(1, c) ELSE 0 END) AS beauty FROM s JOIN w USING (doi) JOIN p USING (doi) WHERE t <= peak GROUP BY 1, 2)"""


def _scores(spark, d):
    return windows.sleeping_beauties(_series(spark, d)).withColumn("beauty", F.round("beauty", 6))


@query("delayed_recognition", f"WITH {_BEAUTY} SELECT doi, peak, round(beauty, 6) AS beauty, s_name AS title FROM (SELECT * FROM b ORDER BY round(beauty, 6) DESC, doi LIMIT 10) LEFT JOIN (SELECT s_suppkey, 'Supplier ' || s_suppkey AS s_name FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = doi")
def _(spark, d):
    k = F.col("s_suppkey")
    names = table(spark, d, "supplier").where(k % 4 != 0).select(k.alias("doi"), F.concat(F.lit("Supplier "), k.cast("string")).alias("title"))
    return op.delayed_recognition(_scores(spark, d), names).select("doi", "peak", "beauty", "title")


@query("recognition_summary", f"WITH {_BEAUTY} SELECT count(*) AS works, round(median(round(beauty, 6)), 6) AS median_beauty, count(*) FILTER (peak = 2001 - (1995 + doi % 3)) AS peak_last FROM b")
def _(spark, d):
    return rounded(op.recognition_summary(_scores(spark, d), 2001 - (1995 + F.col("doi") % 3)), 6, "median_beauty")


@query("observation_year", "SELECT CAST(year(max(ts)) AS INT) AS year, 'latest observation' AS basis FROM events UNION ALL SELECT 2001, 'configured' FROM (SELECT max(ts) FROM events WHERE value < -1e9)")
def _(spark, d):
    e = table(spark, d, "events")
    return op.observation_year(e, "ts", 2001, "configured").unionByName(op.observation_year(e.where("value < -1e9"), "ts", 2001, "configured"))


_LINES = f"{KEYWORDS}, {_ROWS}, top AS (SELECT value FROM keywords GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 60), lines AS (SELECT DISTINCT value, doi FROM keywords WHERE value IN (SELECT value FROM top))"


def _lines(spark, d):
    return op.line_articles(keyword_rows(spark, d))


@query("keyword_lines", f"WITH {KEYWORDS} SELECT value, count(*) AS mentions FROM keywords GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def _(spark, d):
    return op.keyword_lines(keyword_rows(spark, d))


@query("line_leaders", f"""WITH {_LINES}, c AS (SELECT value, author, count(DISTINCT doi) AS articles FROM lines JOIN author_rows USING (doi) GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY value ORDER BY articles DESC, author) AS INT) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return op.line_leaders(_lines(spark, d), author_rows(spark, d))


@query("line_trend", f"WITH {_LINES} SELECT value, year, count(DISTINCT doi) AS articles FROM lines JOIN (SELECT DISTINCT doi, year FROM author_rows WHERE year IS NOT NULL) USING (doi) GROUP BY 1, 2")
def _(spark, d):
    return op.line_trend(_lines(spark, d), author_rows(spark, d))


@query("line_researchers", f"""WITH {_LINES}, k AS (SELECT DISTINCT value, author, year FROM lines JOIN author_rows USING (doi)), e AS (SELECT value, year, count(*) AS researchers FROM k GROUP BY 1, 2),
n AS (SELECT value, year, count(*) AS newcomers FROM (SELECT value, author, min(year) AS year FROM k GROUP BY 1, 2) GROUP BY 1, 2)
SELECT value, year, researchers, coalesce(newcomers, 0) AS newcomers, CAST(sum(coalesce(newcomers, 0)) OVER (PARTITION BY value ORDER BY year) AS BIGINT) AS so_far FROM e LEFT JOIN n USING (value, year)""")
def _(spark, d):
    return op.line_researchers(_lines(spark, d), author_rows(spark, d))


@query("line_ranking", f"WITH {_LINES} SELECT value, doi, citation_count, CAST(row_number() OVER (PARTITION BY value ORDER BY citation_count DESC NULLS LAST, doi) AS INT) AS rank FROM lines JOIN articles USING (doi) WHERE doi IN (SELECT doi FROM author_rows)")
def _(spark, d):
    return op.line_ranking(_lines(spark, d), articles(spark, d), author_rows(spark, d)).select("value", "doi", "citation_count", "rank")


@query("keyword_explorer", f"WITH {KEYWORDS}, h AS (SELECT DISTINCT doi FROM keywords WHERE value IN ('small ring', 'blue bolt', 'no such')) SELECT doi, citation_count FROM articles JOIN h USING (doi)")
def _(spark, d):
    lists = keyword_rows(spark, d).groupBy("doi").agg(F.collect_set("value").alias("keywords"))
    found = op.keyword_explorer(articles(spark, d).join(lists, "doi", "left"), "keywords", ("small ring", "blue bolt", "no such"))
    return found.select("doi", "citation_count")


@query("prolific_authors", f"WITH {AUTHORS} SELECT author, count(DISTINCT doi) AS articles FROM author_rows GROUP BY 1 HAVING count(DISTINCT doi) >= 3")
def _(spark, d):
    return op.prolific(author_rows(spark, d))


_WORKING = f"{KEYWORDS}, {_ROWS}, working AS (SELECT author, value, k.year FROM (SELECT DISTINCT author, doi FROM author_rows) a JOIN keywords k USING (doi) WHERE author IN (SELECT author FROM author_rows GROUP BY 1 HAVING count(DISTINCT doi) >= 3))"


def _working(spark, d):
    return op.author_keywords(author_rows(spark, d), keyword_rows(spark, d))


@query("author_keyword_profile", f"""WITH {_WORKING}, c AS (SELECT author, value, count(*) AS mentions FROM working GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY author ORDER BY mentions DESC, value) AS INT) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return op.keyword_profile(_working(spark, d))


@query("author_keyword_shift", f"""WITH {_WORKING}, m AS (SELECT author, CAST(floor(median(year)) AS INT) AS split FROM working GROUP BY 1 HAVING count(DISTINCT year) >= 2),
c AS (SELECT author, value, split, count(*) FILTER (year <= split) AS early, count(*) FILTER (year > split) AS late FROM working JOIN m USING (author) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY author ORDER BY late DESC, value) AS INT) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return op.keyword_shift(_working(spark, d))


@query("rising_falling", f"""WITH {KEYWORDS}, c AS (SELECT value, year, count(*) AS c FROM keywords WHERE year IS NOT NULL GROUP BY 1, 2), e AS (SELECT value FROM c GROUP BY 1 HAVING sum(c) >= 20 AND count(*) >= 3),
s AS (SELECT value, year, 100.0 * c / sum(c) OVER (PARTITION BY year) AS share FROM c), f AS (SELECT value, regr_slope(share, year) AS slope FROM s WHERE value IN (SELECT value FROM e) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY slope, value) AS a, row_number() OVER (ORDER BY slope DESC, value) AS b FROM f),
y AS (SELECT DISTINCT year FROM c), z AS (SELECT value, y.year, coalesce(c.c, 0) AS c FROM (SELECT DISTINCT value FROM c) JOIN y ON TRUE LEFT JOIN c USING (value, year)),
m AS (SELECT p.value, median((q.c - p.c) / (q.year - p.year)) AS sen FROM z p JOIN z q ON p.value = q.value AND p.year < q.year GROUP BY 1)
SELECT value, round(slope, 6) AS slope, CASE WHEN slope >= 0 THEN 'rising' ELSE 'falling' END AS direction, round(sen, 6) AS sen FROM r JOIN m USING (value) WHERE a <= 7 OR b <= 7""")
def _(spark, d):
    """Intervals and p-values need Student's and the normal distribution; checked in tests against plain versions."""
    return rounded(op.rising_falling(keyword_rows(spark, d)).select("value", "slope", "direction", "sen"), 6, "slope", "sen")


@query("rising_falling_tests")
def _(spark, d):
    """Intervals, p-values and their adjustment within the family; checked in tests against plain versions."""
    return rounded(op.rising_falling(keyword_rows(spark, d)), 6, "slope", "low", "high", "p", "p_adjusted", "sen", "p_serial", "p_serial_adjusted")


@query("growth_ranking", f"""WITH {KEYWORDS}, f AS (SELECT value AS keyword, count(*) FILTER (year = 2000) - count(*) FILTER (year = 1996) AS variation FROM keywords GROUP BY 1)
SELECT keyword, variation, CAST(row_number() OVER (ORDER BY variation DESC, keyword) AS INT) AS rank FROM f ORDER BY 2 DESC, 1 LIMIT 15""")
def _(spark, d):
    f = keyword_rows(spark, d).groupBy(F.col("value").alias("keyword")).agg((F.count_if(F.col("year") == 2000) - F.count_if(F.col("year") == 1996)).alias("variation"))
    return op.growth_ranking(f, 15)


_PLACES = """placed AS (SELECT o_orderkey AS doi, list(DISTINCT n_name) AS countries FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
ext AS (SELECT o_orderkey AS doi, o_orderstatus AS source, o_orderpriority AS license, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END AS online_date, countries FROM orders LEFT JOIN placed ON doi = o_orderkey)"""


def _extended(spark, d):
    """Articles with countries, a date that some lack, and a licence."""
    t = lambda n: table(spark, d, n)
    lands = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    countries = lands.groupBy(F.col("l_orderkey").alias("doi")).agg(F.collect_set("n_name").alias("countries"))
    orders = t("orders").select(F.col("o_orderkey").alias("doi"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("license"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderdate")).alias("online_date"))
    return orders.join(countries, "doi", "left")


@query("country_participation", f"WITH {_PLACES}, c AS (SELECT unnest(countries) AS country FROM placed) SELECT country, count(*) AS articles FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return op.countries(_extended(spark, d))


@query("articles_by_month", f"WITH {_PLACES} SELECT CAST(CAST(date_trunc('month', online_date) AS DATE) AS VARCHAR) AS month, count(*) AS articles FROM ext WHERE online_date IS NOT NULL GROUP BY 1")
def _(spark, d):
    return op.by_month(_extended(spark, d), "online_date").withColumn("month", F.col("month").cast("string"))


@query("declared_licences", f"WITH {_PLACES} SELECT count(license) AS declared, count(DISTINCT license) AS kinds, count(*) FILTER (contains(license, 'GEN') OR contains(license, 'HIGH')) AS marked FROM (SELECT license FROM ext WHERE contains(license, 'H') OR license IS NULL)")
def _(spark, d):
    return op.declared(_extended(spark, d).where("contains(license, 'H') or license is null"), "license", "HIGH")


@query("source_fields", f"WITH {_PLACES} SELECT count(*) FILTER (source = 'F') AS articles, count(*) FILTER (source = 'F' AND len(coalesce(countries, [])) > 0) AS with_country, count(*) FILTER (source = 'F' AND online_date IS NOT NULL) AS with_date, round(avg(CASE WHEN source = 'F' THEN 1.0 ELSE 0.0 END), 9) AS share FROM ext")
def _(spark, d):
    return rounded(op.source_fields(_extended(spark, d), "F", "countries", "online_date"), 9, "share")


_CHUNKS = "ch AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'fulltext' WHEN event_type <> 'error' THEN 'abstract' END AS chunk_type, value > 20 AS has_embedding, 'model-' || (user_id % 3) AS embed_model, user_id AS doi FROM events)"


def _chunks(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "click", "fulltext").when(t != "error", "abstract")
    return table(spark, d, "events").select("event_id", kind.alias("chunk_type"), (F.col("value") > 20).alias("has_embedding"), F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("embed_model"), F.col("user_id").alias("doi"))


@query("embedding_readiness", f"WITH {_CHUNKS}, g AS (SELECT chunk_type, count(*) AS total, count(*) FILTER (has_embedding) AS embedded, count(*) - count(*) FILTER (has_embedding) AS pending FROM ch WHERE chunk_type IS NOT NULL GROUP BY 1) SELECT * FROM g UNION ALL SELECT NULL, count(*), count(*) FILTER (has_embedding), count(*) - count(*) FILTER (has_embedding) FROM ch")
def _(spark, d):
    return op.embedding_readiness(_chunks(spark, d))


@query("modal_model", f"WITH {_CHUNKS} SELECT embed_model AS model FROM ch GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def _(spark, d):
    return op.modal_model(_chunks(spark, d))


@query("chunk_kinds", f"WITH {_CHUNKS} SELECT chunk_type, count(*) AS n FROM ch WHERE chunk_type IS NOT NULL GROUP BY 1")
def _(spark, d):
    return op.chunk_kinds(_chunks(spark, d))


@query("fulltext_funnel", f"""WITH {_CHUNKS}, a AS (SELECT c_custkey AS doi, c_custkey % 4 > 0 AS has_pdf FROM customer), n AS (SELECT count(*) AS al, count(*) FILTER (has_pdf) AS pdf, count(*) FILTER (doi IN (SELECT doi FROM ch WHERE chunk_type = 'fulltext')) AS ft FROM a)
SELECT 'all' AS stage, al AS n FROM n UNION ALL SELECT 'pdf', pdf FROM n UNION ALL SELECT 'fulltext', ft FROM n UNION ALL SELECT 'without_text', greatest(pdf - ft, 0) FROM n""")
def _(spark, d):
    k = F.col("c_custkey")
    return op.fulltext_funnel(table(spark, d, "customer").select(k.alias("doi"), (k % 4 > 0).alias("has_pdf")), _chunks(spark, d))


_POINTS = "pt AS (SELECT vec_id AS doi, CAST(embedding[1] AS DOUBLE) AS map_x, CAST(CASE WHEN vec_id % 11 > 0 THEN embedding[2] END AS DOUBLE) AS map_y, CAST(embedding[3] AS DOUBLE) AS margin, label FROM embeddings)"


def _points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doi"), e[0].cast("double").alias("map_x"), F.when(F.col("vec_id") % 11 > 0, e[1]).cast("double").alias("map_y"), e[2].cast("double").alias("margin"), "label")


@query("venue_positions", f"""WITH {ARTICLES}, {_POINTS}, j AS (SELECT * FROM articles JOIN pt USING (doi) WHERE map_x IS NOT NULL AND map_y IS NOT NULL AND venue IS NOT NULL),
m AS (SELECT venue, source, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, source) AS r FROM j GROUP BY 1, 2)
SELECT venue, round(avg(map_x), 6) AS map_x, round(avg(map_y), 6) AS map_y, count(*) AS articles, round(avg(margin), 6) AS margin, any_value(m.source) AS source FROM j JOIN m USING (venue) WHERE r = 1 GROUP BY venue HAVING count(*) >= 3""")
def _(spark, d):
    return rounded(op.venue_positions(articles(spark, d), _points(spark, d)), 6, "map_x", "map_y", "margin")


@query("theme_positions", f"WITH {_POINTS} SELECT label AS theme, round(median(map_x), 6) AS map_x, round(median(map_y), 6) AS map_y FROM pt WHERE label IS NOT NULL GROUP BY 1")
def _(spark, d):
    return rounded(op.theme_positions(_points(spark, d).withColumnRenamed("label", "theme")), 6, "map_x", "map_y")


@query("headline_totals", "SELECT CAST(sum(n) AS BIGINT) AS raw, CAST(sum(k) AS BIGINT) AS bronze FROM (SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders GROUP BY 1)")
def _(spark, d):
    f = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("raw"), F.count_distinct("o_custkey").alias("bronze"))
    return op.headline_totals(f, ("raw", "bronze"))


@query("low_relevance_tail", f"WITH {_POINTS}, c AS (SELECT quantile_cont(margin, 0.1) AS cut, median(margin) AS middle FROM pt) SELECT doi, round(margin, 6) AS margin, round(cut, 6) AS cut, round(middle, 6) AS middle FROM pt, c WHERE margin < cut")
def _(spark, d):
    return rounded(op.low_tail(_points(spark, d), "margin").select("doi", "margin", "cut", "middle"), 6, "margin", "cut", "middle")


_KEYED = "a AS (SELECT '10.' || (doi_ % 7) || '/X' || doi_ AS doi, source FROM (SELECT o_orderkey AS doi_, o_orderstatus AS source FROM orders)), r AS (SELECT '10.' || (l_orderkey % 7) || '/x' || l_orderkey AS doi, CASE WHEN l_suppkey % 2 = 0 THEN 'crossref' ELSE 'openalex' END AS reference_source FROM lineitem WHERE l_quantity > 40)"


def _keyed(spark, d):
    """Works with text keys, and references that write them in lower case."""
    name = lambda c, mark: F.concat(F.lit("10."), (F.col(c) % 7).cast("string"), F.lit(mark), F.col(c).cast("string"))
    works = table(spark, d, "orders").select(name("o_orderkey", "/X").alias("doi"), F.col("o_orderstatus").alias("source"))
    return works, table(spark, d, "lineitem").where("l_quantity > 40").select(name("l_orderkey", "/x").alias("doi"), F.when(F.col("l_suppkey") % 2 == 0, "crossref").otherwise("openalex").alias("reference_source"))


@query("reference_coverage", f"WITH {_KEYED} SELECT source, count(*) AS works, count(*) FILTER (lower(doi) IN (SELECT doi FROM r)) AS listed, round(avg(CASE WHEN lower(doi) IN (SELECT doi FROM r) THEN 1.0 ELSE 0.0 END), 9) AS share FROM a GROUP BY 1")
def _(spark, d):
    return rounded(op.reference_coverage(*_keyed(spark, d)), 9, "share")


@query("prefix_coverage", f"WITH {_KEYED}, m AS (SELECT DISTINCT lower(doi) AS k FROM a WHERE lower(doi) LIKE '10.3/%'), f AS (SELECT doi AS k, min(reference_source) AS reference_source FROM r GROUP BY 1) SELECT reference_source, count(*) AS works FROM m JOIN f USING (k) GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM m")
def _(spark, d):
    return op.prefix_coverage(*_keyed(spark, d), "10.3/")


@query("duplicate_queue", "WITH p AS (SELECT l_orderkey AS a, l_partkey AS b, round(max(l_discount), 4) AS similarity FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2), t AS (SELECT p_partkey AS k, min(p_name) AS t FROM part WHERE p_partkey % 5 > 0 GROUP BY 1) SELECT a, b, x.t AS title_a, y.t AS title_b, similarity FROM p LEFT JOIN t x ON x.k = a LEFT JOIN t y ON y.k = b")
def _(spark, d):
    pairs = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max("l_discount").alias("similarity"))
    names = table(spark, d, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("doi"), F.col("p_name").alias("title"))
    return op.duplicate_queue(pairs, names)


@query("missing_keys", "SELECT DISTINCT l_orderkey AS doi FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return op.missing_keys(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doi")), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doi")))
