"""Queries of operators/citations.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import citations as op
from quarryleaf.operators.counts import explode_values
from quarryleaf.plans.adapters import ARTICLES, AUTHORS, articles, author_rows, table
from quarryleaf.plans.text import rounded
from quarryleaf.plans.windows import _REFS, _refs
from quarryleaf.registry import query


def _ids(df, column, where, name="work_id"):
    return df.where(where).select(F.col(column).alias(name)).distinct()


@query("citation_graph_coverage", """WITH w AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30), f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.04), t AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax > 0.07),
x AS (SELECT k IN (SELECT k FROM b) AS b, k IN (SELECT k FROM f) AS f, k IN (SELECT k FROM t) AS t FROM w) SELECT count(*) AS works, count(*) FILTER (b) AS backward, count(*) FILTER (f) AS forward, count(*) FILTER (t) AS truncated, count(*) FILTER (b AND f AND NOT t) AS usable, round(count(*) FILTER (b AND f AND NOT t) / count(*), 9) AS usable_share FROM x""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    out = op.graph_coverage(table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id")), *(_ids(lines, "l_orderkey", c) for c in ("l_quantity > 30", "l_discount > 0.04", "l_tax > 0.07")))
    return rounded(out, 9, "usable_share")


@query("contradicted_zeros", f"WITH {ARTICLES} SELECT doi FROM articles WHERE coalesce(citation_count, 0) < 30 AND (doi IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) OR doi % 10 = 3)")
def _(spark, d):
    a, orders = articles(spark, d), table(spark, d, "orders")
    n = lambda df, c: df.where(c).select(F.col(df.columns[0]).alias("doi"), F.lit(1).alias("n"))
    return op.contradicted_zeros(a.where("coalesce(citation_count, 0) < 30").select("doi"), n(orders, "o_totalprice > 200000"), n(a, "doi % 10 = 3"))


@query("trajectory_population", """WITH w AS (SELECT c_custkey AS k, CAST(1993 + c_custkey % 6 AS INT) AS y FROM customer), s AS (SELECT o_custkey AS k, min(year(o_orderdate)) AS y FROM orders GROUP BY 1), x AS (SELECT k, y, k IN (SELECT k FROM s) AS s, k % 3 = 0 AS z, k % 9 = 0 AS c FROM w),
r AS (SELECT k, s OR (z AND NOT c) AS known, (s OR (z AND NOT c)) AND y < (SELECT min(y) FROM s) AS cens FROM x) SELECT known, cens AS left_censored, known AND NOT cens AS complete, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    k = F.col("c_custkey")
    works = table(spark, d, "customer").select(k.alias("work_id"), (1993 + k % 6).cast("int").alias("year"))
    series = table(spark, d, "orders").select(F.col("o_custkey").alias("work_id"), F.year("o_orderdate").alias("year"))
    out = op.trajectory_population(works, series, works.where("work_id % 3 = 0"), works.where("work_id % 9 = 0"))
    return out.groupBy("known", "left_censored", "complete").agg(F.count("*").alias("n"))


@query("citation_year_coverage", """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 35), y AS (SELECT p_partkey AS w, CASE WHEN p_size % 7 <> 0 THEN 1960 + p_size END AS y FROM part), o AS (SELECT p_partkey AS w, CASE WHEN p_size % 5 <> 0 THEN 1960 + p_size + p_partkey % 4 - 1 END AS y FROM part),
p AS (SELECT x.y AS cy, z.y AS dy FROM e LEFT JOIN y x ON x.w = a LEFT JOIN y z ON z.w = b) SELECT count(*) AS pairs, count(*) FILTER (cy IS NOT NULL AND dy IS NOT NULL) AS dated, count(*) FILTER (dy <= cy + 1) AS consistent,
(SELECT count(*) FROM y JOIN o USING (w) WHERE y.y IS NOT NULL AND o.y IS NOT NULL) AS compared, (SELECT count(*) FROM y JOIN o USING (w) WHERE abs(y.y - o.y) <= 1) AS agreeing FROM p""")
def _(spark, d):
    part, s, k = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    edges = table(spark, d, "lineitem").where("l_quantity > 35").select(F.col("l_suppkey").alias("citing"), F.col("l_partkey").alias("cited"))
    return op.citation_years(edges, part.select(k.alias("work_id"), F.when(s % 7 != 0, 1960 + s).alias("year")), part.select(k.alias("work_id"), F.when(s % 5 != 0, 1960 + s + k % 4 - 1).alias("year")))


@query("reference_year_coverage", f"WITH {_REFS}, w AS (SELECT doi, count(*) AS n, count(reference_year) AS d, count(*) FILTER (reference_year <= year + 1) AS ok FROM refs GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS \"references\", CAST(sum(d) AS BIGINT) AS dated, count(*) AS works, count(*) FILTER (d >= 0.8 * n) AS well_dated, CAST(sum(ok) AS BIGINT) AS consistent FROM w")
def _(spark, d):
    return op.reference_years(_refs(spark, d))


@query("access_agreement", "WITH l AS (SELECT user_id AS k, bool_or(event_type = 'purchase' AND value > 80) AS o FROM events GROUP BY 1), s AS (SELECT user_id AS k, arg_max(value > 25, (ts, event_id)) AS v FROM events GROUP BY 1) SELECT count(*) AS works, count(*) FILTER (o) AS licensed_open, count(*) FILTER (v) AS seen_open, count(*) FILTER (o = v) AS agree FROM l JOIN s USING (k)")
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "doi")
    licences = e.groupBy("doi").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 80)).alias("is_open"))
    return op.access_agreement(licences, e.select("doi", F.struct("ts", "event_id").alias("observed_at"), (F.col("value") > 25).alias("is_open")))


@query("price_index_interval")
def _(spark, d):
    """A bootstrap; its interval is checked in tests to hold the closed form."""
    return op.price_interval(_refs(spark, d), draws=200)


_TIERS = "t AS (SELECT p_brand AS venue, min(CASE p_size % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'A3' WHEN 2 THEN 'B2' END) AS tier FROM part WHERE p_size < 6 AND p_size % 4 <> 3 GROUP BY 1)"


@query("tier_volume_by_year", f"WITH {_TIERS} SELECT CAST(year(l_shipdate) AS INT) AS year, tier, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN t ON venue = p_brand WHERE tier IN ('A1', 'A3') GROUP BY 1, 2")
def _(spark, d):
    part, s = table(spark, d, "part"), F.col("p_size")
    tiers = part.where("p_size < 6").select(F.col("p_brand").alias("venue"), F.when(s % 4 == 0, "A1").when(s % 4 == 1, "A3").when(s % 4 == 2, "B2").otherwise("none").alias("tier"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("venue"), F.year("l_shipdate").alias("year"))
    return op.tier_volume(op.with_tier(lines, tiers), ["A1", "A3"])


_KW = "v AS (SELECT lower(trim(u)) AS value, CAST(2000 + doc_id % 25 AS INT) AS year FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS u FROM documents) WHERE trim(u) <> ''), c AS (SELECT value, year, count(*) AS c FROM v GROUP BY 1, 2), t AS (SELECT year, sum(c) AS t FROM c GROUP BY 1), k AS (SELECT value FROM c GROUP BY 1 HAVING sum(c) >= 20), g AS (SELECT k.value, t.year, coalesce(c.c, 0) / t.t AS share FROM k CROSS JOIN t LEFT JOIN c ON c.value = k.value AND c.year = t.year)"


@query("keyword_share_trend", f"WITH {_KW} SELECT value, (SELECT CAST(sum(c) AS BIGINT) FROM c WHERE c.value = g.value) AS n, round(regr_slope(share, year), 7) AS slope FROM g GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select((2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.split("text", "[ \n]", -1).alias("k"))
    return rounded(op.keyword_share_trend(explode_values(docs, "k", ["year"])), 7, "slope")


@query("cognitive_distance", f"""WITH {AUTHORS}, a AS (SELECT DISTINCT doi, author, citation_count, CAST(doi % 97 AS DOUBLE) AS x, CAST(doi % 89 AS DOUBLE) AS y FROM author_rows), c AS (SELECT author, avg(x) AS ax, avg(y) AS ay FROM a GROUP BY 1), n AS (SELECT doi, author, citation_count, ax, ay FROM a JOIN c USING (author)),
p AS (SELECT q.doi, round(avg(sqrt(pow(q.ax - r.ax, 2) + pow(q.ay - r.ay, 2))), 9) AS x, any_value(q.citation_count) AS y FROM n q JOIN n r ON q.doi = r.doi AND q.author < r.author GROUP BY 1), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM k""")
def _(spark, d):
    points = articles(spark, d).select("doi", (F.col("doi") % 97).cast("double").alias("x"), (F.col("doi") % 89).cast("double").alias("y"))
    return rounded(op.cognitive_distance(author_rows(spark, d), points, "citation_count"), 5, "pearson", "spearman")


@query("first_titles", "SELECT source, string_agg(title, ' | ' ORDER BY doc_id) AS titles FROM (SELECT source, doc_id, md5(text) AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id, md5(text)) AS r FROM documents) WHERE r <= 3 GROUP BY 1")
def _(spark, d):
    return op.first_titles(table(spark, d, "documents").withColumn("title", F.md5(F.col("text").cast("binary"))), "source", "title", "doc_id")


@query("screening_report", "WITH m AS (SELECT doc_id, round((doc_id * 7919 % 1000) / 1000.0 - 0.5, 6) AS margin, n_chars > 500 AS a FROM documents) SELECT doc_id, margin, (SELECT round(quantile_cont(margin, 0.5), 9) FROM m WHERE a) AS median, (SELECT count(*) FROM m WHERE margin < 0) AS below FROM m ORDER BY abs(margin), doc_id LIMIT 25")
def _(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i, F.round((i * 7919 % 1000) / 1000.0 - 0.5, 6).alias("margin"), "n_chars")
    return rounded(op.screening_report(rows, "margin", F.col("n_chars") > 500, "doc_id"), 9, "median")


@query("batch_answers", "SELECT p_partkey AS doi, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'success' ELSE 'not_found' END AS status FROM part")
def _(spark, d):
    found = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("doi")).distinct()
    return op.requested(table(spark, d, "part").select(F.col("p_partkey").alias("doi")), found)


@query("key_batches", "SELECT count(*) AS keys, true AS bounded FROM part")
def _(spark, d):
    got = op.batches_of(table(spark, d, "part").select(F.col("p_partkey").alias("doi")), "doi", 50)
    return got.agg(F.sum(F.size("keys")).alias("keys"), (F.max(F.size("keys")) <= 50).alias("bounded"))
