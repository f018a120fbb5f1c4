"""Queries of operators/statistics.py and operators/forecasting.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import forecasting as fc
from quarryleaf.operators import regression
from quarryleaf.operators import statistics as op
from quarryleaf.plans.adapters import ARTICLES, articles, keyword_rows, table
from quarryleaf.plans.text import rounded
from quarryleaf.registry import query

_METRICS = {"citation_count": "log1p", "reference_count": "identity"}
_B = f"{ARTICLES}, b AS (SELECT source = 'F' AS g, 'citation_count' AS metric, 'log1p' AS transform, ln(1 + citation_count) AS v FROM articles WHERE citation_count >= 0 UNION ALL SELECT source = 'F', 'reference_count', 'identity', reference_count FROM articles WHERE reference_count >= 0)"


def biased(spark, d):
    return articles(spark, d).withColumn("has_pdf", F.col("source") == "F")


@query("selection_bias", f"""WITH {_B}, s AS (SELECT metric, transform, count(*) FILTER (g) AS n_1, count(*) FILTER (NOT g) AS n_0, avg(v) FILTER (g) AS mean_1, avg(v) FILTER (NOT g) AS mean_0, var_samp(v) FILTER (g) AS v1, var_samp(v) FILTER (NOT g) AS v0 FROM b GROUP BY 1, 2)
SELECT metric, transform, n_1, n_0, round(mean_1, 6) AS mean_1, round(mean_0, 6) AS mean_0, round((mean_1 - mean_0) / sqrt(((n_1 - 1) * v1 + (n_0 - 1) * v0) / (n_1 + n_0 - 2)), 6) AS smd, 'ok' AS status FROM s""")
def _(spark, d):
    return rounded(op.mean_difference(biased(spark, d), "has_pdf", _METRICS), 6, "mean_1", "mean_0", "smd")


@query("selection_bias_interval")
def _(spark, d):
    """A bootstrap; checked in tests against the closed form it brackets."""
    return op.mean_difference_interval(biased(spark, d), "has_pdf", _METRICS)


_SERIES = "y AS (SELECT c_mktsegment AS k, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def yearly(spark, d):
    return articles(spark, d).groupBy(F.col("venue").alias("k"), "year").agg(F.count("*").alias("n"))


@query("yearly_grid", "WITH y AS (SELECT p_brand AS k, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) <> 1998 GROUP BY 1, 2), g AS (SELECT k, unnest(range(lo, hi + 1)) AS year FROM (SELECT k, min(year) AS lo, max(year) AS hi FROM y GROUP BY 1)) SELECT g.k, CAST(g.year AS INT) AS year, coalesce(n, 0) AS n FROM g LEFT JOIN y ON y.k = g.k AND y.year = g.year")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where(F.year("l_shipdate") != 1998)
    return op.yearly_grid(rows.groupBy(F.col("p_brand").alias("k"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n")), ["k"], "year", "n")


@query("linear_slopes", f"WITH {_SERIES} SELECT k, count(*) AS n, round(regr_slope(n, year), 6) AS slope, round(regr_intercept(n, year), 3) AS intercept, round(regr_r2(n, year), 6) AS r2 FROM y GROUP BY 1")
def _(spark, d):
    return rounded(rounded(op.slopes(yearly(spark, d), "k", "year", "n"), 6, "slope", "r2"), 3, "intercept")


# Student's 97.5 % quantiles of 1 to 12 degrees of freedom.
_STUDENT = "[12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469118, 2.3646243, 2.3060041, 2.2621572, 2.2281389, 2.2009852, 2.1788128]"


@query("slope_intervals", f"""WITH {_SERIES}, s AS (SELECT k, count(*) AS n, regr_slope(n, year) AS slope, regr_sxx(n, year) AS sxx, regr_syy(n, year) AS syy, regr_sxy(n, year) AS sxy FROM y GROUP BY 1),
e AS (SELECT k, slope, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS se, ({_STUDENT})[n - 2] AS q FROM s)
SELECT k, round(slope, 5) AS slope, round(se, 5) AS stderr, round(slope - q * se, 4) AS low, round(slope + q * se, 4) AS high FROM e""")
def _(spark, d):
    out = rounded(op.slope_intervals(yearly(spark, d), "k", "year", "n"), 5, "slope", "stderr")
    return rounded(out, 4, "low", "high").drop("p")


@query("slope_tests")
def _(spark, d):
    """Student's distribution is no SQL function; checked in tests against known values."""
    return op.slope_intervals(yearly(spark, d), "k", "year", "n").select("k", "p")


@query("mann_kendall", f"WITH {_SERIES}, p AS (SELECT a.k, sign(b.n - a.n) AS s, (b.n - a.n) / (b.year - a.year) AS m FROM y a JOIN y b ON a.k = b.k AND a.year < b.year) SELECT k, (SELECT CAST(count(*) AS INT) FROM y WHERE y.k = p.k) AS n, CAST(sum(s) AS DOUBLE) AS s, round(quantile_cont(m, 0.5), 6) AS sen_slope FROM p GROUP BY 1")
def _(spark, d):
    return rounded(op.mann_kendall(yearly(spark, d), "k", "year", "n"), 6, "sen_slope")


@query("trend_tests")
def _(spark, d):
    return op.trends(yearly(spark, d), "k", "year", "n")


@query("adjusted_p_values", "WITH p AS (SELECT p_partkey AS k, (p_partkey * 7919 % 1000) / 1000.0 * (p_size / 50.0) AS p FROM part), r AS (SELECT k, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw, row_number() OVER (ORDER BY p, k) AS i FROM p) SELECT k, round(least(min(raw) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS p_adjusted FROM r")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 7919 % 1000) / 1000.0 * (F.col("p_size") / 50.0)).alias("p"))
    return rounded(op.adjusted_p(p, "p").select("k", "p_adjusted"), 9, "p_adjusted")



_BREAK = """s AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS t, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT k, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS m, sum(n) OVER w AS s, sum(n * n) OVER w AS q, sum(n) OVER (PARTITION BY k) AS ts, sum(n * n) OVER (PARTITION BY k) AS tq FROM s WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)),
r AS (SELECT k, m, i, round((q - s * s / i) + (tq - q) - (ts - s) * (ts - s) / (m - i), 9) AS rss, round(tq - ts * ts / m, 9) AS tss FROM c WHERE m >= 6 AND i >= 2 AND m - i >= 3)"""


@query("break_points", f"WITH {_BREAK}, b AS (SELECT k, any_value(m) AS m, any_value(tss) AS tss, arg_min(i, (rss, i)) AS i, min(rss) AS rss FROM r GROUP BY 1) SELECT k, CAST(i AS INT) AS k2, round((tss - rss) / (rss / (m - 2)), 5) AS f FROM b WHERE rss > 0 AND tss > rss")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("t")).agg(F.count("*").alias("n"))
    return op.best_break(s, "key", "t", "n").select(F.col("key").alias("k"), F.col("k").alias("k2"), F.round("f", 5).alias("f"))


@query("structural_breaks")
def _(spark, d):
    """Permutation p-values; checked in tests for false positives and a planted shift."""
    return op.structural_breaks(yearly(spark, d), "k", "year", "n")


@query("heavy_tails")
def _(spark, d):
    return op.heavy_tails(articles(spark, d), "citation_count")


@query("citation_determinants")
def _(spark, d):
    rows = articles(spark, d).select(F.floor(F.coalesce("citation_count", F.lit(0)) / 10).alias("y"), (2002 - F.col("year")).alias("age"), (F.col("reference_count") % 4).alias("refs"), (F.col("source") == "F").cast("int").alias("is_f"))
    return op.citation_determinants(rows, "y", ["refs", "is_f"], "age")


@query("bibliometric_anomalies")
def _(spark, d):
    return op.anomalies(articles(spark, d), "doi", ["year", "citation_count", "reference_count"])


@query("anomaly_reasons")
def _(spark, d):
    rows = articles(spark, d).withColumn("margin", (F.col("doi") % 100) / 100.0)
    return op.anomaly_reasons(rows, op.anomalies(rows, "doi", ["year", "citation_count", "reference_count", "margin"]), "doi", "citation_count", "reference_count", "year", "margin")


_L = "l AS (SELECT doc_id, quality = 1 AS truth, (doc_id * 7919 % 1000) / 1000.0 - 0.3 + 0.3 * quality AS score FROM labels)"
_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2, round((tn + fn) / (tp + fp + tn + fn), 6) AS workload_reduction"
_NAMES = ("precision", "recall", "specificity", "f1", "f2", "workload_reduction")


def scored_labels(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "labels").select(i, (F.col("quality") == 1).alias("truth"), ((i * 7919 % 1000) / 1000.0 - 0.3 + 0.3 * F.col("quality")).alias("score"))


@query("threshold_metrics", f"WITH {_L}, s AS (SELECT count(*) FILTER (score >= 0.3 AND truth) AS tp, count(*) FILTER (score >= 0.3 AND NOT truth) AS fp, count(*) FILTER (score < 0.3 AND truth) AS fn, count(*) FILTER (score < 0.3 AND NOT truth) AS tn FROM l) SELECT *, {_RATES} FROM s")
def _(spark, d):
    return rounded(op.threshold_metrics(scored_labels(spark, d), "truth", "score", 0.3), 6, *_NAMES)


_CURVE = f"{_L}, c AS (SELECT round(score, 9) AS threshold, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM l GROUP BY 1), s AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () - sum(p) OVER w AS BIGINT) AS fn, CAST(sum(n) OVER () - sum(n) OVER w AS BIGINT) AS tn FROM c WINDOW w AS (ORDER BY threshold DESC))"


def curve(spark, d):
    rows = scored_labels(spark, d).withColumn("score", F.round("score", 9))
    return rounded(op.threshold_curve(rows, "truth", "score"), 6, *_NAMES)


@query("threshold_curve", f"WITH {_CURVE} SELECT *, {_RATES} FROM s")
def _(spark, d):
    return curve(spark, d)


@query("best_threshold", f"WITH {_CURVE}, r AS (SELECT *, {_RATES} FROM s) SELECT * FROM r WHERE recall >= 0.98 ORDER BY specificity DESC, precision DESC, threshold LIMIT 1")
def _(spark, d):
    return op.best_threshold(curve(spark, d))


@query("calibrated_threshold")
def _(spark, d):
    return op.calibrated_threshold(scored_labels(spark, d), "doc_id", "truth", "score", least_recall=0.9)


@query("reviewer_kappa", "WITH s AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS a, avg(quality) AS p, avg(toxic) AS q FROM labels) SELECT n, round(a, 6) AS agreement, round((a - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 6) AS kappa FROM s")
def _(spark, d):
    return rounded(op.kappa(table(spark, d, "labels"), "quality", "toxic"), 6, "agreement", "kappa")


@query("volume_forecasts")
def _(spark, d):
    """Model choice by rolling errors; checked in tests on exact lines and growth curves."""
    return fc.forecasts(yearly(spark, d), "k", "year", "n", 1995, 2000, [2001, 2002], [1999, 2000])


@query("bass_diffusion")
def _(spark, d):
    """A non-linear fit; checked in tests on curves of known parameters."""
    return fc.bass_fits(yearly(spark, d), "k", "year", "n")


def count_rows(spark, d):
    """Counts with an age and two features."""
    return articles(spark, d).select(F.floor(F.coalesce("citation_count", F.lit(0)) / 10).alias("y"), (2002 - F.col("year")).alias("age"), (F.col("reference_count") % 4).alias("refs"), (F.col("source") == "F").cast("int").alias("is_f"))


@query("count_regression_fit")
def _(spark, d):
    """Rounds of sums; checked in tests against a fit of all rows in one place."""
    out = regression.pseudo_r_squared(count_rows(spark, d), "y", ["refs", "is_f"], F.ln(F.greatest("age", F.lit(1)) + 1))
    return rounded(out, 5, "deviance", "null_deviance", "pseudo_r2")


@query("age_sensitivity")
def _(spark, d):
    """Three fits with other exposures; checked in tests against fits in one place."""
    return rounded(regression.age_sensitivity(count_rows(spark, d), "y", ["refs", "is_f"], "age"), 5, "aic", "coefficient", "p")


@query("signs_agree", "WITH s AS (SELECT l_returnflag AS spec, p_brand AS f, corr(l_quantity, l_discount) AS c FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 2 = 0 GROUP BY 1, 2) SELECT (SELECT max(n) FROM (SELECT count(DISTINCT sign(c)) AS n FROM s WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY f)) <= 1 OR (SELECT count(DISTINCT spec) FROM s) < 2 AS agree")
def _(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_partkey % 2 = 0"), F.col("l_partkey") == F.col("p_partkey"))
    return regression.signs_agree(lines.groupBy(F.col("l_returnflag").alias("specification"), F.col("p_brand").alias("feature")).agg(F.corr("l_quantity", "l_discount").alias("coefficient")))


@query("keyword_forecasts")
def _(spark, d):
    """Chosen models of short series; checked in tests of the forecasts."""
    return rounded(fc.keyword_forecasts(keyword_rows(spark, d), 20, 1995, 2000, [2001, 2002], [1999, 2000]), 4, "forecast", "variation")


@query("bass_sums", """WITH y AS (SELECT l_partkey % 5 AS k, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT k, CAST(sum(n) OVER (PARTITION BY k ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS x, n AS y FROM y)
SELECT k, round(sum(1.0), 3) AS s0, round(sum(x), 3) AS s1, round(sum(x * x) / 1e6, 3) AS s2, round(sum(y), 3) AS t0, round(sum(x * y) / 1e6, 3) AS t1 FROM s WHERE x IS NOT NULL GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 5).alias("k"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    s = fc.bass_sums(rows, "k", "year", "n")
    return s.select("k", *(F.round(c, 3).alias(c) for c in ("s0", "s1")), F.round(F.col("s2") / 1e6, 3).alias("s2"), F.round("t0", 3).alias("t0"), F.round(F.col("t1") / 1e6, 3).alias("t1"))
