"""Operators that SQL cannot express, against plain versions or known answers."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryleaf.operators import authors, forecasting, graphs, joins, statistics, text, vectors


def test_chunks():
    assert text.chunk("") == [] and text.chunk("short") == ["short"]
    body = "\n\n".join("Sentence one is here. Sentence two follows it. " * 12 for _ in range(6))
    parts = text.chunk(body, 700, 100)
    assert all(0 < len(p) <= 700 for p in parts) and all(p in body for p in parts)
    assert text.chunk("x" * 3000, 1500, 200) == ["x" * 1500, "x" * 1500, "x" * 400]
    assert text.chunk("a" * 900 + "\n\n" + "b" * 900)[0] == "a" * 900


def test_burst_path_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(20):
        totals = rng.integers(20, 60, 7)
        hits = np.minimum(rng.integers(0, 12, 7), totals)
        path, base, high = text.burst_states(hits, totals)
        up = math.log(max(int(totals.sum()), 2))

        def cost(states):
            c = sum(text.binomial_cost(hits[t : t + 1], totals[t : t + 1], high if s else base)[0] for t, s in enumerate(states))
            return c + up * sum(s and not before for before, s in zip((0, *states), states, strict=False))

        assert math.isclose(cost(path.tolist()), min(cost(s) for s in itertools.product((0, 1), repeat=7)), rel_tol=1e-9)


def test_bursts_rows(spark):
    rows = [("A", 2000 + i, h, 100) for i, h in enumerate([1, 1, 1, 30, 40, 35, 1, 1])] + [("B", 2000 + i, 0, 100) for i in range(8)]
    got = text.bursts(spark.createDataFrame(rows, "class string, year int, hits long, total long")).collect()
    assert [(r.concept, r.first, r.peak, r["last"], r.years, r.active, r.articles) for r in got] == [("A", 2003, 2004, 2005, 3, False, 105)]


def test_theme_labels(spark):
    rows = [(i, "a" if i % 2 else "b", ("solar panel yield study" if i % 2 else "wind turbine blade study") + f" w{i} common") for i in range(40)]
    got = {r.theme: r.label for r in text.theme_labels(spark.createDataFrame(rows, "id long, t string, x string"), "t", "id", "x", terms=2).collect()}
    assert "Study" not in str(got) and set(got) == {"a", "b"} and any(w in got["a"] for w in ("Solar", "Panel", "Yield")) and any(w in got["b"] for w in ("Wind", "Turbine", "Blade"))


def test_token_sort_ratio():
    assert joins.indel_ratio("abc", "abc") == 100 and joins.indel_ratio("", "x") == 0 and joins.indel_ratio("", "") == 100

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(1, 12))) for _ in range(2))
        assert math.isclose(joins.indel_ratio(a, b), 200 * lcs(a, b) / (len(a) + len(b)))


def test_best_matches(spark):
    q = spark.createDataFrame([("Energy Journal of Systems",), ("Nothing alike",), ("IEEE Trans Power",), (None,)], "q string")
    n = spark.createDataFrame([("Journal of Energy Systems",), ("IEEE Trans. Power.",), ("Other",)], "n string")
    got = {r.query: (r.name, r.score) for r in joins.best_matches(q, n, "q", "n").collect()}
    assert got["Energy Journal of Systems"] == ("Journal of Energy Systems", 100.0) and got["Nothing alike"] == (None, None) and got["IEEE Trans Power"][0] == "IEEE Trans. Power."


def test_distributions():
    assert math.isclose(statistics.student_tail(2.228, 10), 0.05, abs_tol=1e-4) and math.isclose(statistics.student_quantile(0.95, 10), 2.228, abs_tol=1e-3)
    assert math.isclose(statistics.f_tail(4.964603, 1, 10), 0.05, abs_tol=1e-4) and math.isclose(statistics.normal_tail(1.959964), 0.025, abs_tol=1e-6)


def test_trends(spark):
    rows = [("up", i, float(i)) for i in range(12)] + [("flat", i, 5.0) for i in range(12)] + [("short", i, float(i)) for i in range(3)] + [("down", i, -2.0 * i) for i in range(12)]
    frame = spark.createDataFrame(rows, "k string, x int, y double")
    got = {r.k: r for r in statistics.trends(frame, "k", "x", "y").collect()}
    assert {k: r.trend for k, r in got.items()} == {"up": "growing", "flat": "stable", "short": "stable", "down": "falling"}
    assert got["up"].s == 66 and got["down"].slope == -2
    ci = {r.k: r for r in statistics.slope_intervals(frame, "k", "x", "y").collect()}
    assert ci["up"].slope == pytest.approx(1) and ci["up"].p == pytest.approx(0) and ci["flat"].p == 1


def test_structural_break(spark):
    rng = np.random.default_rng(3)
    rows = [("shift", 2000 + i, float(v)) for i, v in enumerate(np.concatenate([rng.normal(5, 1, 12), rng.normal(15, 1, 12)]))] + [("tiny", 2000 + i, 1.0) for i in range(4)]
    got = {r.k: r for r in statistics.structural_breaks(spark.createDataFrame(rows, "k string, x int, y double"), "k", "x", "y").collect()}
    assert got["shift"].has_break and got["shift"].break_at == 2012 and not got["tiny"].has_break
    noise = [statistics.max_shift(rng.normal(0, 1, 20))[0] for _ in range(200)]
    assert np.mean([statistics.f_tail(f, 1, 18) < 0.05 for f in noise]) > 0.1  # why the searched break needs permutations


def test_bootstrap_brackets_the_effect(spark):
    rng = np.random.default_rng(4)
    rows = [(bool(i % 2), float(rng.poisson(9 if i % 2 else 6))) for i in range(400)] + [(None, None), (True, -1.0)]
    frame = spark.createDataFrame(rows, "g boolean, v double")
    point = statistics.mean_difference(frame, "g", {"v": "log1p"}).first()
    ci = statistics.mean_difference_interval(frame, "g", {"v": "log1p"}, 300).first()
    assert (point.n_1, point.n_0, point.status) == (200, 200, "ok") and ci.ci_low < point.smd < ci.ci_high and ci.ci_low > 0.3


def test_heavy_tail():
    rng = np.random.default_rng(5)
    fits = {r["model"]: r for r in statistics.fit_tail(2 * (1 - rng.random(3000)) ** (-1 / 1.5), 20)}
    assert fits["power_law"]["best"] and fits["power_law"]["a"] == pytest.approx(2.5, abs=0.15) and fits["power_law"]["p"] > 0.05
    assert {r["model"]: r for r in statistics.fit_tail(rng.exponential(4, 2000) + 1, 5)}["exponential"]["best"]
    assert statistics.fit_tail(np.arange(5.0), 5) == []


def test_count_models(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=1500)
    y = rng.poisson(np.exp(0.5 + 0.8 * x))
    beta, _ = statistics.fit_counts(y.astype(float), np.column_stack([np.ones(1500), x]), np.zeros(1500))
    assert beta == pytest.approx([0.5, 0.8], abs=0.06)
    zeros = np.where(rng.random(1500) < 0.4, 0, y).astype(float)
    fits = statistics.count_families(zeros, np.column_stack([np.ones(1500), x]), np.zeros(1500))
    assert min(fits, key=lambda f: fits[f]["aic"]).startswith("zero_inflated") and fits["zero_inflated_poisson"]["pi"] == pytest.approx(0.4, abs=0.06)
    frame = spark.createDataFrame(pd.DataFrame({"y": y, "a": 1.0, "x": x}))
    got = {(r.family, r.feature): r for r in statistics.citation_determinants(frame, "y", ["x"], "a").collect()}
    assert got["poisson", "x"].low < math.exp(0.8 * x.std()) < got["poisson", "x"].high


def test_anomalies(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))] + [(1000 + i, 30.0 + i, -30.0) for i in range(5)]
    got = statistics.anomalies(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], 0.02).collect()
    assert {r.id for r in got if r.is_anomaly} >= set(range(1000, 1005)) and sum(r.is_anomaly for r in got) < 25


def test_calibration(spark):
    rows = [(i, i % 3 == 0, (1.0 if i % 3 == 0 else 0.0) + (i % 7) / 10) for i in range(300)]
    got = {r.metric: r for r in statistics.calibrated_threshold(spark.createDataFrame(rows, "k long, t boolean, s double"), "k", "t", "s").collect()}
    assert got["recall"].value == 1 and got["specificity"].value == 1 and 0.6 < got["threshold"].value <= 1.0
    assert statistics.calibrated_threshold(spark.createDataFrame(rows[:30], "k long, t boolean, s double"), "k", "t", "s").count() == 0


def test_forecasts():
    years = np.arange(2000, 2016)
    rows = forecasting.forecast_series(years, 10 + 3.0 * (years - 2000), 2015, [2016, 2017], list(range(2009, 2016)), 2000)
    assert [r["model"] for r in rows] == ["linear"] * 2 and [r["value"] for r in rows] == pytest.approx([58, 61]) and rows[0]["low"] == pytest.approx(58)
    grown = forecasting.forecast_series(years, np.expm1(0.3 * (years - 1999)), 2015, [2016], list(range(2009, 2016)), 2000)
    assert grown[0]["model"] == "log_linear" and grown[0]["skill"] > 0.9
    assert forecasting.forecast_series(years[:3], np.ones(3), 2015, [2016], [2002], 2000) == []


def test_bass():
    t = np.arange(20, dtype=float)
    total = forecasting.cumulative_bass(t, 0.02, 0.4, 1000)
    (p, q, m), _ = forecasting.bass_by_curve(np.diff(total, prepend=0))
    assert (p, q, m) == pytest.approx((0.02, 0.4, 1000), rel=0.02)
    fit = forecasting.bass(2000 + t, np.diff(total, prepend=0))
    assert fit["valid"] and fit["peak"] == pytest.approx(2000 + math.log(20) / 0.42, abs=0.2) and not forecasting.bass(t[:3], t[:3])["valid"]


@pytest.fixture
def two_cliques(spark):
    e = [(a, b, 2) for g in (0, 10) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(0, 10, 1)]
    return spark.createDataFrame(e, "a long, b long, weight long")


def test_graph_measures(spark, two_cliques):
    found = {r.node: r.community for r in graphs.communities(two_cliques).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(10, 15)}) == 1 and found[0] != found[10]
    c = {r.node: r for r in graphs.centralities(two_cliques).collect()}
    assert c[0].betweenness == pytest.approx(20 / 36) and c[1].betweenness == 0 and c[0].closeness > c[1].closeness
    rank = {r.node: r["rank"] for r in graphs.pagerank(two_cliques, 60).collect()}
    nodes = sorted(rank)
    w = np.zeros((10, 10))
    for r in two_cliques.collect():
        i, j = nodes.index(r.a), nodes.index(r.b)
        w[i, j] = w[j, i] = r.weight
    p, v = w / w.sum(1, keepdims=True), np.full(10, 0.1)
    for _ in range(200):
        v = 0.015 + 0.85 * v @ p
    assert [rank[n] for n in nodes] == pytest.approx(v.tolist(), abs=1e-6)
    report = {r.measure: r.value for r in graphs.graph_report(two_cliques, simulations=10).collect()}
    assert report["clustering"] > 0.8 and report["giant_without_hubs"] <= 0.6 and 0 < report["clustering_p"] <= 1
    assert graphs.components(two_cliques).where("component <> 0").count() == 0


def test_small_graph_limit(spark, two_cliques):
    with pytest.raises(Exception, match="edges"):
        graphs.centralities(two_cliques, most_edges=3).count()


def test_projection_and_themes(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(4) * 5
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.2, 4)).tolist(), i % 4) for i in range(80)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, truth int")
    got = vectors.themes(frame, "v", 4, seed=3)
    assert vectors.adjusted_rand(got, "theme", "truth").first()["ari"] == pytest.approx(1)
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = np.linalg.svd(m - m.mean(0), full_matrices=False)
    mine = np.array([r.reduced for r in vectors.reduced(frame, "v", 2).orderBy("id").collect()])
    assert np.abs(mine) == pytest.approx(np.abs((want[0] * want[1])[:, :2]), abs=1e-6)
    sweep = vectors.theme_sweep(frame, "v", range(3, 6))
    assert vectors.best_k(sweep) == 4 and vectors.best_k([]) == 4


def test_vectors_from_bytes(spark):
    rows = [(1, np.array([1.5, -2], "<f4").tobytes()), (2, b"abc"), (3, None)]
    got = {r.id: r.embedding for r in vectors.parsed_vectors(spark.createDataFrame(rows, "id long, raw binary"), "raw").collect()}
    assert got == {1: [1.5, -2.0], 2: None, 3: None}


def test_lotka(spark):
    rows = [(k,) for level, count in ((1, 64), (2, 16), (4, 4), (8, 1)) for k in [level] * count]
    got = authors.lotka(spark.createDataFrame(rows, "n long")).first()
    assert got.alpha == pytest.approx(2) and got.c == pytest.approx(64) and got.r2 == pytest.approx(1)


def test_distributed_regression(spark):
    """Rounds of sums give the coefficients of a fit in one place, and known deviances."""
    from quarryleaf.operators import regression

    rng = np.random.default_rng(11)
    x, age = rng.normal(size=1200), rng.integers(1, 20, 1200)
    y = rng.poisson(np.exp(0.4 + 0.6 * x) * (age + 1)).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "age": age.astype(float)})).unionByName(spark.createDataFrame([(None, 1.0, 1.0)], "y double, x double, age double"))
    offset = F.ln(F.col("age") + 1)
    for alpha, family in ((0.0, "poisson"), (0.3, "nb")):
        fit = regression.count_regression(frame, "y", ["x"], offset, alpha)
        beta, mu = statistics.fit_counts(y, np.column_stack([np.ones(1200), x]), np.log(age + 1), family, alpha)
        assert fit.beta == pytest.approx(beta, abs=1e-6) and fit.rows == 1200
        assert fit.log_likelihood == pytest.approx(float(statistics._log_count(y, mu, alpha).sum()), rel=1e-8)
        assert 0 < fit.pseudo_r_squared() < 1 and fit.errors[1] > 0
        safe = np.where(y > 0, y, 1)
        part = np.where(y > 0, y * np.log(safe / mu), 0)
        want = 2 * (part - (y - mu)) if alpha == 0 else 2 * (part - (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu)))
        assert fit.deviance == pytest.approx(float(want.sum()), rel=1e-8)
    rows = regression.age_sensitivity(frame, "y", ["x"], "age").collect()
    assert [r.specification for r in rows] == list(regression.AGES) and all(abs(r.coefficient - 0.6) < 0.05 and r.p < 1e-6 for r in rows)
    assert regression.signs_agree(regression.age_sensitivity(frame, "y", ["x"], "age")).first().agree
    flipped = spark.createDataFrame([("a", "x", 1.0), ("b", "x", -1.0), ("b", "z", float("nan"))], "specification string, feature string, coefficient double")
    assert not regression.signs_agree(flipped).first().agree and regression.signs_agree(flipped.where("specification = 'a'")).first().agree
    assert regression.count_regression(frame.limit(2), "y", ["x"]) is None and regression.pseudo_r_squared(frame.limit(0), "y", ["x"]).first().pseudo_r2 is None


def test_weighted_fits_equal_repeated_rows():
    rng = np.random.default_rng(12)
    values = np.floor(2 * (1 - rng.random(400)) ** (-1 / 1.5))
    v, n = np.unique(values, return_counts=True)
    assert statistics.fit_tail(values, 10) == statistics.fit_tail(v, 10, counts=n)
    y, x = rng.poisson(2, 300).astype(float), rng.integers(0, 3, 300).astype(float)
    cells, n = np.unique(np.column_stack([y, x]), axis=0, return_counts=True)
    one = statistics.count_families(y, np.column_stack([np.ones(300), x]), np.zeros(300))
    two = statistics.count_families(cells[:, 0], np.column_stack([np.ones(len(cells)), cells[:, 1]]), np.zeros(len(cells)), n)
    for f in one:
        assert one[f]["aic"] == pytest.approx(two[f]["aic"], rel=1e-6) and one[f]["beta"] == pytest.approx(two[f]["beta"], abs=1e-5)


def test_running_totals(spark):
    from quarryleaf.operators.running import running_totals

    rng = np.random.default_rng(13)
    rows = [(int(k), int(v)) for k, v in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    got = {r.k: (r.up, r.place) for r in running_totals(spark.createDataFrame(rows, "k int, v int").repartition(7), [F.desc("k")], {"up": F.col("v"), "place": F.lit(1)}).collect()}
    total = 0
    for place, (k, v) in enumerate(sorted(rows, reverse=True), 1):
        total += v
        assert got[k] == (total, place)


def test_bass_from_sums(spark):
    from quarryleaf.operators import forecasting

    t = np.arange(20)
    counts = np.diff(forecasting.cumulative_bass(np.append(t, 20).astype(float), 0.02, 0.4, 900.0))
    one = forecasting.bass_by_differences(counts)
    s = forecasting.bass_sums(spark.createDataFrame([("a", int(2000 + i), float(c)) for i, c in enumerate(counts)], "k string, y int, n double"), "k", "y", "n").first()
    two = forecasting.bass_of_sums([s[f"s{k}"] for k in range(5)], [s[f"t{k}"] for k in range(3)])
    assert all(one[k] == pytest.approx(two[k], rel=1e-6) for k in "pqm") and one["m"] == pytest.approx(900, rel=0.05)
    assert forecasting.bass_by_differences(np.array([1.0, 2, 4, 8, 16])) is None


def test_serial_correction_against_a_loop():
    rng = np.random.default_rng(14)
    for _ in range(20):
        y = np.cumsum(rng.normal(size=14)) + rng.integers(0, 3, 14)
        slope = statistics.trend_test(y)["slope"]
        ranks = pd.Series(y - slope * np.arange(14)).rank().to_numpy()
        ranks = ranks - ranks.mean()
        extra = 0.0
        for lag in range(1, 12):
            r = (ranks[:-lag] * ranks[lag:]).sum() / (ranks**2).sum()
            if abs(r + 1 / (14 - lag)) > 1.96 * math.sqrt(13 - lag) / (14 - lag):
                extra += (14 - lag) * (13 - lag) * (12 - lag) * r
        factor = 1 + 2 * extra / (14 * 13 * 12)
        assert statistics.variance_inflation(y, slope) == pytest.approx(factor if factor > 0 else 1.0)


def test_passages_are_found_as_written(spark):
    docs = spark.createDataFrame([(1, "xThat one, two three four five six seven. End"), (2, "That one two three"), (3, None), (4, "say a b now"), (5, "That one, two three four five six sevens")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "That one, two three four five six seven"), (2, "a b"), (3, ""), (4, None), (5, "one, two three four five six seven")], "query_id long, query string")
    want = {(r.query_id, r.doc_id) for r in docs.join(asked, F.contains("text", "query")).where("query <> ''").collect()}
    assert {(r.query_id, r.doc_id) for r in text.containing(docs, asked).collect()} == want and len(want) == 5


def test_chunks_of_the_rule():
    """Worked by hand: trimmed first; a cut lies one behind the start of a blank line."""
    body = "  " + "a" * 900 + "\n\n" + "b" * 900 + "  "
    assert text.chunk(body) == ["a" * 900, "a" * 199 + "\n\n" + "b" * 900]
    assert text.chunk("x" * 1490 + ". " + "y" * 100)[0] == "x" * 1490 + "." and text.chunk(" \n ") == []
