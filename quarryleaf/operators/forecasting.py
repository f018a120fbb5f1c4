"""Forecasts of short yearly series, one group to a task: parsimonious models chosen by rolling-origin errors, with
conformal bands, and Bass diffusion."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODELS = ("baseline", "linear", "log_linear")


def predictor(kind: str, years: np.ndarray, values: np.ndarray):
    """A fitted model as a function of years: the last value, a line, or a line through log1p."""
    if kind == "baseline":
        last = float(values[-1])
        return lambda at: np.full(len(np.atleast_1d(at)), last)
    y = np.log1p(values) if kind == "log_linear" else values.astype(float)
    x = years - years.mean()
    power = float((x**2).sum())
    slope = float((x * (y - y.mean())).sum() / power) if power else 0.0
    line = lambda at: y.mean() + slope * (np.atleast_1d(at) - years.mean())
    return (lambda at: np.expm1(line(at))) if kind == "log_linear" else line


def rolling_errors(years: np.ndarray, values: np.ndarray, test_years: list[int], horizon: int = 1) -> dict[str, float]:
    """Mean absolute error of each model over the test years, each trained on years up to test - horizon (three or
    more); nan where no test year has enough."""
    out = {}
    for kind in MODELS:
        errors = []
        for t in test_years:
            known = years <= t - horizon
            if known.sum() >= 3 and t in years:
                errors.append(abs(float(values[years == t][0]) - float(predictor(kind, years[known], values[known])(t)[0])))
        out[kind] = float(np.mean(errors)) if errors else math.nan
    return out


def one_step_errors(kind: str, years: np.ndarray, values: np.ndarray, horizon: int = 1) -> np.ndarray:
    at = range(3 + horizon - 1, len(years))
    return np.array([abs(float(values[i]) - float(predictor(kind, years[: i - horizon + 1], values[: i - horizon + 1])(years[i])[0])) for i in at])


def held_out_coverage(kind: str, years: np.ndarray, values: np.ndarray, held: int = 5, horizon: int = 1) -> float | None:
    """The share of the last `held` errors within the 0.9 quantile (an observed error, rounded up) of those before."""
    e = one_step_errors(kind, years, values, horizon)
    if len(e) < held + 3:
        return None
    return float(np.mean(e[-held:] <= np.quantile(e[:-held], 0.9, method="higher")))


def forecast_series(years: np.ndarray, values: np.ndarray, train_end: int, ahead: list[int], test_years: list[int], train_start: int) -> list[dict]:
    """A row for each forecast year: model, value, low, high, cv_mae, skill, mase, coverage, horizon errors. Models are
    compared by rolling errors on complete years; bands are the one-step conformal radius times the root of the step."""
    keep = (years >= train_start) & (years <= train_end)
    x, y = years[keep], values[keep].astype(float)
    if len(x) < 4:
        return []
    cv = rolling_errors(x, y, test_years)
    ranked = [k for k in MODELS if math.isfinite(cv[k])]
    kind = min(ranked, key=lambda k: cv[k]) if ranked else "baseline"
    fit = predictor(kind, x, y)
    errors = one_step_errors(kind, x, y)
    radius = float(np.quantile(errors, 0.9, method="higher")) if len(errors) else float(np.abs(y - fit(x)).max())
    naive = float(np.abs(np.diff(y)).mean())
    rows = []
    for step, year in enumerate(ahead, start=1):
        at = rolling_errors(x, y, test_years, step)
        value = max(float(fit(year)[0]), 0.0)
        margin = radius * math.sqrt(step)
        finite = lambda v: float(v) if math.isfinite(v) else None
        rows.append({
            "year": int(year), "model": kind, "value": value, "low": max(value - margin, 0.0), "high": value + margin, "cv_mae": finite(cv[kind]),
            "skill": finite(1 - at[kind] / at["baseline"]) if at["baseline"] > 0 else None, "mase": finite(at[kind] / naive) if naive > 0 else None,
            "coverage": held_out_coverage(kind, x, y, horizon=step)})
    return rows


def forecasts(series: DataFrame, by: str, year: str, value: str, train_start: int, train_end: int, ahead: list[int], test_years: list[int]) -> DataFrame:
    """`forecast_series` of every group; its yearly values are first filled from first to last year."""
    from quarryleaf.operators.statistics import yearly_grid

    kind = series.schema[by].dataType.simpleString()
    names = ["year", "model", "value", "low", "high", "cv_mae", "skill", "mase", "coverage"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(year)
        rows = forecast_series(pdf[year].to_numpy(), pdf[value].to_numpy(), train_end, ahead, test_years, train_start)
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, by, key[0])
        return out

    return yearly_grid(series.where(F.col(year).isNotNull()), [by], year, value).groupBy(by).applyInPandas(
        run, f"{by} {kind}, year int, model string, value double, low double, high double, cv_mae double, skill double, mase double, coverage double")


def keyword_forecasts(keyword_years: DataFrame, least: int, train_start: int, train_end: int, ahead: list[int], test_years: list[int]) -> DataFrame:
    """(keyword, observed, forecast, variation, model) of keywords with `least` mentions: the last complete year's count
    (else the first known), the last forecast year's value, and their difference. keyword_years: value, year, a row each
    mention."""
    counts = keyword_years.where("value is not null and year is not null").groupBy("value", "year").agg(F.count("*").alias("n"))
    eligible = counts.groupBy(F.col("value").alias("keyword")).agg(F.sum("n").alias("_n"), F.coalesce(F.max(F.when(F.col("year") == train_end, F.col("n"))), F.min_by("n", "year")).cast("double").alias("observed")).where(F.col("_n") >= least)
    series = counts.withColumnRenamed("value", "keyword").join(eligible.select("keyword"), "keyword", "left_semi")
    last = forecasts(series, "keyword", "year", "n", train_start, train_end, ahead, test_years).where(F.col("year") == max(ahead))
    both = last.select("keyword", F.col("value").alias("forecast"), "model")
    return eligible.drop("_n").join(both, "keyword").select("keyword", "observed", "forecast", (F.col("forecast") - F.col("observed")).alias("variation"), "model")


def cumulative_bass(t: np.ndarray, p: float, q: float, m: float) -> np.ndarray:
    e = np.exp(-(p + q) * t)
    return m * (1 - e) / (1 + q / p * e)


def bass_sums(rows: DataFrame, by: str, year: str, value: str) -> DataFrame:
    """(by, s0, ..., s4, t0, t1, t2): of each group, over its years after the first, the sums of the powers of what was
    adopted before, and of these times the year's adoptions."""
    before = Window.partitionBy(by).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.select(by, F.sum(value).over(before).cast("double").alias("x"), F.col(value).cast("double").alias("y")).where("x is not null")
    power = lambda k: F.pow("x", F.lit(float(k)))
    return steps.groupBy(by).agg(*(F.sum(power(k)).alias(f"s{k}") for k in range(5)), *(F.sum(power(k) * F.col("y")).alias(f"t{k}") for k in range(3)))


def bass_of_sums(s: Sequence[float], t: Sequence[float]) -> dict | None:
    """p, q, m of the quadratic of yearly adoptions in cumulative ones, from its normal equations: the market is where
    adoptions come back to zero. None where the parabola has no such root."""
    scale = math.sqrt(s[2] / s[0]) if s[0] and s[2] else 1.0
    normal = np.array([[s[i + j] / scale ** (i + j) for j in range(3)] for i in range(3)])
    start, linear, bend = np.linalg.lstsq(normal, np.array([t[i] / scale**i for i in range(3)]), rcond=None)[0] / scale ** np.arange(3)
    inside = linear**2 - 4 * bend * start
    if bend >= 0 or inside <= 0:
        return None
    market = (linear + math.sqrt(inside)) / (-2 * bend)
    p, q = start / market, -bend * market
    return {"p": float(p), "q": float(q), "m": float(market), "method": "ols"} if p > 0 and q > 0 else None


def bass_by_differences(counts: np.ndarray) -> dict | None:
    """The same of one series."""
    before = np.cumsum(counts)[:-1].astype(float)
    powers = before[None, :] ** np.arange(5)[:, None]
    return bass_of_sums(powers.sum(axis=1), powers[:3] @ counts[1:].astype(float))


def bass_by_curve(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """p, q, m within bounds by damped least squares on the cumulative curve, and their covariance."""
    t, y = np.arange(len(counts), dtype=float), np.cumsum(counts).astype(float)
    low, high = np.array([1e-5, 1e-5, y[-1]]), np.array([0.5, 1.5, y[-1] * 20])
    theta, damp = np.clip(np.array([0.03, 0.38, max(y[-1] * 1.3, 10)]), low, high), 1e-2
    scale = np.array([0.03, 0.38, max(y[-1], 1.0)])

    def jacobian(v: np.ndarray) -> np.ndarray:
        h = 1e-6 * scale
        return np.column_stack([(cumulative_bass(t, *(v + h * e)) - cumulative_bass(t, *(v - h * e))) / (2 * h[i]) for i, e in enumerate(np.eye(3))])

    cost = float(((y - cumulative_bass(t, *theta)) ** 2).sum())
    for _ in range(500):
        r, j = y - cumulative_bass(t, *theta), jacobian(theta) * scale
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ r) * scale
        new = np.clip(theta + step, low, high)
        new_cost = float(((y - cumulative_bass(t, *new)) ** 2).sum())
        if new_cost < cost:
            done = cost - new_cost < 1e-10 * max(cost, 1e-12)
            theta, cost, damp = new, new_cost, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    j = jacobian(theta)
    return theta, np.linalg.pinv(j.T @ j) * cost / max(len(counts) - 3, 1)


def bass(years: np.ndarray, counts: np.ndarray, draws: int = 500, seed: int = 0) -> dict:
    """valid, m, p, q, peak, peak_low, peak_high (80 % of draws from the fitted covariance), stage, method."""
    none = {"valid": False, "m": 0.0, "p": 0.0, "q": 0.0, "peak": None, "peak_low": None, "peak_high": None, "stage": None, "method": "none"}
    if len(counts) < 5 or counts.sum() <= 0:
        return none
    first, last = float(years[0]), float(years[-1])
    peak_of = lambda p, q: first + (math.log(q / p) / (p + q) if p < q else 0.0)
    low = high = None
    try:
        (p, q, m), cov = bass_by_curve(counts)
        method = "nls"
        drawn = np.random.default_rng(seed).multivariate_normal([p, q, m], cov, draws, method="eigh")
        peaks = [peak_of(a, b) for a, b, _ in drawn if a > 0 and b > 0]
        if len(peaks) >= draws // 2:
            low, high = (float(v) for v in np.quantile(peaks, [0.1, 0.9]))
    except (np.linalg.LinAlgError, FloatingPointError, ValueError):
        fit = bass_by_differences(counts)
        if fit is None:
            return {**none, "m": float(counts.sum() * 1.5), "p": 0.03, "q": 0.38, "method": "fallback"}
        p, q, m, method = fit["p"], fit["q"], fit["m"], "ols"
    peak = peak_of(p, q)
    return {"valid": True, "m": float(m), "p": float(p), "q": float(q), "peak": peak, "peak_low": low, "peak_high": high, "stage": "growth" if peak > last else "maturity", "method": method}


def bass_fits(series: DataFrame, by: str, year: str, value: str) -> DataFrame:
    kind = series.schema[by].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(year)
        return pd.DataFrame([{by: key[0], **bass(pdf[year].to_numpy(), pdf[value].to_numpy())}])

    return series.groupBy(by).applyInPandas(run, f"{by} {kind}, valid boolean, m double, p double, q double, peak double, peak_low double, peak_high double, stage string, method string")
