"""Count regressions over any number of rows: each round is one aggregate of sums, and the driver solves a small system.

Poisson and negative binomial (given dispersion) with log link and offset; robust errors from a second aggregate that
weighs each row's score by its leverage. What is collected has the size of the features squared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryleaf.operators.statistics import normal_tail

AGES = ("offset_log_age", "covariate_log_age", "covariate_linear_age")


@dataclass
class Fit:
    """Coefficients in the order of `names` (the intercept first), their robust errors, and what the fit comes to."""

    names: list[str]
    beta: np.ndarray
    errors: np.ndarray
    rows: int
    deviance: float
    null_deviance: float
    log_likelihood: float
    null_log_likelihood: float
    pearson: float

    @property
    def aic(self) -> float:
        return 2 * len(self.names) - 2 * self.log_likelihood

    def p_values(self) -> np.ndarray:
        return np.array([2 * normal_tail(abs(b) / e) if e > 0 else 1.0 for b, e in zip(self.beta, self.errors, strict=True)])

    def pseudo_r_squared(self) -> float | None:
        """Share of the null deviance explained, or, without one, of the null log likelihood (McFadden)."""
        if self.null_deviance > 0:
            return 1 - self.deviance / self.null_deviance
        return 1 - self.log_likelihood / self.null_log_likelihood if self.null_log_likelihood else None


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by Stirling's series after seven steps of its recurrence."""
    y = x + 7
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    return series - F.ln(product)


def log_density(y: Column, mu: Column, alpha: float) -> Column:
    if alpha <= 0:
        return y * F.ln(mu) - mu - log_gamma(y + 1)
    r = 1 / alpha
    return log_gamma(y + r) - log_gamma(y + 1) - math.lgamma(r) + r * F.ln(r / (r + mu)) + y * F.ln(mu / (mu + r))


def unit_deviance(y: Column, mu: Column, alpha: float) -> Column:
    part = F.when(y > 0, y * F.ln(y / mu)).otherwise(0.0)
    if alpha <= 0:
        return 2 * (part - (y - mu))
    return 2 * (part - (y + 1 / alpha) * F.ln((1 + alpha * y) / (1 + alpha * mu)))


def count_regression(df: DataFrame, response: str, features: Sequence[str], offset: Column | None = None, alpha: float = 0.0, rounds: int = 50, tolerance: float = 1e-9) -> Fit | None:
    """A fit over the rows without nulls; None for fewer than one row more than coefficients, or without any count."""
    names = ["intercept", *features]
    base = df.select(F.col(response).cast("double").alias("_y"), (F.lit(0.0) if offset is None else offset.cast("double")).alias("_o"), *(F.col(f).cast("double").alias(f) for f in features)).dropna()
    x = [F.lit(1.0), *(F.col(f) for f in features)]
    k = len(names)
    first = base.agg(F.count("*").alias("n"), F.sum("_y").alias("y"), F.sum(F.exp("_o")).alias("o")).first()
    if first.n <= k or not first.y:
        return None
    variance = lambda mu: 1 + alpha * mu if alpha > 0 else F.lit(1.0)
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def mean_of(beta: np.ndarray) -> Column:
        eta = F.col("_o")
        for b, c in zip(beta.tolist(), x, strict=True):
            eta = eta + F.lit(b) * c
        return F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)))

    def solved(columns: list[Column], beta: np.ndarray, steps: int) -> np.ndarray:
        width = len(columns)
        for _ in range(steps):
            mu = mean_of(beta)
            w = mu / variance(mu)
            z = w * (F.ln(mu) - F.col("_o") + (F.col("_y") - mu) / mu)
            pairs = [(i, j) for i in range(width) for j in range(i, width)]
            got = base.agg(*(F.sum(w * columns[i] * columns[j]) for i, j in pairs), *(F.sum(z * c) for c in columns)).first()
            h = np.zeros((width, width))
            for (i, j), v in zip(pairs, got, strict=False):
                h[i, j] = h[j, i] = v
            new = np.zeros(k)
            new[:width] = np.linalg.lstsq(h, np.array(got[len(pairs) :], dtype=float), rcond=None)[0]
            if np.abs(new - beta).max() < tolerance:
                return new
            beta = new
        return beta

    start = np.zeros(k)
    start[0] = math.log(first.y / first.o)
    null = mean_of(solved(x[:1], start, rounds))
    beta = solved(x, start, rounds)
    mu = mean_of(beta)
    w = mu / variance(mu)
    y = F.col("_y")
    got = base.agg(
        *(F.sum(w * x[i] * x[j]) for i, j in cells), F.sum(unit_deviance(y, mu, alpha)), F.sum(unit_deviance(y, null, alpha)), F.sum(log_density(y, mu, alpha)), F.sum(log_density(y, null, alpha)),
        F.sum((y - mu) * (y - mu) / (mu * variance(mu)))).first()
    h = np.zeros((k, k))
    for (i, j), v in zip(cells, got, strict=False):
        h[i, j] = h[j, i] = v
    bread = np.linalg.pinv(h)
    leverage = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            leverage = leverage + F.lit(float(bread[i, j])) * x[i] * x[j]
    leverage = F.least(F.greatest(w * leverage, F.lit(0.0)), F.lit(0.999))
    score = (y - mu) / variance(mu) / (1 - leverage)
    square = score * score
    meat = np.zeros((k, k))
    for (i, j), v in zip(cells, base.agg(*(F.sum(square * x[i] * x[j]) for i, j in cells)).first(), strict=True):
        meat[i, j] = meat[j, i] = v
    d = got[len(cells) :]
    return Fit(names, beta, np.sqrt(np.clip(np.diag(bread @ meat @ bread), 0, None)), first.n, d[0], d[1], d[2], d[3], d[4])


def dispersion(df: DataFrame, fit: Fit) -> float:
    """The moment estimate of a negative binomial's dispersion from a Poisson fit: Pearson's sum over the free rows, less 1."""
    return max(fit.pearson / max(fit.rows - len(fit.names), 1) - 1, 0.01)


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation; zeros where that is zero."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    unit = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.join(F.broadcast(stats)).select(*unit)  # one row


def age_sensitivity(df: DataFrame, response: str, features: Sequence[str], age: str, alpha: float = 0.0) -> DataFrame:
    """(specification, aic, feature, coefficient, p): the fit with ln(max(age, 1) + 1) as an offset of fixed slope, and with
    ln age or age itself, standardised, as a covariate whose slope the data choose."""
    log_age = F.ln(F.greatest(F.col(age), F.lit(1)) + 1)
    rows = []
    for name in AGES:
        if name == AGES[0]:
            fit = count_regression(df, response, features, log_age, alpha)
        else:
            term = log_age if name == AGES[1] else F.col(age).cast("double")
            with_age = standardised(df.withColumn("_age_term", term), ["_age_term"])
            fit = count_regression(with_age, response, [*features, "_age_term"], None, alpha)
        if fit:
            p = dict(zip(fit.names, fit.p_values(), strict=True))
            rows += [(name, fit.aic, f, float(b), float(p[f])) for f, b in zip(fit.names, fit.beta, strict=True) if f in features]
    return df.sparkSession.createDataFrame(rows, "specification string, aic double, feature string, coefficient double, p double")


def signs_agree(specifications: DataFrame) -> DataFrame:
    """One row: whether every feature keeps its sign over all specifications; true below two of them. Coefficients that
    are not finite don't count."""
    known = specifications.where(F.col("coefficient").isNotNull() & ~F.isnan("coefficient"))
    per = known.groupBy("feature").agg(F.count_distinct(F.signum("coefficient")).alias("signs"))
    n = specifications.agg(F.count_distinct("specification").alias("n"))
    return per.agg(F.coalesce(F.bool_and(F.col("signs") <= 1), F.lit(True)).alias("same")).join(F.broadcast(n)).select((F.col("same") | (F.col("n") < 2)).alias("agree"))  # one row


def pseudo_r_squared(df: DataFrame, response: str, features: Sequence[str], offset: Column | None = None, alpha: float = 0.0) -> DataFrame:
    """One row: rows, deviance, null deviance, pseudo_r2 (null without a fit)."""
    fit = count_regression(df, response, features, offset, alpha)
    row = (fit.rows, float(fit.deviance), float(fit.null_deviance), fit.pseudo_r_squared()) if fit else (0, None, None, None)
    return df.sparkSession.createDataFrame([row], "rows long, deviance double, null_deviance double, pseudo_r2 double")
