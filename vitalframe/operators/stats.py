"""Descriptive and inferential statistics as aggregates. Empty groups and undefined values give null."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.exprs import col, safe_div
from vitalframe.functions.shared import discard, written

Z95 = 1.959963984540054


def describe(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, exact median, sample and population deviation."""
    return frame.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"),
    )


def exact_sum(value) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(col(value).cast("decimal(38,12)"))


def welch(frame: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row: t and Welch-Satterthwaite df of two groups. Equal variances of 0: t = 0, df infinite."""
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    one = frame.agg(*[side(g, f).alias(f"{k}_{n}") for g, n in ((a, "a"), (b, "b")) for f, k in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    sa, sb = safe_div("v_a", "n_a"), safe_div("v_b", "n_b")
    t = F.when(sa + sb == 0, F.lit(0.0)).otherwise(safe_div(F.col("m_a") - F.col("m_b"), F.sqrt(sa + sb)))
    df = safe_div((sa + sb) * (sa + sb), safe_div(sa * sa, F.col("n_a") - 1) + safe_div(sb * sb, F.col("n_b") - 1), math.inf)
    return one.select(t.alias("t"), df.alias("df"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, for the one row that welch() gives."""
    if math.isinf(df):
        return 2 * (1 - NormalDist().cdf(abs(t)))
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def bin_counts(frame: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n): half-open bins, the last closed; rows outside are left out, empty bins are 0."""
    bins = len(edges) - 1
    c = F.col(value)
    place = sum(((c >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    found = frame.filter((c >= edges[0]) & (c <= edges[-1])).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def with_totals(frame: DataFrame, totals: dict[str, Column], *by: str) -> DataFrame:
    """frame with aggregates of the whole (one row, broadcast) or of each key joined on; no window pulls all rows into one task."""
    found = frame.groupBy(*by).agg(*[v.alias(k) for k, v in totals.items()])
    return frame.join(found, list(by)) if by else frame.crossJoin(F.broadcast(found))


def min_max(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Add `scaled`: (x - min) / (max - min), 0 for a range of 0."""
    wide = with_totals(frame, {"_lo": F.min(value), "_hi": F.max(value)}, *by)
    return wide.withColumn("scaled", safe_div(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"), 0.0)).drop("_lo", "_hi")


def standardize(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Add `z` by the population deviation, 0 where that is 0."""
    wide = with_totals(frame, {"_m": F.avg(value), "_s": F.stddev_pop(value)}, *by)
    return wide.withColumn("z", safe_div(F.col(value) - F.col("_m"), "_s", 0.0)).drop("_m", "_s")


def scaler(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, mean, sd): what standardize() uses, to be kept for other rows; sd is 1 where the values do not vary."""
    sd = F.stddev_pop(value)
    return frame.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def scaled(x, mean, sd) -> Column:
    return (col(x) - col(mean)) / col(sd)


def unscaled(z, mean, sd) -> Column:
    """The inverse of scaled()."""
    return col(z) * col(sd) + col(mean)


def linear_fit(frame: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    return frame.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def logistic_fit(frame: DataFrame, y: str, x: str, rate: float, steps: int) -> tuple[float, float]:
    """(slope, intercept) after `steps` of full-batch gradient descent from 0 over rows counted by (x, y) once: one aggregate job a step, nothing but two sums reaches the driver."""
    rows = written(frame.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    slope = intercept = 0.0
    for _ in range(steps):
        miss = 1 / (1 + F.exp(-(F.col("x") * slope + intercept))) - F.col("y")
        gx, g, n = rows.agg(F.sum(miss * F.col("x") * F.col("n")), F.sum(miss * F.col("n")), F.sum("n")).first()
        if not n:
            break
        slope, intercept = slope - rate * gx / n, intercept - rate * g / n
    discard(rows)
    return slope, intercept


def linear_predict(x, slope, intercept) -> Column:
    return col(x) * slope + intercept


def logistic_probability(x, slope, intercept) -> Column:
    """1 / (1 + exp(-(slope x + intercept))); the predicted class is whether it reaches 0.5."""
    return 1 / (1 + F.exp(-linear_predict(x, slope, intercept)))


def meta_fixed(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """One row: inverse-variance pooled effect, its error and 95 % bounds, Q and I2 in percent."""
    w, y = 1 / F.col(variance), F.col(effect)
    one = studies.filter(F.col(variance) > 0).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.count(F.lit(1)).alias("k"))
    pooled, se = safe_div("wy", "w"), F.sqrt(safe_div(F.lit(1.0), "w"))
    q = F.greatest(F.col("wyy") - safe_div(F.col("wy") * F.col("wy"), "w"), F.lit(0.0))
    return one.select(
        pooled.alias("pooled"), se.alias("se"), (pooled - Z95 * se).alias("low"), (pooled + Z95 * se).alias("high"), q.alias("q"),
        F.when(q > 0, F.greatest(safe_div(q - (F.col("k") - 1), q), F.lit(0.0)) * 100).otherwise(0.0).alias("i2"),
    )


def meta_random(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """One row: DerSimonian-Laird tau2 and the effect pooled with it. Two aggregates, the first broadcast as one row."""
    rows = studies.filter(F.col(variance) > 0)
    w, y = 1 / F.col(variance), F.col(effect)
    one = rows.agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.count(F.lit(1)).alias("k"))
    q = F.col("wyy") - safe_div(F.col("wy") * F.col("wy"), "w")
    tau2 = one.select(F.coalesce(F.greatest(safe_div(q - (F.col("k") - 1), F.col("w") - safe_div("ww", "w")), F.lit(0.0)), F.lit(0.0)).alias("tau2"))
    w2 = 1 / (F.col(variance) + F.col("tau2"))
    two = rows.crossJoin(F.broadcast(tau2)).agg(F.first("tau2").alias("tau2"), F.sum(w2).alias("w"), F.sum(w2 * y).alias("wy"))
    pooled, se = safe_div("wy", "w"), F.sqrt(safe_div(F.lit(1.0), "w"))
    return two.select("tau2", pooled.alias("pooled"), se.alias("se"), (pooled - Z95 * se).alias("low"), (pooled + Z95 * se).alias("high"))


def age_standardized_rate(rate, weight) -> Column:
    """Aggregate: sum of rate * weight over the sum of weights."""
    return safe_div(F.sum(col(rate) * col(weight)), F.sum(weight))


def power_two_sample(effect: float, n: int, alpha: float) -> float:
    """Power of a two-sided test with n rows a group, by the normal approximation; 0 for invalid input."""
    if n < 2 or not 0 < alpha < 1:
        return 0.0
    norm = NormalDist()
    z, shift = norm.inv_cdf(1 - alpha / 2), abs(effect) * math.sqrt(n / 2)
    return norm.cdf(shift - z) + norm.cdf(-shift - z)


def sample_size_two_sample(effect: float, power: float, alpha: float) -> int:
    """Least rows a group (2 to 100000) that reach the power; 0 for none or invalid input."""
    if not effect or not 0 < power < 1 or not 0 < alpha < 1 or power_two_sample(effect, 100_000, alpha) < power:
        return 0
    low, high = 2, 100_000
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if power_two_sample(effect, mid, alpha) >= power else (mid + 1, high)
    return low


def sample_size_proportion(p1: float, p2: float, power: float, alpha: float) -> int:
    """Rows a group to tell two shares apart; 0 for invalid input."""
    if not (0 < p1 < 1 and 0 < p2 < 1 and p1 != p2 and 0 < power < 1 and 0 < alpha < 1):
        return 0
    za, zb, mean = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power), (p1 + p2) / 2
    top = za * math.sqrt(2 * mean * (1 - mean)) + zb * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return math.ceil(top * top / (p1 - p2) ** 2)
