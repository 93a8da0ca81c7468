"""Survival analysis. Rows are counted by distinct time, times are cut into buckets, and windows run inside a bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.exprs import finite, safe_div
from vitalframe.functions.shared import discard, written


#: Buckets of distinct times, cut at quantiles.
BUCKETS = 64


def _by_time(frame: DataFrame, time: str, counts: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    return frame.filter(finite(F.col(time).cast("double"))).groupBy(*by, F.col(time).cast("double").alias("time")).agg(*[c.alias(k) for k, c in counts.items()])


def _edges(times: DataFrame, column: str = "time") -> list[float]:
    """At most BUCKETS - 1 times that cut all of them into buckets of about the same size."""
    found = times.approxQuantile(column, [i / BUCKETS for i in range(1, BUCKETS)], 0.005)
    return sorted(set(found))


def _at(edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= F.col("time")))


def _bucketed(counted: DataFrame, edges: list[float]) -> DataFrame:
    return counted.withColumn("bucket", _at(F.array(*map(F.lit, edges))) if edges else F.lit(0))


def _bucketed_at_once(counted: DataFrame) -> DataFrame:
    """The same in one plan: the edges are one row, which every task gets."""
    marks = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    edges = counted.agg(F.array_distinct(F.percentile_approx("time", marks, F.lit(1000))).alias("_edges"))
    return counted.crossJoin(F.broadcast(edges)).withColumn("bucket", F.coalesce(_at(F.col("_edges")), F.lit(0))).drop("_edges")


def _running(rows: DataFrame, by: tuple[str, ...], column: str, name: str, of=F.sum, later: bool = False, own: bool = True, start: float = 0.0) -> DataFrame:
    """rows (by, bucket, time, ...) with a running sum or product of a column over the times up to a row's (or from it on, with `later`); own: its own value counts.

    A window holds one bucket of a group; what other buckets add comes from one row a bucket.
    """
    step = (lambda a, b: a * b) if of is F.product else (lambda a, b: a + b)
    order = (lambda c: F.col(c).desc()) if later else F.col
    sizes = rows.groupBy(*by, "bucket").agg(of(column).alias("_one"))
    over = Window.partitionBy(*by).orderBy(order("bucket")) if by else Window.orderBy(order("bucket"))
    before = sizes.withColumn("_before", of("_one").over(over.rowsBetween(Window.unboundedPreceding, -1))).select(*by, "bucket", "_before")
    inside = of(column).over(Window.partitionBy(*by, "bucket").orderBy(order("time")).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    out = rows.withColumn("_inside", inside).join(before, [*by, "bucket"])
    return out.withColumn(name, step(F.coalesce("_before", F.lit(start)), F.coalesce("_inside", F.lit(start)))).drop("_before", "_inside")


def _at_risk(frame: DataFrame, time: str, counts: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    counted = _by_time(frame, time, counts, by)
    return _running(_bucketed_at_once(counted), by, "c", "at_risk", later=True).withColumn("at_risk", F.col("at_risk").cast("long"))


def kaplan_meier(frame: DataFrame, time: str, event: Column, *by: str) -> DataFrame:
    """(by, time, at_risk, events, survival) for every distinct time, censored ones too. Null and NaN times are left out."""
    risk = _at_risk(frame, time, {"c": F.count(F.lit(1)), "events": F.sum(event.cast("long"))}, by)
    risk = risk.withColumn("_step", F.greatest(1 - safe_div("events", "at_risk"), F.lit(0.0)))
    return _running(risk, by, "_step", "survival", F.product, start=1.0).select(*by, "time", "at_risk", "events", "survival")


def log_rank(frame: DataFrame, time: str, event: Column, group: str, a, b) -> DataFrame:
    """One row: the chi-square statistic of two groups; 0 without variance."""
    first = (F.col(group) == a).cast("long")
    died = event.cast("long")
    risk = _at_risk(frame.filter(F.col(group).isin(a, b)), time, {"c": F.count(F.lit(1)), "c1": F.sum(first), "d": F.sum(died), "d1": F.sum(died * first)}, ())
    risk = _running(risk, (), "c1", "n1", later=True).filter("d > 0").withColumns({"n": F.col("at_risk").cast("double"), "n1": F.col("n1").cast("double")})
    share = F.col("n1") / F.col("n")
    variance = F.col("d") * (F.col("n") - F.col("d")) * share * (1 - share) / F.greatest(F.col("n") - 1, F.lit(1.0))
    one = risk.agg(F.sum(F.col("d1") - F.col("d") * share).alias("gap"), F.sum(variance).alias("v"))
    return one.select(F.coalesce(safe_div(F.col("gap") * F.col("gap"), F.when(F.col("v") > 0, F.col("v"))), F.lit(0.0)).alias("chi2"))


def competing_risks(frame: DataFrame, time: str, cause: str, causes: list[int], *by: str) -> DataFrame:
    """(by, time, at_risk, survival, cif_<cause>...): Aalen-Johansen cumulative incidence at every distinct time; cause 0 is censored."""
    counts = {"c": F.count(F.lit(1)), "d": F.sum((F.col(cause) != 0).cast("long"))} | {f"d_{k}": F.sum((F.col(cause) == k).cast("long")) for k in causes}
    risk = _at_risk(frame, time, counts, by).withColumn("_step", F.greatest(1 - safe_div("d", "at_risk"), F.lit(0.0)))
    risk = _running(risk, by, "_step", "_s", F.product, own=False, start=1.0).withColumn("survival", F.col("_s") * F.col("_step"))
    for k in causes:
        risk = _running(risk.withColumn("_x", F.col("_s") * safe_div(f"d_{k}", "at_risk")), by, "_x", f"cif_{k}")
    return risk.select(*by, "time", "at_risk", "survival", *[f"cif_{k}" for k in causes])


def _cells(frame: DataFrame, time: str, event: Column, covariates: list[str]) -> tuple[DataFrame, list[float]]:
    """Rows counted by time, covariates and event, written once; and the edges of the buckets. Rows whose time or covariates are not finite are left out."""
    rows = frame.select(F.col(time).cast("double").alias("time"), event.cast("boolean").alias("_e"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates)])
    for c in ("time", *[f"_x{i}" for i in range(len(covariates))]):
        rows = rows.filter(finite(F.col(c)))
    cells = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    return cells, _edges(cells.select("time"))


def _risk_sums(cells: DataFrame, edges: list[float], beta: np.ndarray) -> DataFrame:
    """One row: log-likelihood (Breslow ties), gradient g_i and information h_ij at beta."""
    p = len(beta)
    x, n = [F.col(f"_x{i}") for i in range(p)], F.col("_n")
    score = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
    died, e = F.when(F.col("_e"), n).otherwise(0.0), F.exp(score) * n
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    counts = {"d": F.sum(died), "ds": F.sum(died * score), "s0": F.sum(e)}
    counts |= {f"dx_{i}": F.sum(died * x[i]) for i in range(p)} | {f"s1_{i}": F.sum(e * x[i]) for i in range(p)}
    counts |= {f"s2_{i}_{j}": F.sum(e * x[i] * x[j]) for i, j in pairs}
    rows = _bucketed(cells.groupBy("time").agg(*[c.alias(k) for k, c in counts.items()]), edges)
    # As _running(), for all sums at once.
    sums = [k for k in counts if k.startswith("s")]
    over = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in sums]).select("bucket", *[F.coalesce(F.sum(k).over(over), F.lit(0.0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("bucket").orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    risk = rows.withColumns({k: F.sum(k).over(inside) for k in sums}).join(later, "bucket").withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).filter("d > 0")
    mean = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
    return risk.agg(
        F.sum(F.col("ds") - F.col("d") * F.ln("s0")).alias("ll"),
        *[F.sum(F.col(f"dx_{i}") - F.col("d") * mean[i]).alias(f"g_{i}") for i in range(p)],
        *[F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean[i] * mean[j])).alias(f"h_{i}_{j}") for i, j in pairs],
    )


def cox_log_likelihood(frame: DataFrame, time: str, event: Column, covariates: list[str], beta: list[float]) -> DataFrame:
    """One row: the log-likelihood (Breslow ties) at beta."""
    return _risk_sums(*_cells(frame, time, event, covariates), np.array(beta)).select("ll")


def cox(frame: DataFrame, time: str, event: Column, covariates: list[str], rounds: int = 50, tolerance: float = 1e-8) -> dict:
    """Newton's method, one aggregate job a round over cells that are written once; only the p gradient and p*p information numbers reach the driver.

    Returns beta, se (NaN if singular), log_likelihood and converged.
    """
    p = len(covariates)
    cells, edges = _cells(frame, time, event, covariates)
    beta, converged, info = np.zeros(p), False, np.full((p, p), np.nan)
    ll = None
    for _ in range(rounds):
        r = _risk_sums(cells, edges, beta).first()
        if r["ll"] is None:
            break
        ll = r["ll"]
        info = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        try:
            step = np.linalg.solve(info, np.array([r[f"g_{i}"] for i in range(p)]))
        except np.linalg.LinAlgError:
            break
        beta = beta + step
        if np.abs(step).max() < tolerance:
            converged = True
            break
    discard(cells)
    try:
        se = np.sqrt(np.diag(np.linalg.inv(info)))
    except np.linalg.LinAlgError:
        se = np.full(p, np.nan)
    return {"beta": beta.tolist(), "se": se.tolist(), "log_likelihood": ll, "converged": converged}
