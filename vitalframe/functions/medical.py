"""Scalar formulas of epidemiology, clinical trials, quality and risk as column expressions.

A zero denominator gives null unless a formula says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalframe.functions.exprs import col, safe_div

INF = float("inf")


def ratio(a, b) -> Column:
    """Incidence rate, prevalence, HEDIS rate, risk ratio, relative risk: a / b."""
    return safe_div(a, b)


def difference(a, b) -> Column:
    """Risk difference of two rates: a - b."""
    return col(a).cast("double") - col(b)


def sensitivity(tp, fn) -> Column:
    return safe_div(tp, col(tp) + col(fn))


def specificity(tn, fp) -> Column:
    return safe_div(tn, col(tn) + col(fp))


def ppv(tp, fp) -> Column:
    return safe_div(tp, col(tp) + col(fp))


def npv(tn, fn) -> Column:
    return safe_div(tn, col(tn) + col(fn))


def lr_positive(sens, spec) -> Column:
    """sens / (1 - spec); infinite at spec = 1."""
    return safe_div(sens, 1 - col(spec), INF)


def lr_negative(sens, spec) -> Column:
    """(1 - sens) / spec, the textbook form; infinite at spec = 0."""
    return safe_div(1 - col(sens), spec, INF)


def absolute_risk_reduction(cer, ter) -> Column:
    return col(cer) - col(ter)


def relative_risk(cer, ter) -> Column:
    return safe_div(ter, cer)


def number_needed_to_treat(cer, ter) -> Column:
    """|1 / (cer - ter)|; infinite for equal rates."""
    return F.abs(safe_div(F.lit(1.0), col(cer) - col(ter), INF))


def odds(p) -> Column:
    """p / (1 - p); infinite from 1 on, 0 up to 0."""
    p = col(p)
    return F.when(p >= 1, F.lit(INF)).when(p <= 0, F.lit(0.0)).otherwise(safe_div(p, 1 - p))


def logit(p) -> Column:
    p = col(p)
    return F.when(p >= 1, F.lit(INF)).when(p <= 0, F.lit(-INF)).otherwise(F.ln(safe_div(p, 1 - p)))


def inv_logit(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def rate_per(events, population, per: float) -> Column:
    return safe_div(events, population) * per


def star_rating(score, cuts: tuple[float, float, float, float]) -> Column:
    """1 to 5: one more than the number of ascending cut points reached."""
    return sum(((col(score) >= c).cast("int") for c in cuts), F.lit(1))


def cohen_d(mean_a, mean_b, pooled) -> Column:
    return safe_div(col(mean_a) - col(mean_b), pooled)


def pooled_stddev(sd_a, n_a, sd_b, n_b) -> Column:
    va, vb, na, nb = (col(x).cast("double") for x in (sd_a, sd_b, n_a, n_b))
    return F.sqrt(safe_div((na - 1) * va * va + (nb - 1) * vb * vb, na + nb - 2))


def sir_steps(days, dt) -> Column:
    return F.least(F.round(safe_div(days, dt)), F.lit(10_000_000)).cast("int")


def sir_trajectory(s, i, r, beta, gamma, days, dt) -> Column:
    """Forward-Euler SIR compartments, t = 0 included: array of (s, i, r). A recurrence, folded per parameter row."""
    s, i, r, beta, gamma, dt = (col(x).cast("double") for x in (s, i, r, beta, gamma, dt))
    first = F.struct(s.alias("s"), i.alias("i"), r.alias("r"))

    def step(path, _):
        last = F.element_at(path, -1)
        infected, healed = beta * last["s"] * last["i"], gamma * last["i"]
        after = F.struct((last["s"] - dt * infected).alias("s"), (last["i"] + dt * (infected - healed)).alias("i"), (last["r"] + dt * healed).alias("r"))
        return F.concat(path, F.array(after))

    return F.aggregate(F.sequence(F.lit(1), sir_steps(days, dt)), F.array(first), step)


def seir_trajectory(s, e, i, r, beta, sigma, gamma, days, dt) -> Column:
    """Forward-Euler SEIR compartments, t = 0 included: array of (s, e, i, r)."""
    s, e, i, r, beta, sigma, gamma, dt = (col(x).cast("double") for x in (s, e, i, r, beta, sigma, gamma, dt))
    first = F.struct(s.alias("s"), e.alias("e"), i.alias("i"), r.alias("r"))

    def step(path, _):
        last = F.element_at(path, -1)
        exposed, sick, healed = beta * last["s"] * last["i"], sigma * last["e"], gamma * last["i"]
        return F.concat(path, F.array(F.struct(
            (last["s"] - dt * exposed).alias("s"), (last["e"] + dt * (exposed - sick)).alias("e"),
            (last["i"] + dt * (sick - healed)).alias("i"), (last["r"] + dt * healed).alias("r"),
        )))

    return F.aggregate(F.sequence(F.lit(1), sir_steps(days, dt)), F.array(first), step)
