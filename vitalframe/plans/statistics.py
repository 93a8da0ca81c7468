"""Queries of descriptive statistics, tests, regression and epidemiology."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.functions import medical
from vitalframe.operators import resampling, stats
from vitalframe.plans.frames import WITH, observations, table
from vitalframe.plans.registry import query


def rounded(frame, digits: int = 6):
    return frame.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in frame.dtypes])


@query("mean_median_std", WITH + "select code, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as sd, round(stddev_pop(value), 6) as sd_pop from observations group by code")
def mean_median_std(spark, d):
    return rounded(stats.describe(observations(spark, d), "value", "code"))


@query("exact_sum", "select event_type, sum(value::decimal(38, 12))::double as total from events group by 1")
def exact_sum(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(stats.exact_sum("value").cast("double").alias("total"))


@query("welch_t", """with s as (select avg(value) filter (where event_type = 'view') ma, var_samp(value) filter (where event_type = 'view') / count(*) filter (where event_type = 'view') sa, count(*) filter (where event_type = 'view') na,
 avg(value) filter (where event_type = 'click') mb, var_samp(value) filter (where event_type = 'click') / count(*) filter (where event_type = 'click') sb, count(*) filter (where event_type = 'click') nb from events)
 select round((ma - mb) / sqrt(sa + sb), 6) as t, round((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 4) as df from s""")
def welch_t(spark, d):
    return stats.welch(table(spark, d, "events"), "value", "event_type", "view", "click").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("lab_stats", "select round(avg(coalesce(value, 0)), 6) as mean, round(stddev_pop(coalesce(value, 0)), 6) as sd from events")
def lab_stats(spark, d):
    v = F.coalesce("value", F.lit(0.0))
    return rounded(table(spark, d, "events").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")))


@query("hist_bins", "select b::integer as bin, count(value) as n from range(5) r(b) left join events on value >= b * 50 and (value < b * 50 + 50 or (b = 4 and value <= 250)) group by b")
def hist_bins(spark, d):
    return stats.bin_counts(table(spark, d, "events"), "value", [0, 50, 100, 150, 200, 250])


@query("minmax_norm", "select event_id, round((value - (select min(value) from events)) / (select max(value) - min(value) from events), 6) as scaled from events")
def minmax_norm(spark, d):
    return rounded(stats.min_max(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", "scaled"))


@query("std_scaler", "select event_id, round((value - avg(value) over (partition by event_type)) / stddev_pop(value) over (partition by event_type), 5) as z from events")
def std_scaler(spark, d):
    return rounded(stats.standardize(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "event_type").select("event_id", "z"), 5)


@query("linreg_1d", "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1")
def linreg_1d(spark, d):
    return stats.linear_fit(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag").select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


_STUDIES = "with s as (select user_id, avg(value) as y, var_samp(value) / count(*) as v from events group by 1 having count(*) > 2), w as (select sum(1/v) w, sum(1/v/v) ww, sum(y/v) wy, sum(y*y/v) wyy, count(*) k from s where v > 0)"


def _studies(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("y"), (F.var_samp("value") / F.count("value")).alias("v"), F.count("value").alias("n")).filter("n > 2")


@query("meta_fixed", _STUDIES + " select round(wy/w, 6) as pooled, round(sqrt(1/w), 6) as se, round(wy/w - 1.959963984540054*sqrt(1/w), 6) as low, round(wy/w + 1.959963984540054*sqrt(1/w), 6) as high, round(wyy - wy*wy/w, 4) as q, round(greatest((wyy - wy*wy/w - (k - 1)) / (wyy - wy*wy/w), 0) * 100, 4) as i2 from w")
def meta_fixed(spark, d):
    found = stats.meta_fixed(_studies(spark, d), "y", "v")
    return found.select(*[F.round(c, 4 if c in ("q", "i2") else 6).alias(c) for c in found.columns])


@query("meta_random", _STUDIES + ", t as (select greatest((wyy - wy*wy/w - (k - 1)) / (w - ww/w), 0) as tau2 from w), r as (select any_value(tau2) tau2, sum(1/(v + tau2)) w, sum(y/(v + tau2)) wy from s, t where v > 0) select round(tau2, 4) as tau2, round(wy/w, 5) as pooled, round(sqrt(1/w), 5) as se, round(wy/w - 1.959963984540054*sqrt(1/w), 5) as low, round(wy/w + 1.959963984540054*sqrt(1/w), 5) as high from r")
def meta_random(spark, d):
    found = stats.meta_random(_studies(spark, d), "y", "v")
    return found.select(*[F.round(c, 4 if c == "tau2" else 5).alias(c) for c in found.columns])


@query("age_std_rate", "select event_type, round(sum(value * user_id) / sum(user_id), 6) as rate from events group by 1")
def age_std_rate(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(stats.age_standardized_rate("value", "user_id").alias("rate")))


@query("epi_2x2", """with c as (select c_nationkey, count(*) filter (where c_acctbal > 5000 and c_custkey % 2 = 0) tp, count(*) filter (where c_acctbal > 5000 and c_custkey % 2 = 1) fp,
 count(*) filter (where c_acctbal <= 5000 and c_custkey % 2 = 1) tn, count(*) filter (where c_acctbal <= 5000 and c_custkey % 2 = 0) fn from customer group by 1)
, r as (select c_nationkey, tp / nullif(tp + fn, 0) as sens, tn / nullif(tn + fp, 0) as spec, tp / nullif(tp + fp, 0) as ppv, tn / nullif(tn + fn, 0) as npv from c)
 select c_nationkey, round(sens, 6) as sens, round(spec, 6) as spec, round(ppv, 6) as ppv, round(npv, 6) as npv,
 round(case when spec = 1 then 'inf'::double else sens / (1 - spec) end, 5) as lrp, round(case when spec = 0 then 'inf'::double else (1 - sens) / spec end, 5) as lrn from r""")
def epi_2x2(spark, d):
    high, even = F.col("c_acctbal") > 5000, F.col("c_custkey") % 2 == 0
    n = lambda c: F.sum(c.cast("long"))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(n(high & even).alias("tp"), n(high & ~even).alias("fp"), n(~high & ~even).alias("tn"), n(~high & even).alias("fn"))
    c = c.select("c_nationkey", medical.sensitivity("tp", "fn").alias("sens"), medical.specificity("tn", "fp").alias("spec"), medical.ppv("tp", "fp").alias("ppv"), medical.npv("tn", "fn").alias("npv"))
    return c.select(
        "c_nationkey", *[F.round(x, 6).alias(x) for x in ("sens", "spec", "ppv", "npv")],
        F.round(medical.lr_positive("sens", "spec"), 5).alias("lrp"), F.round(medical.lr_negative("sens", "spec"), 5).alias("lrn"),
    )


@query("arr_nnt", "select l_orderkey, round(l_tax - l_discount, 6) as arr, round(case when l_tax = 0 then null else l_discount / l_tax end, 6) as rr, case when round(l_tax - l_discount, 6) = 0 then 'inf' else 'finite' end as nnt from lineitem")
def arr_nnt(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", F.round(F.round("l_tax", 2), 2).alias("cer"), F.round("l_discount", 2).alias("ter"))
    nnt = medical.number_needed_to_treat("cer", "ter")
    return c.select("l_orderkey", F.round(medical.absolute_risk_reduction("cer", "ter"), 6).alias("arr"), F.round(medical.relative_risk("cer", "ter"), 6).alias("rr"), F.when(nnt == float("inf"), "inf").otherwise("finite").alias("nnt"))


@query("star_rating", "select event_id, (1 + (value >= 50)::int + (value >= 100)::int + (value >= 150)::int + (value >= 200)::int)::int as stars from events")
def star_rating(spark, d):
    return table(spark, d, "events").select("event_id", medical.star_rating("value", (50, 100, 150, 200)).alias("stars"))


@query("odds_logit", "select l_orderkey, round(case when l_discount <= 0 then 0 else l_discount / (1 - l_discount) end, 6) as odds, round(1 / (1 + exp(-l_discount)), 6) as inv from lineitem")
def odds_logit(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.round(medical.odds("l_discount"), 6).alias("odds"), F.round(medical.inv_logit("l_discount"), 6).alias("inv"))


@query("sir_model", """with recursive p as (select r_regionkey::bigint as k, 0.3 + 0.1 * r_regionkey as beta from region),
 s(k, step, beta, s, i, r) as (select k, 0, beta::double, 0.99::double, 0.01::double, 0.0::double from p union all
 select k, step + 1, beta, s - 0.1 * beta * s * i, i + 0.1 * (beta * s * i - 0.1 * i), r + 0.1 * 0.1 * i from s where step < 100)
 select k, step::int as step, round(s, 6) as s, round(i, 6) as i, round(r, 6) as r from s""")
def sir_model(spark, d):
    p = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), (F.col("r_regionkey") * 0.1 + 0.3).alias("beta"))
    path = medical.sir_trajectory(F.lit(0.99), F.lit(0.01), F.lit(0.0), "beta", F.lit(0.1), F.lit(10.0), F.lit(0.1))
    return rounded(p.select("k", F.posexplode(path).alias("step", "x")).select("k", "step", "x.s", "x.i", "x.r"))


def _interval(spark, d, statistic):
    """Bounds for each type of event."""
    rows = table(spark, d, "events")
    kinds = [r[0] for r in rows.select("event_type").distinct().orderBy("event_type").collect()]
    found = [(k, *resampling.bootstrap_ci(rows.filter(F.col("event_type") == k), "value", statistic, 200, 0.95)) for k in kinds]
    return spark.createDataFrame(found, "event_type string, low double, high double")


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return _interval(spark, d, "mean")


@query("bootstrap_median")
def bootstrap_median(spark, d):
    return _interval(spark, d, "median")


@query("permutation_test")
def permutation_test(spark, d):
    return resampling.permutation_p(table(spark, d, "events"), "value", "event_type", "view", "click", 200)
