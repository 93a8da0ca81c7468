"""Queries of scoring, evaluation, calibration and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.operators import isotonic, models
from vitalframe.plans.frames import WITH, scores, table
from vitalframe.plans.registry import query
from vitalframe.plans.statistics import rounded

def _label():
    return F.col("label")


_CONF = WITH + ", c as (select count(*) filter (where label and score >= 0.2) tp, count(*) filter (where not label and score >= 0.2) fp, count(*) filter (where not label and score < 0.2) tn, count(*) filter (where label and score < 0.2) fn from scores)"


@query("confusion", _CONF + " select tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) as accuracy from c")
def confusion(spark, d):
    return rounded(models.confusion(scores(spark, d), _label(), "score", 0.2))


_ROC = WITH + ", t as (select * from (values (0.05::double), (0.1), (0.2), (0.5), (0.9)) v(threshold)), p as (select threshold, coalesce(count(*) filter (where not label and score >= threshold) / nullif(count(*) filter (where not label), 0), 0) as fpr, coalesce(count(*) filter (where label and score >= threshold) / nullif(count(*) filter (where label), 0), 0) as tpr from scores, t group by threshold)"
_CUTS = [0.05, 0.1, 0.2, 0.5, 0.9]


@query("roc_points", _ROC + " select threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from p")
def roc_points(spark, d):
    return rounded(models.roc_points(scores(spark, d), _label(), "score", _CUTS))


@query("auc_trapezoid", _ROC + ", l as (select fpr - lag(fpr) over (order by fpr, tpr) as dx, tpr + lag(tpr) over (order by fpr, tpr) as h from p) select round(coalesce(sum(dx * h / 2), 0), 6) as auc from l")
def auc_trapezoid(spark, d):
    return rounded(models.auc_of_points(models.roc_points(scores(spark, d), _label(), "score", _CUTS)))


@query("auc_rank", WITH + ", r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as r from scores) select round((sum(r) filter (where label) - count(*) filter (where label) * (count(*) filter (where label) + 1) / 2) / (count(*) filter (where label) * count(*) filter (where not label)), 6) as auc from r")
def auc_rank(spark, d):
    return rounded(models.auc_rank(scores(spark, d), _label(), "score"))


@query("brier", WITH + "select round(avg(pow(score - label::int, 2)), 6) as brier from scores")
def brier(spark, d):
    return rounded(models.brier(scores(spark, d), _label(), "score"))


@query("ece", WITH + ", b as (select least(floor(score * 10), 9) as b, count(*) n, avg(score) c, avg(label::int) a from scores group by 1) select round(sum(n * abs(c - a)) / sum(n), 6) as ece from b")
def ece(spark, d):
    return rounded(models.calibration_error(scores(spark, d), _label(), "score", 10))


@query("demographic_parity", WITH + "select round(abs(coalesce(avg((score >= 0.2)::int) filter (where grp = 0), 0) - coalesce(avg((score >= 0.2)::int) filter (where grp = 1), 0)), 6) as gap from scores")
def demographic_parity(spark, d):
    return rounded(models.parity_gap(scores(spark, d), "score", "grp", 0, 1, 0.2))


@query("equal_opportunity", WITH + "select round(abs(coalesce(avg((score >= 0.2)::int) filter (where grp = 0), 0) - coalesce(avg((score >= 0.2)::int) filter (where grp = 1), 0)), 6) as gap from scores where label")
def equal_opportunity(spark, d):
    return rounded(models.opportunity_gap(scores(spark, d), _label(), "score", "grp", 0, 1, 0.2))


@query("group_bias", WITH + "select grp, round(avg(score), 6) as mean_score, count(*) as n from scores group by grp")
def group_bias(spark, d):
    return rounded(models.group_bias(scores(spark, d), "score", "grp"))


_WEIGHTS = [0.02, -0.5, 0.3]


@query("risk_score_linear", "select l_orderkey, l_quantity, round(least(greatest(l_quantity * 0.02 - 0.5 * l_discount + 0.3 * l_tax + 0.1, 0), 1), 6) as score from lineitem")
def risk_score_linear(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", models.linear_score(F.array("l_quantity", "l_discount", "l_tax"), _WEIGHTS, 0.1).alias("score")))


@query("explain_contrib", "select f as feature, round(sum(c), 4) as contribution from (select unnest(['quantity', 'discount', 'tax']) as f, unnest([0.02 * l_quantity, -0.5 * l_discount, 0.3 * l_tax]) as c from lineitem) group by 1")
def explain_contrib(spark, d):
    rows = table(spark, d, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax").alias("x"))
    return models.contributions(rows, "x", ["quantity", "discount", "tax"], _WEIGHTS).groupBy("feature").agg(F.round(F.sum("contribution"), 4).alias("contribution"))


_JSON = "with s as (select event_id, event_type, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0) / 1, 0), 1) as score from events)"


@query("predict_risk_json", _JSON + " select event_id, score from s")
def predict_risk_json(spark, d):
    return table(spark, d, "events").select("event_id", models.json_risk("props", ["k", "missing"]).alias("score"))


@query("stratify", "select event_id, case when value / 200 >= 0.7 then 'High' when value / 200 >= 0.3 then 'Moderate' else 'Low' end as stratum from events")
def stratify(spark, d):
    return table(spark, d, "events").select("event_id", models.stratum(F.col("value") / 200).alias("stratum"))


@query("recommendations", "select event_id, 'flag_high_risk' as action, 'high' as priority from events where value / 200 >= 0.7 union all select event_id, 'schedule_follow_up', 'medium' from events where value / 200 >= 0.7 union all select event_id, 'monitor', 'medium' from events where value / 200 >= 0.3 and value / 200 < 0.7 union all select event_id, 'routine_care', 'low' from events where value / 200 < 0.3")
def recommendations(spark, d):
    return models.next_steps(table(spark, d, "events").select("event_id", (F.col("value") / 200).alias("s")), "s", "event_id")


@query("cohort_report", "select event_type, count(*) as n, round(avg(least(value / 200, 1)), 6) as mean_score, count(*) filter (where value / 200 >= 0.7) as high from events group by 1")
def cohort_report(spark, d):
    rows = table(spark, d, "events").select("event_type", F.least(F.col("value") / 200, F.lit(1.0)).alias("s"))
    return rounded(models.cohort_report(rows, "s", "event_type"))


@query("nlp_notes", "select doc_id, contains(lower(text), 'fever') as fever, case when contains(lower(text), 'concern') or contains(lower(text), 'worsening') then 'negative' when contains(lower(text), 'improved') or contains(lower(text), 'stable') then 'positive' else 'neutral' end as sentiment from documents")
def nlp_notes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", models.note_findings("text").alias("x"))
    return rows.select("doc_id", F.array_contains("x.symptoms", "fever").alias("fever"), "x.sentiment")


@query("quantize_i8", "select event_id, greatest(least(round(value / 2), 127), -127)::tinyint as q from events")
def quantize_i8(spark, d):
    return table(spark, d, "events").select("event_id", models.quantize("value", 2.0).alias("q"))


@query("platt_scaling")
def platt_scaling(spark, d):
    return spark.createDataFrame([models.platt_fit(scores(spark, d), _label(), "score", 0.5, 10)], "a double, b double")


#: The fit by its minimax formula: the largest over starts of the smallest mean over ends.
_ISOTONIC = WITH + """, c as (select score as s, count(*) as n, count(*) filter (where label) as k from scores group by score),
 p as (select s, row_number() over (order by s) as i, sum(n) over (order by s) as n, sum(k) over (order by s) as k, n as n1, k as k1 from c),
 m as (select a.i as j, b.i as e, (b.k - a.k + a.k1) / (b.n - a.n + a.n1) as mean from p a join p b on a.i <= b.i),
 low as (select j, e, min(mean) over (partition by j order by e desc) as x from m),
 fit as (select p.s, max(x) as v, p.n1, p.k1 from low join p on p.i = low.e group by p.s, p.n1, p.k1)
"""


@query("isotonic", _ISOTONIC + "select d.doc_id, round(v, 6) as calibrated from scores d join fit on fit.s = d.score")
def isotonic_(spark, d):
    rows = scores(spark, d)
    return rounded(isotonic.isotonic_step(rows.select("doc_id", "score"), "score", isotonic.isotonic_fit(rows, _label(), "score")).select("doc_id", "calibrated"))


@query("isotonic_interpolated", _ISOTONIC + """, t as (select s, v, sum(n1 * v - k1) over (order by s) - (n1 * v - k1) as gap from fit), b as (select s as low, v from t where abs(gap) < 1e-6), l as (select low, v, lead(low) over (order by low) as up, lead(v) over (order by low) as w from b),
 x as (select doc_id, least(score * 1.07, 1) as q from scores), f as (select min(low) as first, max(low) as last from b)
 select doc_id, round(case when q < first or q >= last then v else v + (q - low) / (up - low) * (w - v) end, 5) as calibrated
 from x, f join l on (q >= low and (up is null or q < up)) or (q < first and low = first)""")
def isotonic_interpolated(spark, d):
    rows = scores(spark, d)
    asked = rows.select("doc_id", F.least(F.col("score") * 1.07, F.lit(1.0)).alias("q"))
    return rounded(isotonic.isotonic_interpolated(asked, "q", isotonic.isotonic_fit(rows, _label(), "score")).select("doc_id", "calibrated"), 5)
