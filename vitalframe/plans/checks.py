"""Queries of checks against a context, of processed bundles, and of models by metric and feature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.operators import bundles, context, models
from vitalframe.plans.frames import WITH, scores, table
from vitalframe.plans.registry import query
from vitalframe.plans.statistics import rounded

_LAB = """labs as (select event_id, case when event_type = 'error' then 'x-1' when event_id % 40 = 3 then ' ' else '2345-7' end as code, value,
 case event_id % 7 when 0 then 'mg/dL' when 1 then 'mmol/L' when 2 then 'MG/DL' when 3 then 'furlong' when 4 then 'bpm' else 'mg/dL' end as unit, case when event_id % 31 = 5 then 0 else 1700000000000 + event_id end as timestamp_ms from events)"""


def _labs(spark, d):
    i = F.col("event_id")
    unit = F.when(i % 7 == 1, "mmol/L").when(i % 7 == 2, "MG/DL").when(i % 7 == 3, "furlong").when(i % 7 == 4, "bpm").otherwise("mg/dL")
    code = F.when(F.col("event_type") == "error", "x-1").when(i % 40 == 3, " ").otherwise("2345-7")
    return table(spark, d, "events").select("event_id", code.alias("code"), "value", unit.alias("unit"), F.when(i % 31 == 5, F.lit(0)).otherwise(i + 1700000000000).alias("timestamp_ms"))


@query("reference_range", f"with {_LAB} select event_id, case when code = '2345-7' then case unit when 'mg/dL' then 70.0 when 'mmol/L' then 3.9 end end::double as low, case when code = '2345-7' then case unit when 'mg/dL' then 99.0 when 'mmol/L' then 5.5 end end::double as high from labs")
def reference_range(spark, d):
    return context.reference_range(_labs(spark, d), context.Context.demo(spark)).select("event_id", "low", "high")


@query("validate_lab", f"""with {_LAB} select event_id, case when trim(code) = '' then 'code: is empty' when timestamp_ms <= 0 then 'timestamp_ms: must be a positive epoch millis' when code <> '2345-7' then 'unknown LOINC code ' || code
 when unit = 'furlong' then 'invalid unit furlong' when unit not in ('mg/dL', 'mmol/L') then 'unit: unit not preferred for given LOINC'
 when unit = 'mg/dL' and (value < 70 or value > 99) or unit = 'mmol/L' and (value < 3.9 or value > 5.5) then 'out of reference range ' || code || ' ' || unit end as error from labs""")
def validate_lab(spark, d):
    return context.validate_lab(_labs(spark, d), context.Context.demo(spark)).select("event_id", "error")


@query("validate_diagnosis", """select c_custkey, case when c_custkey % 11 = 0 then 'description: is empty' when c_custkey % 5 = 1 then 'unknown SNOMED code 1' end as error from customer""")
def validate_diagnosis(spark, d):
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(c, F.when(c % 5 == 1, "1").when(c % 2 == 0, "44054006").otherwise("38341003").alias("code"), F.when(c % 11 == 0, "").otherwise(F.col("c_name")).alias("description"), F.lit(5).alias("created_at_ms"))
    return context.validate_diagnosis(rows, context.Context.demo(spark)).select("c_custkey", "error")


#: Orders are bundles, their lines the entries; some lines fail, some orders have a line twice.
_ENTRIES = """e as (select l_orderkey as bundle, case l_orderkey % 3 when 0 then 'Batch' when 1 then 'Transaction' else 'Collection' end as kind, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as place,
 case when l_orderkey % 10 = 4 then 'same' else l_partkey::varchar end as id, case when l_quantity > 42 then 'quantity ' || l_quantity::int end as error from lineitem)"""


def _entries(spark, d):
    key = F.col("l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return table(spark, d, "lineitem").select(
        key.alias("bundle"), F.when(key % 3 == 0, "Batch").when(key % 3 == 1, "Transaction").otherwise("Collection").alias("kind"), place.alias("place"),
        F.when(key % 10 == 4, "same").otherwise(F.col("l_partkey").cast("string")).alias("id"), F.when(F.col("l_quantity") > 42, F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string"))).alias("fault"),
    )


_PROCESSED = f"""with {_ENTRIES}, d as (select bundle, id, min(place) as first from e group by 1, 2 having count(*) > 1),
 o as (select e.bundle, arg_min(e.id, e.place) as id from e join d on e.bundle = d.bundle and e.id = d.id and e.place > d.first group by 1),
 b as (select bundle, kind, min(place) filter (where error is not null) as bad, arg_min(error, place) filter (where error is not null) as first, count(error) as n from e group by 1, 2),
 v as (select b.*, case when kind = 'Collection' then 'a Collection cannot be processed' when kind = 'Transaction' and o.id is not null then 'duplicate id ' || o.id end as invalid from b left join o using (bundle))"""


@query("bundle_process", f"""{_PROCESSED} select v.bundle, v.kind, invalid, count(*) filter (where invalid is null and case when v.kind = 'Transaction' then bad is null or place < bad else error is null end) as applied,
 case when invalid is not null then 0 when v.kind = 'Transaction' then least(n, 1) else n end as failures, case when invalid is null then first end as first_error, invalid is null and (v.kind = 'Batch' or bad is null) as committed
 from v join e on e.bundle = v.bundle group by v.bundle, v.kind, invalid, n, first, bad""")
def bundle_process(spark, d):
    return bundles.process(_entries(spark, d), "bundle", "kind", "place", F.col("fault"))


@query("bundle_applied", f"{_PROCESSED} select e.bundle, e.place::int as place, e.id from e join v on v.bundle = e.bundle where invalid is null and ((v.kind = 'Batch' and error is null) or (v.kind = 'Transaction' and bad is null))")
def bundle_applied(spark, d):
    return bundles.applied_entries(_entries(spark, d), "bundle", "kind", "place", F.col("fault")).select("bundle", "place", "id")


@query("metric_list", WITH + """, p as (select grp, label as y, score as s, score >= 0.3 as p from scores), b as (select grp, least(floor(s * 10), 9) as b, sum(s - y::int) as gap from p group by 1, 2),
 m as (select grp, avg((y = p)::int) as accuracy, coalesce(sum((y and p)::int) / nullif(sum(p::int), 0), 0) as "precision", coalesce(sum((y and p)::int) / nullif(sum(y::int), 0), 0) as recall, coalesce(2 * sum((y and p)::int) / nullif(sum(y::int) + sum(p::int), 0), 0) as f1,
  avg(pow(s - y::int, 2)) as brier, avg(-ln(greatest(case when y then s else 1 - s end, 1e-15))) as log_loss, (select sum(abs(gap)) from b where b.grp = p.grp) / count(*) as ece, max(s) as highest from p group by grp)
 select grp, metric, round(value::double, 6) as value from (unpivot m on accuracy, "precision", recall, f1, brier, log_loss, ece, highest into name metric value value)""")
def metric_list(spark, d):
    found = models.validate_model(scores(spark, d), F.col("label"), "score", ["accuracy", "precision", "recall", "f1", "brier", "log_loss", "ece", ("highest", lambda y, s, p: F.max(s))], 0.3, "grp")
    return rounded(found)


_WEIGHTS = (0.02, 3.0, -4.0)


def _risk(x: np.ndarray) -> np.ndarray:
    return np.clip(x @ np.array(_WEIGHTS) + 0.05, 0, 1)


_Y = "least(greatest({q} * 0.02 + {d} * 3.0 + {t} * -4.0 + 0.05, 0), 1)"
_UP = [_Y.format(q="(l_quantity + 0.001)", d="l_discount", t="l_tax"), _Y.format(q="l_quantity", d="(l_discount + 0.0001)", t="l_tax"), _Y.format(q="l_quantity", d="l_discount", t="(l_tax + 0.0001)")]
_DOWN = [x.replace(" + 0.001)", " - 0.001)").replace(" + 0.0001)", " - 0.0001)") for x in _UP]
_BASE = _Y.format(q="l_quantity", d="l_discount", t="l_tax")


@query("feature_importance", " union all ".join(
    f"select '{n}' as feature, round(avg(0.5 * (abs({u} - {w}) / 0.002 + greatest(abs({u} - {_BASE}), abs({w} - {_BASE})))), 6) as importance from lineitem" for n, u, w in zip(("l_quantity", "l_discount", "l_tax"), _UP, _DOWN, strict=True)))
def feature_importance(spark, d):
    return rounded(models.feature_importance(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], _risk, [1.0, 0.1, 0.1]))
