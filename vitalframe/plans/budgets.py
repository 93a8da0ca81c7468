"""Queries of budgets and secure averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.operators import ledger, secure
from vitalframe.plans.frames import table, updates
from vitalframe.plans.registry import query
from vitalframe.plans.statistics import rounded


@query("private_sum_budgeted", """
with recursive r as (select event_id, user_id, (case when event_id % 50 = 7 then null else floor(value) / 400 end)::double as e, row_number() over (partition by user_id order by event_id) as i from events),
f as (
 select event_id, user_id, i, coalesce(e <= 2.0, false) as accepted, case when coalesce(e <= 2.0, false) then e else 0.0 end::double as spent from r where i = 1
 union all
 select r.event_id, r.user_id, r.i, coalesce(f.spent + r.e <= 2.0, false), case when coalesce(f.spent + r.e <= 2.0, false) then f.spent + r.e else f.spent end from f join r on r.user_id = f.user_id and r.i = f.i + 1)
select event_id, user_id, accepted, round(spent, 6) as epsilon_spent, accepted as has_sum from f""")
def private_sum_budgeted(spark, d):
    events = table(spark, d, "events")
    requests = events.select("event_id", "user_id", F.when(F.col("event_id") % 50 != 7, F.floor("value") / 400).alias("epsilon"))
    sums = events.groupBy("user_id").agg(F.sum("value").alias("total"))
    found = ledger.private_sums_budgeted(sums, requests, "user_id", ["event_id"], "total", 500.0, "epsilon", 2.0, seed=3)
    return rounded(found.select("event_id", "user_id", "accepted", "epsilon_spent", (F.col("private_sum").isNotNull() | (F.col("accepted") & (F.col("epsilon") == 0))).alias("has_sum")))


_FLAT = "(select vec_id, label, unnest(embedding)::double as w, unnest(range(len(embedding)))::int as pos from embeddings)"


@query("secure_fedavg", f"select label::bigint as round, pos, round(sum((w * (label + 1))::decimal(38,15)) / sum(label + 1), 8)::double as weight from {_FLAT} group by 1, 2")
def secure_fedavg(spark, d):
    found = secure.secure_fedavg(updates(spark, d), "client", "weights", "examples", "a secret of the round", "round")
    return rounded(found.withColumn("round", F.col("round").cast("long")), 8)
