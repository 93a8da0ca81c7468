"""Queries of ordered windows, sessions, alerts, streams and survival."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitalframe.functions.shared import shared_dir
from vitalframe.operators import series, survival
from vitalframe.plans import frames
from vitalframe.plans.frames import WITH, table
from vitalframe.plans.registry import query
from vitalframe.plans.statistics import rounded
from vitalframe.streaming import live


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")


def _windowed(f, name):
    return f"select event_id, round({f}(value) over w, 6) as {name} from events window w as (partition by user_id order by ts, event_id rows 4 preceding) qualify row_number() over (partition by user_id order by ts, event_id) >= 5"


@query("moving_avg", _windowed("avg", "moving_average"))
def moving_avg(spark, d):
    return rounded(series.moving_average(_events(spark, d), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "moving_average"))


@query("rolling_std", _windowed("stddev_samp", "rolling_std"))
def rolling_std(spark, d):
    return rounded(series.rolling_std(_events(spark, d), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "rolling_std"))


@query("sliding_sum", _windowed("sum", "sliding_sum"))
def sliding_sum(spark, d):
    return rounded(series.sliding_sum(_events(spark, d), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "sliding_sum"))


# A little is added before rounding: averages of values with two decimals often end in a 5, where the order of sums would decide.
@query("ema", """with recursive e as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
 r(event_id, user_id, i, ema) as (select event_id, user_id, i, value from e where i = 1 union all
 select e.event_id, e.user_id, e.i, 0.3 * e.value + 0.7 * r.ema from r join e on e.user_id = r.user_id and e.i = r.i + 1) select event_id, round(ema + 0.00000123, 5) as ema from r""")
def ema(spark, d):
    return series.ema(_events(spark, d), "user_id", ["ts", "event_id"], "value", 0.3).select("event_id", F.round(F.col("ema") + 0.00000123, 5).alias("ema"))


@query("tumbling_count", "select user_id, w as window, count(*) as n, round(sum(value), 6) as total from (select user_id, value, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as w from events) group by 1, 2")
def tumbling_count(spark, d):
    rows = series.counted_windows(_events(spark, d), "user_id", ["ts", "event_id"], 10)
    return rounded(rows.groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("sliding_count", """with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
 select a.user_id, a.i // 3 as window, round(sum(b.value), 6) as total from e a join e b on a.user_id = b.user_id and b.i between a.i and a.i + 7 where a.i % 3 = 0 and a.i + 8 <= a.n group by 1, 2""")
def sliding_count(spark, d):
    rows = series.sliding_counted_windows(_events(spark, d), "user_id", ["ts", "event_id"], 8, 3)
    return rounded(rows.groupBy("user_id", "window").agg(F.sum("value").alias("total")))


@query("session_gap", """with e as (select user_id, event_id, epoch_ms(ts) as ms, lag(epoch_ms(ts)) over (partition by user_id order by ts, event_id) as p from events),
 s as (select user_id, ms, sum(case when ms - p > 14400000 then 1 else 0 end) over (partition by user_id order by ms rows unbounded preceding)::bigint as session from e)
 select user_id, session, count(*) as n from s group by 1, 2""")
def session_gap(spark, d):
    e = _events(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return series.sessions(e, "user_id", "ms", "ms", 4 * 3600 * 1000).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("ring_last_n", "select user_id, event_id, greatest(count(*) over (partition by user_id) - 3, 0) as dropped from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def ring_last_n(spark, d):
    return series.ring(_events(spark, d), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "dropped")


_RULES = [("view", "high view", "above", None, 150.0), ("click", "low click", "below", 5.0, None), ("click", "odd click", "outside", 2.0, 200.0)]


@query("alerts", "select event_id, 'high view' as rule from events where event_type = 'view' and value >= 150 union all select event_id, 'low click' from events where event_type = 'click' and value <= 5 union all select event_id, 'odd click' from events where event_type = 'click' and (value < 2 or value > 200)")
def alerts(spark, d):
    rules = spark.createDataFrame(_RULES, "metric string, rule string, kind string, low double, high double")
    return series.alerts(_events(spark, d).withColumnRenamed("event_type", "metric"), rules).select("event_id", "rule")


@query("device_messages", "select user_id::varchar as device_id, event_type as metric, count(*) as n, round(sum(value), 4) as total from events where event_type <> 'error' group by 1, 2")
def device_messages(spark, d):
    name = F.when(F.col("event_type") == "error", "x").otherwise(F.col("value").cast("string"))
    lines = _events(spark, d).select(F.concat_ws(",", F.col("user_id").cast("string"), "event_type", name, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("value"))
    return live.readings(lines).groupBy("device_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _stream(spark, d):
    """The events as a stream, and a folder of its own for what the stream writes."""
    stream = live.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_window_counts", "select event_type, count(*) as n, count(distinct date_trunc('day', ts)) as days from events group by 1")
def stream_window_counts(spark, d):
    stream, path = _stream(spark, d)
    # In update mode a window's row is written again whenever it changes, so the newest one counts, the open windows included.
    live.write_batches(live.window_stats(stream, "ts", "event_type", "value", "1 day", "0 seconds"), f"{path}/out", f"{path}/ck")
    found = live.latest(spark, f"{path}/out", "start", "event_type")
    return found.groupBy("event_type").agg(F.sum("n").alias("n"), F.count_distinct("start").alias("days"))


@query("stream_stats", "select event_type, count(value) as n, round(avg(value), 6) as mean, round(var_samp(value), 4) as variance, round(stddev_samp(value), 5) as sd from events group by 1")
def stream_stats(spark, d):
    stream, path = _stream(spark, d)
    live.write_batches(live.running_stats(stream, "event_type", "value"), f"{path}/out", f"{path}/ck")
    found = live.latest(spark, f"{path}/out", "event_type")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("sd", 5).alias("sd"))


@query("stream_ring", "select user_id, greatest(count(*) - 3, 0) as dropped, array_to_string(list_reverse(list(round(value, 2) order by ts desc)[1:3]), ';') as items from events group by 1")
def stream_ring(spark, d):
    stream, path = _stream(spark, d)
    with live.rocksdb(spark):
        live.write_batches(live.ring(stream.select("user_id", "ts", "value"), "user_id", 3), f"{path}/out", f"{path}/ck")
    found = live.latest(spark, f"{path}/out", "key")
    return found.select(F.col("key").alias("user_id"), "dropped", F.array_join(F.transform("items", lambda v: F.round(v, 2).cast("string")), ";").alias("items"))


@query("stream_smoothed", """with recursive e as (select event_id, user_id, ts, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
 s as (select event_id, user_id, i, value as x from e where i = 1 union all select e.event_id, e.user_id, e.i, 0.3 * e.value + 0.7 * s.x from s join e on e.user_id = s.user_id and e.i = s.i + 1)
 select user_id, count(*) as n, round(max(x), 5) as highest, round(sum(x), 3) as total from s group by 1""")
def stream_smoothed(spark, d):
    stream, path = _stream(spark, d)
    with live.rocksdb(spark):
        live.write_batches(live.smoothed(stream.select("user_id", "ts", "value"), "user_id", 0.3), f"{path}/out", f"{path}/ck", "append")
    found = spark.read.parquet(f"{path}/out")
    return found.groupBy(F.col("key").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("smoothed"), 5).alias("highest"), F.round(F.sum("smoothed"), 3).alias("total"))


@query("stream_alerts", """select event_id, event_type as metric, r as rule, event_type || ' triggered alert: ' || case when value = floor(value) then value::bigint::varchar else value::varchar end as message
 from (select *, unnest(case event_type when 'view' then case when value >= 150 then ['high view'] else [] end when 'click' then list_concat(case when value <= 5 then ['low click'] else [] end, case when value < 2 or value > 200 then ['odd click'] else [] end) else [] end) as r from events)""")
def stream_alerts(spark, d):
    rules = spark.createDataFrame(_RULES, "metric string, rule string, kind string, low double, high double")
    stream, path = _stream(spark, d)
    live.write_batches(live.alert_rows(stream.withColumnRenamed("event_type", "metric"), rules, "event_id"), f"{path}/out", f"{path}/ck", "append")
    return spark.read.parquet(f"{path}/out").select("event_id", "metric", "rule", "message")


_KM = WITH + ", c as (select g, t, count(*) as c, count(*) filter (where e) as d, count(*) filter (where cause = 1) as d1, count(*) filter (where cause = 2) as d2 from survival group by g, t), n as (select *, sum(c) over (partition by g order by t desc)::bigint as n from c)"


@query("kaplan_meier", _KM + " select g, t::double as time, n as at_risk, d as events, round(product(1 - d / n) over (partition by g order by t), 6) as survival from n")
def kaplan_meier(spark, d):
    return rounded(survival.kaplan_meier(frames.survival(spark, d), "t", F.col("e"), "g"))


@query("log_rank", WITH + ", c as (select t, count(*) c, count(*) filter (where g = 'F') c1, count(*) filter (where e) d, count(*) filter (where e and g = 'F') d1 from survival group by t), n as (select *, sum(c) over (order by t desc)::double n, sum(c1) over (order by t desc)::double n1 from c) select round(pow(sum(d1 - d * n1 / n), 2) / sum(d * (n - d) * (n1 / n) * (1 - n1 / n) / greatest(n - 1, 1)), 5) as chi2 from n where d > 0")
def log_rank(spark, d):
    return rounded(survival.log_rank(frames.survival(spark, d), "t", F.col("e"), "g", "F", "O"), 5)


@query("competing_risks", _KM + ", s as (select *, product(1 - d / n) over (partition by g order by t) as s from n), p as (select *, coalesce(lag(s) over (partition by g order by t), 1) as p from s) select g, t::double as time, n as at_risk, round(s, 6) as survival, round(sum(p * d1 / n) over (partition by g order by t), 6) as cif_1, round(sum(p * d2 / n) over (partition by g order by t), 6) as cif_2 from p")
def competing_risks(spark, d):
    return rounded(survival.competing_risks(frames.survival(spark, d), "t", "cause", [1, 2], "g"))


@query("cox_loglik_beta0", WITH + ", c as (select t, count(*) c, count(*) filter (where e) d from survival group by t), n as (select d, sum(c) over (order by t desc) n from c) select round(sum(-d * ln(n)), 2) as ll from n where d > 0")
def cox_loglik_beta0(spark, d):
    rows = frames.survival(spark, d).withColumn("x", (F.col("g") == "F").cast("double"))
    return rounded(survival.cox_log_likelihood(rows, "t", F.col("e"), ["x"], [0.0]), 2)


@query("cox_ph")
def cox_ph(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("t"), (F.col("l_returnflag") != "N").alias("e"), (F.col("l_linestatus") == "F").cast("double").alias("x1"), F.col("l_discount").alias("x2"))
    found = survival.cox(rows, "t", F.col("e"), ["x1", "x2"])
    return spark.createDataFrame([(n, float(b), float(s), found["converged"]) for n, b, s in zip(("x1", "x2"), found["beta"], found["se"], strict=True)], "covariate string, beta double, se double, converged boolean")
