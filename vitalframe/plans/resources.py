"""Queries of resources with faulty rows, code systems, stores and predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitalframe.functions.shared import shared_dir
from vitalframe.operators import models, stats, validate
from vitalframe.operators.query import Query, series_by_code
from vitalframe.plans.frames import table
from vitalframe.plans.registry import query
from vitalframe.sources import genomics, ndjson, omop

_KINDS = ["Patient", "Observation", "MedicalEvent", "Medication", "Procedure", "Condition", "Encounter", "DiagnosticReport"]
#: Rows of all resources out of the orders; every field is faulty in some.
_FRAME = """r as (select o_orderkey as k, case o_orderkey % 8 """ + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_KINDS)) + """ end as resource_type, case when k1 = 0 then ' ' else o_orderkey::varchar end as id,
 case when k1 = 1 then '' else 'HR' end as code, case when k1 = 2 then null else 's' end as subject, case when k1 = 3 then '2020-13-01' else '20200131' end as day, case when k1 = 4 then 'x' else '2020-02-30' end as day2, case when k1 = 5 then ' ' else 'active' end as status,
 case when k1 = 6 then 'mmHg' else ' BPM' end as unit, k1 from (select *, (o_orderkey // 8) % 10 as k1 from orders))"""


def _frame(spark, d):
    k = F.col("o_orderkey")
    k1 = F.floor(k / 8) % 10
    day, code, status = F.when(k1 == 3, "2020-13-01").otherwise("20200131"), F.when(k1 == 1, "").otherwise("HR"), F.when(k1 == 5, " ").otherwise("active")
    name = F.when(k1 == 7, None).otherwise("N")
    return table(spark, d, "orders").select(
        k.alias("k"), F.get(F.array(*map(F.lit, _KINDS)), (k % 8).cast("int")).alias("resource_type"), F.when(k1 == 0, " ").otherwise(k.cast("string")).alias("id"), code.alias("code"), F.when(k1 != 2, "s").alias("subject"),
        name.alias("given_name"), F.lit("").alias("family_name"), day.alias("birth_date"), day.alias("start_date"), F.when(k1 == 4, "x").otherwise("2020-02-30").alias("end_date"), day.alias("performed_date"),
        status.alias("clinical_status"), F.lit("confirmed").alias("verification_status"), F.when(k1 == 8, float("nan")).otherwise(1.0).alias("value"), F.when(k1 == 6, "mmHg").otherwise(" BPM").alias("unit"),
        F.when(k1 == 9, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("ingredients"),
    )


@query("validate_resources", f"""with {_FRAME} select k, case
 when k1 = 0 then 'id is empty'
 when resource_type = 'Patient' then case k1 when 7 then 'name is empty' when 3 then 'birth_date is not a date' end
 when resource_type in ('Observation', 'MedicalEvent', 'Medication', 'Procedure', 'Condition', 'DiagnosticReport') and k1 = 1 then 'code is empty'
 when resource_type = 'Observation' then case k1 when 8 then 'value is not finite' when 6 then 'HR needs bpm' end
 when resource_type = 'MedicalEvent' then case k1 when 3 then 'start_date is not a date' end
 when resource_type = 'Medication' then case k1 when 9 then 'an ingredient is empty' end
 when resource_type = 'Procedure' then case k1 when 2 then 'subject is empty' when 3 then 'performed_date is not a date' end
 when resource_type = 'Condition' then case k1 when 5 then 'clinical_status is empty' when 2 then 'subject is empty' end
 when resource_type = 'Encounter' then case k1 when 3 then 'start_date is not a date' when 4 then 'end_date is not a date' when 2 then 'subject is empty' end
 when resource_type = 'DiagnosticReport' then case k1 when 2 then 'subject is empty' end end as error from r""")
def validate_resources(spark, d):
    return validate.validate_any(_frame(spark, d)).select("k", "error")


@query("query_medical_events", f"with {_FRAME} select k from r where resource_type = 'MedicalEvent' and code = 'HR' and replace(day, '-', '') >= '20200201'")
def query_medical_events(spark, d):
    rows = _frame(spark, d).filter("resource_type = 'MedicalEvent'")
    return Query("MedicalEvent").eq("code", "HR").date_ge("start_date", "2020-02-01").run(rows).select("k")


@query("series_by_code", f"with {_FRAME} select k from r where resource_type = 'Observation' and code = 'HR' and k1 <> 8")
def series_by_code_(spark, d):
    return series_by_code(_frame(spark, d).filter("resource_type = 'Observation'"), "HR").select("k")


@query("code_system_errors", r"""with p as (select p_partkey, case p_partkey % 5 when 0 then p_partkey || '-1' when 1 then ' ' when 2 then upper(substr(p_type, 1, 4)) when 3 then lower(p_brand) else repeat('Q', 9) end as c, p_type from part)
 select p_partkey, case when trim(c) = '' then 'code is empty' when octet_length(encode(c)) not between 3 and 8 then 'code must have 3 to 8 bytes' when not regexp_matches(c, '^[A-Z]') then 'code must begin with A-Z' end as icd11,
 case when not regexp_matches(c, '^[0-9]{4,5}-[0-9]$') then 'not a LOINC code' end as loinc, case when trim(p_type) = '' then 'text is empty' when octet_length(encode(p_type)) > 20 then 'text is over 20 bytes' end as text from p""")
def code_system_errors(spark, d):
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("-1"))).when(k % 5 == 1, " ").when(k % 5 == 2, F.upper(F.substring("p_type", 1, 4))).when(k % 5 == 3, F.lower("p_brand")).otherwise("QQQQQQQQQ")
    rows = table(spark, d, "part").select(k, code.alias("c"), "p_type")
    return rows.select("p_partkey", validate.icd11_error("c").alias("icd11"), validate.loinc_error("c").alias("loinc"), validate.text_error("p_type", 20).alias("text"))


_PROFILES = '[{"name": "Named", "resource_type": "Patient", "required_fields": ["id", "given_name"], "cardinality": {"ingredients": [1, 1]}}]'


@query("profile_loaded", f"with {_FRAME} select k, case when k1 = 0 then 'id is empty' when k1 = 7 then 'given_name is missing' when k1 = 9 then 'ingredients has a wrong number of elements' end as error from r where resource_type = 'Patient'")
def profile_loaded(spark, d):
    profile = validate.load_profiles(_PROFILES)[0]
    rows = _frame(spark, d).filter("resource_type = 'Patient'").withColumn("value", F.lit(1.0))
    return validate.validate_against(rows, "Patient", profile).select("k", "error")


@query("sam_header", "select case p_partkey % 3 when 0 then 'SQ' else 'RG' end as kind, case p_partkey % 3 when 0 then p_name end as sn, case p_partkey % 3 when 0 then p_size::varchar end as ln, case p_partkey % 3 when 1 then p_partkey::varchar end as id from part where p_partkey % 3 < 2")
def sam_header(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("@SQ\tSN:"), "p_name", F.lit("\tLN:"), F.col("p_size").cast("string"))).when(k % 3 == 1, F.concat(F.lit("@RG\tID:"), k.cast("string"))).otherwise(F.concat(F.lit("@CO\t"), "p_name"))
    found = genomics.bam_header(table(spark, d, "part").select(line.alias("value")))
    return found.select("kind", F.col("tags")["SN"].alias("sn"), F.col("tags")["LN"].alias("ln"), F.col("tags")["ID"].alias("id"))


@query("file_store", "select event_id, event_type, value from events where event_type in ('view', 'click')")
def file_store(spark, d):
    """Put by key, one key removed, then the keys that are left read one by one."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").filter("event_type in ('view', 'click', 'purchase')").select("event_id", "event_type", "value")
    ndjson.save_store(rows, path, "event_type")
    ndjson.remove_from_store(spark, path, "event_type", "purchase")
    keys = sorted(r[0] for r in ndjson.store_keys(spark, path, "event_type").collect())
    parts = [ndjson.load_store(spark, path, "event_id long, value double, event_type string", "event_type", k) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("event_id", "event_type", "value")


@query("predictions", "select l_orderkey, l_linenumber, round(l_quantity * 0.5 + 1, 6) as line, round(1 / (1 + exp(-(l_quantity * 0.1 - 2))), 6) as chance from lineitem")
def predictions(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(stats.linear_predict(q, 0.5, 1.0), 6).alias("line"), F.round(stats.logistic_probability(q, 0.1, -2.0), 6).alias("chance"))


@query("omop_json_roundtrip", "select o_orderkey as visit_occurrence_id, o_custkey as person_id, strftime(o_orderdate, '%Y-%m-%d') as visit_start_date, o_orderpriority as visit_source_value, o_orderkey % 7 <> 3 as complete from orders")
def omop_json_roundtrip(spark, d):
    """Visits out of the orders, as JSON and back; one in seven lacks its person, which makes the object null."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, d, "orders").select(
        k.cast("long").alias("visit_occurrence_id"), F.when(k % 7 != 3, F.col("o_custkey")).alias("person_id"), F.lit(9202).alias("visit_concept_id"), day.alias("visit_start_date"), day.alias("visit_end_date"),
        F.lit(44818518).alias("visit_type_concept_id"), F.col("o_orderpriority").alias("visit_source_value"), F.col("o_custkey").alias("true_person"),
    )
    back = rows.withColumn("v", omop.from_json(omop.to_json(rows, "VisitOccurrence"), "VisitOccurrence"))
    return back.select("visit_occurrence_id", F.col("true_person").alias("person_id"), F.coalesce("v.visit_start_date", "visit_start_date").alias("visit_start_date"), F.coalesce("v.visit_source_value", "visit_source_value").alias("visit_source_value"), F.col("v").isNotNull().alias("complete"))


@query("trial_welch", """with r as (select case when l_returnflag = 'A' then 'treatment' else 'control' end as g, l_quantity as x from lineitem where l_orderkey % 10 <> 3),
 s as (select avg(x) filter (where g = 'treatment') as ma, var_samp(x) filter (where g = 'treatment') / count(*) filter (where g = 'treatment') as a, count(*) filter (where g = 'treatment') as na,
  avg(x) filter (where g = 'control') as mb, var_samp(x) filter (where g = 'control') / count(*) filter (where g = 'control') as b, count(*) filter (where g = 'control') as nb from r)
 select round((ma - mb) / sqrt(a + b), 6) as t, round(pow(a + b, 2) / (a * a / (na - 1) + b * b / (nb - 1)), 3) as df from s""")
def trial_welch(spark, d):
    """A trial's lines of text, some of them broken, into Welch's test."""
    k = F.col("l_orderkey")
    group = F.when(F.col("l_returnflag") == "A", " treatment").otherwise("control ")
    line = F.when(k % 10 == 3, F.concat(group, F.lit(",n/a"))).otherwise(F.concat(group, F.lit(", "), F.col("l_quantity").cast("string")))
    lines = table(spark, d, "lineitem").select(line.alias("value")).unionByName(spark.createDataFrame([("group,outcome",), ("a,b,c",)], "value string"))
    found = stats.welch(omop.trial_lines(lines), "outcome", "group", "treatment", "control")
    return found.select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query("scaler_inverse", "select l_returnflag, count(*) as n, count(*) as same, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as sd from lineitem group by 1")
def scaler_inverse(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    back = rows.join(stats.scaler(rows, "l_quantity", "l_returnflag"), "l_returnflag").withColumn("x", stats.unscaled(stats.scaled("l_quantity", "mean", "sd"), "mean", "sd"))
    near = (F.abs(F.col("x") - F.col("l_quantity")) < 1e-9).cast("long")
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(near).alias("same"), F.round(F.first("mean"), 6).alias("mean"), F.round(F.first("sd"), 6).alias("sd"))


@query("patient_risks", """select event_id as id, 'sepsis' as condition, '30d' as timeframe, round(least(greatest(try_cast(json_extract_string(props, '$.k') as double), 0), 1), 6) as score, case when try_cast(json_extract_string(props, '$.k') as double) >= 0.7 then 'High' when try_cast(json_extract_string(props, '$.k') as double) >= 0.3 then 'Moderate' else 'Low' end as stratum, event_type as "group" from events""")
def patient_risks(spark, d):
    found = models.patient_risks(table(spark, d, "events"), "event_id", "props", "event_type", ["k", "none"], "sepsis", "30d")
    return found.withColumn("score", F.round("score", 6))
