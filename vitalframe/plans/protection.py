"""Queries of anonymity, noise, federated averages, rules, consent and retention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.operators import compliance, guard, privacy
from vitalframe.plans.frames import WITH, patients, table, updates
from vitalframe.plans.registry import query
from vitalframe.plans.statistics import rounded

_QI = ["c_nationkey", "c_mktsegment"]


def _people(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 2500).alias("bucket"))


@query("k_anonymity", "select min(n) as k from (select count(*) as n from customer group by c_nationkey, c_mktsegment)")
def k_anonymity(spark, d):
    return privacy.k_anonymity(_people(spark, d), _QI)


@query("l_diversity", "select min(n) as l from (select count(distinct floor(c_acctbal / 2500)) as n from customer group by c_nationkey, c_mktsegment)")
def l_diversity(spark, d):
    return privacy.l_diversity(_people(spark, d), _QI, "bucket")


@query("t_closeness", """with p as (select c_nationkey a, c_mktsegment b, floor(c_acctbal / 2500) s from customer), g as (select s, count(*) / (select count(*) from p) as q from p group by s),
 c as (select distinct a, b from p), f as (select a, b, g.s, q, (select count(*) from p where p.a = c.a and p.b = c.b and p.s = g.s) / (select count(*) from p where p.a = c.a and p.b = c.b) as r from c, g)
 select round(max(t), 6) as t from (select sum(abs(r - q)) / 2 as t from f group by a, b)""")
def t_closeness(spark, d):
    return rounded(privacy.t_closeness(_people(spark, d), _QI, "bucket"))


@query("rr_debias", "select event_type, round(least(greatest((avg((value > 100)::int) - (1 - exp(1.0) / (exp(1.0) + 1))) / (2 * exp(1.0) / (exp(1.0) + 1) - 1), 0), 1), 6) as share from events group by 1")
def rr_debias(spark, d):
    seen = table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 100).cast("int")).alias("o"))
    return rounded(seen.select("event_type", privacy.debiased_share("o", 1.0).alias("share")))


_FLAT = "(select vec_id, label, unnest(embedding)::double as w, unnest(range(len(embedding)))::int as pos from embeddings)"


@query("fedavg", f"select label::bigint as round, pos, round(sum(w * (label + 1)) / sum(label + 1), 6) as weight from {_FLAT} group by 1, 2")
def fedavg(spark, d):
    found = privacy.aggregate_round(updates(spark, d), "round", "client", "weights", "examples")
    return rounded(found.withColumn("round", F.col("round").cast("long")))


@query("secure_sum", f"select pos, round(sum(w), 3) as total from {_FLAT} group by 1")
def secure_sum(spark, d):
    return rounded(privacy.secure_sum(updates(spark, d), "client", "weights"), 3)


@query("laplace_sum")
def laplace_sum(spark, d):
    return privacy.private_sum(table(spark, d, "events"), "value", 1.0, 1.0, clip=(0.0, 500.0), seed=1)


@query("private_histogram")
def private_histogram(spark, d):
    return privacy.private_histogram(table(spark, d, "events"), "event_type", 1.0, seed=1)


_WORDS = {"contact": ["phone", "email"], "identity": ["ssn", "passport"], "licence": ["license", "copyright"]}


@query("hipaa_keywords", "select rule, count(*) as total, count(*) filter (where k is null) as passed, count(k) as failed from (" + " union all ".join(
    f"select '{r}' as rule, case " + " ".join(f"when contains(lower(text), '{w}') then '{w}'" for w in ws) + " end as k from documents" for r, ws in _WORDS.items()) + ") group by rule")
def hipaa_keywords(spark, d):
    return compliance.summarize(compliance.keyword_results(table(spark, d, "documents"), "text", _WORDS), "rule")


_RULES = {
    "k_over_50": ("Error", {"GreaterThan": {"path": "k", "value": 50}}), "k_exists": ("Info", {"Exists": {"path": "k", "should_exist": True}}),
    "low_or_seven": ("Warning", {"Or": [{"LessThan": {"path": "k", "value": 20}}, {"Regex": {"path": "k", "pattern": "7"}}]}), "not_42": ("Warning", {"Not": {"Equals": {"path": "k", "value": 42}}}),
}
_K = "try_cast(json_extract_string(props, '$.k') as double)"
_CHECKS = {"k_over_50": ("Error", f"coalesce({_K} > 50, false)"), "k_exists": ("Info", f"{_K} is not null"), "low_or_seven": ("Warning", f"coalesce({_K} < 20, false) or coalesce(json_type(props, '$.k') = 'VARCHAR' and contains(json_extract_string(props, '$.k'), '7'), false)"), "not_42": ("Warning", f"coalesce({_K} <> 42, true)")}
_RESULTS = " union all ".join(f"select event_id, '{k}' as rule, '{s}' as severity, {c} as passed from events" for k, (s, c) in _CHECKS.items())


@query("rule_engine", _RESULTS)
def rule_engine(spark, d):
    return compliance.evaluate_rules(table(spark, d, "events"), "props", _RULES, "event_id")


@query("compliance_summary", f"select rule, count(*) as total, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed from ({_RESULTS}) group by rule")
def compliance_summary(spark, d):
    return compliance.summarize(rule_engine(spark, d), "rule")


@query("severity_counts", f"select s as severity, count(passed) as failed from (values ('Info'), ('Warning'), ('Error')) v(s) left join ({_RESULTS}) on severity = s and not passed group by s")
def severity_counts(spark, d):
    return compliance.failed_by_severity(rule_engine(spark, d))


@query("deid_mask_hash_redact", "select c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) as masked, sha256(c_name) as hashed, '[REDACTED]' as redacted from customer")
def deid_mask_hash_redact(spark, d):
    return table(spark, d, "customer").select("c_custkey", *[compliance.deidentify("c_name", f"phi.{t}").alias(n) for t, n in (("mask", "masked"), ("hash", "hashed"), ("redact", "redacted"))])


@query("consent", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING' and c_custkey % 3 <> 0 and (c_custkey % 5 <> 0 or c_custkey % 2 = 0))")
def consent(spark, d):
    c = F.col("c_custkey")
    consents = table(spark, d, "customer").select(
        c.alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "Revoked").otherwise("Active").alias("status"),
        F.when((c % 5 == 0) & (c % 2 == 1), "2020-01-01").when(c % 2 == 0, "2030-01-01").alias("expires_at"), F.when(c % 3 == 0, F.array(F.lit("care"))).otherwise(F.array(F.lit("care"), F.lit("research"))).alias("scopes"),
    )
    return compliance.with_consent(table(spark, d, "orders"), consents, "o_custkey", "research", "2025-01-01").select("o_orderkey")


_RETENTION = "select event_id, case when value between 0 and 50 then 'Retain' when value between 30 and 150 then 'Archive' when value >= 150 then 'Delete' else 'None' end as action from events"
_POLICIES = [("Retain", 0, 50), ("Archive", 30, 150), ("Delete", 150, None)]


@query("retention", _RETENTION)
def retention(spark, d):
    return compliance.retention(table(spark, d, "events"), "value", _POLICIES).select("event_id", "action")


@query("retention_range_join", _RETENTION)
def retention_range_join(spark, d):
    rows = [(i, a, float(low), None if high is None else float(high)) for i, (a, low, high) in enumerate(_POLICIES)]
    policies = spark.createDataFrame(rows, "priority int, action string, low double, high double")
    return compliance.retention_join(table(spark, d, "events").select("event_id", "value"), "value", policies).select("event_id", F.coalesce("action", F.lit("None")).alias("action"))


@query("privacy_guard", WITH + "select id, '[REDACTED]' as name, length(id)::int as n, count(*) over (partition by length(id)) as same from patients")
def privacy_guard(spark, d):
    people = guard.labelled(patients(spark, d), family_name="PHI", given_name="PHI", birth_date="PHI")
    safe = guard.derive(people, "name", compliance.redacted("family_name"), "family_name", deidentified="Anonymized")
    # Columns made from labelled ones, under new names, by an expression, a window and a join: the guard finds them all.
    named = safe.groupBy("id").agg(F.max(F.upper("family_name")).alias("shout"))
    made = safe.withColumn("born", F.substring("birth_date", 1, 4)).withColumn("n", F.length("id")).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("n")))
    made = made.join(named, "id").withColumn("pair", F.struct("n", "given_name"))
    return made.drop(*guard.violations(made, "file"))
