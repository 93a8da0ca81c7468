"""Queries of typed rules with evidence and of the HIPAA bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.operators import compliance
from vitalframe.plans.frames import table
from vitalframe.plans.protection import _WORDS
from vitalframe.plans.registry import query

#: A document a customer whose `code` is a number, a text of digits, null, an array, another text, or missing.
_DOC = """select c_custkey, '{"id":' || c_custkey || ',"name":{"given":["' || c_mktsegment || '"]}' || case c_custkey % 6 when 0 then ',"code":' || (c_custkey % 10) when 1 then ',"code":"' || (c_custkey % 10) || '"'
 when 2 then ',"code":null' when 3 then ',"code":[' || (c_custkey % 10) || ',"x"]' when 4 then ',"code":"[x] ' || repeat('long ', 14) || '"' else '' end || '}' as doc from customer"""
_RULES = {
    "over_4": ("Error", {"GreaterThan": {"path": "code", "value": 4}}),
    "is_6": ("Info", {"Equals": {"path": "code", "value": 6}}),
    "is_text_7": ("Info", {"Equals": {"path": "code", "value": "7"}}),
    "there": ("Warning", {"Exists": {"path": "code", "should_exist": True}}),
    "holds_x": ("Warning", {"Contains": {"path": "code", "item": "x"}}),
    "digit": ("Info", {"Regex": {"path": "code", "pattern": "[0-9]"}}),
    "filled": ("Info", {"NonEmpty": {"path": "code"}}),
    "and_or": ("Error", {"And": [{"Equals": {"path": "name.given[0]", "value": "BUILDING"}}, {"Or": [{"LessThan": {"path": "code", "value": 5}}, {"Not": {"Contains": {"path": "code", "item": "x"}}}]}]}),
}
_EVIDENCE_SQL = f"""
with d as (select c_custkey as key, doc, json_type(doc, '$.code') as t, json_extract(doc, '$.code')::varchar as j, json_extract_string(doc, '$.code') as x, json_extract_string(doc, '$.name.given[0]') as g from ({_DOC})),
e as (select *, 'code' || coalesce('=' || case when t = 'VARCHAR' then case when length(x) > 64 then left(x, 64) || '…' else x end else j end, '') as c, t = 'UBIGINT' as num, coalesce(t = 'VARCHAR', false) as txt from d),
f as (select *, coalesce(case when t = 'ARRAY' then contains(j, '"x"') when txt then contains(x, 'x') end, false) as has_x, coalesce(num and try_cast(x as double) < 5, false) as low, g = 'BUILDING' as b, 'name.given[0]=' || g as n from e),
r as (
 select key, 'over_4' as rule, 'Error' as severity, coalesce(num and try_cast(x as double) > 4, false) as passed, c as ev from f
 union all select key, 'is_6', 'Info', coalesce(num and x = '6', false), c from f
 union all select key, 'is_text_7', 'Info', coalesce(txt and x = '7', false), c from f
 union all select key, 'there', 'Warning', t is not null, c from f
 union all select key, 'holds_x', 'Warning', has_x, c from f
 union all select key, 'digit', 'Info', coalesce(txt and regexp_matches(x, '[0-9]'), false), c from f
 union all select key, 'filled', 'Info', t is not null, c from f
 union all select key, 'and_or', 'Error', b and (low or not has_x), case when not b then n when low or not has_x then n || ', ' || c else n || ', ' || c || ', ' || c end from f)
select key, rule, severity, passed, ev as evidence, case when not passed then 'Rule ''' || rule || ''' failed (severity: ' || severity || '); evidence: ' || ev end as message from r"""


def _documents(spark, d):
    c = F.col("c_custkey")
    digit = (c % 10).cast("string")
    code = F.when(c % 6 == 0, F.concat(F.lit(',"code":'), digit)).when(c % 6 == 1, F.concat(F.lit(',"code":"'), digit, F.lit('"'))).when(c % 6 == 2, F.lit(',"code":null'))
    code = code.when(c % 6 == 3, F.concat(F.lit(',"code":['), digit, F.lit(',"x"]'))).when(c % 6 == 4, F.concat(F.lit(',"code":"[x] '), F.repeat(F.lit("long "), F.lit(14)), F.lit('"'))).otherwise("")
    doc = F.concat(F.lit('{"id":'), c.cast("string"), F.lit(',"name":{"given":["'), F.col("c_mktsegment"), F.lit('"]}'), code, F.lit("}"))
    return table(spark, d, "customer").select(c.alias("key"), doc.alias("doc"))


@query("rule_evidence", _EVIDENCE_SQL)
def rule_evidence(spark, d):
    found = compliance.evaluate_rules(_documents(spark, d), "doc", _RULES, "key", evidence=True)
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e["path"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("")))), ", "))


_PACK = [{"id": k, "description": k, "severity": "Error", "keywords": w} for k, w in _WORDS.items()]
_FOUND = ", ".join("case " + " ".join(f"when contains(lower(text), '{w}') then '{w}'" for w in ws) + f" end as {r}" for r, ws in _WORDS.items())


@query("hipaa_bundle", f"""
with k as (select doc_id, n_chars, {_FOUND} from documents),
r as (select *, doc_id % 4 <> 0 as given, doc_id % 3 <> 0 and doc_id % 5 <> 0 as held, case when n_chars <= 500 then 'Retain' when n_chars between 300 and 2000 then 'Anonymize' when n_chars >= 9000 then 'Delete' end as a from k),
s as (select *, 3 + given::int + (a is not null)::int as total, (contact is null)::int + (identity is null)::int + (licence is null)::int + (given and held)::int + coalesce(a <> 'Delete', false)::int as passed from r)
select doc_id, (not given or held) as consent_ok, a as retention_action, total::int as total, passed::int as passed, (total - passed)::int as failed,
 'HIPAA keyword rule ''contact'' (severity: Error) matched keyword: ' || contact as message from s""")
def hipaa_bundle(spark, d):
    c = F.col("doc_id")
    scope = lambda r, a: F.struct(F.lit(r).alias("resource"), F.lit(a).alias("action"))
    scopes = F.when(c % 5 == 0, F.array(scope("note", "write"))).otherwise(F.array(scope("note", "write"), scope("note", "read")))
    consent = F.struct(F.when(c % 3 == 0, "Revoked").otherwise("Active").alias("status"), F.lit(None).cast("string").alias("expires_at"), scopes.alias("scopes"))
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars", F.when(c % 4 != 0, consent).alias("consent"))
    policies = [("Retain", 0, 500), ("Anonymize", 300, 2000), ("Delete", 9000, None)]
    found = compliance.hipaa_bundle(docs, "text", _PACK, "consent", "note", "read", "n_chars", policies)
    return found.select("doc_id", "report.consent_ok", "report.retention_action", "report.overall.*", F.col("report.keyword_results")[0]["message"].alias("message"))
