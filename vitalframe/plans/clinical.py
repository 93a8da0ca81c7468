"""Queries of the builder, clean-up, validation, joins and terminology."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.functions import units
from vitalframe.operators import linking, sanitize, terminology, validate
from vitalframe.operators.query import Predicate, Query
from vitalframe.plans import registry
from vitalframe.plans.frames import WITH, observations, patients, table
from vitalframe.plans.registry import query

registry.FLAGSHIP = "query_or_groups"
_OBS = "select id, code, value from observations where "


@query("query_or_groups", WITH + _OBS + "(lower(code) = 'purchase' and value >= 100) or id = '7'")
def query_or_groups(spark, d):
    return Query("Observation").eq_ci("code", "PURCHASE").ge("value", 100).or_group().eq("id", "7").run(observations(spark, d)).select("id", "code", "value")


@query("query_eq", WITH + _OBS + "code = 'click'")
def query_eq(spark, d):
    return Query("Observation").eq("code", "click").run(observations(spark, d)).select("id", "code", "value")


@query("query_between", WITH + _OBS + "value between 10 and 20 and value < 19.5 and value > 10.5")
def query_between(spark, d):
    return Query("Observation").between("value", 10, 20).lt("value", 19.5).gt("value", 10.5).run(observations(spark, d)).select("id", "code", "value")


@query("query_contains_ci", WITH + "select id, family_name from patients where contains(lower(family_name), '00012') and given_name = 'BUILDING'")
def query_contains_ci(spark, d):
    return Query("Patient").family_name_contains("00012").given_name_is("building").run(patients(spark, d)).select("id", "family_name")


@query("query_dates", WITH + "select id, birth_date from patients where replace(birth_date, '-', '') between '19500101' and '19601231'")
def query_dates(spark, d):
    return Query("Patient").date_ge("birth_date", "1950-01-01").date_le("birth_date", "19601231").run(patients(spark, d)).select("id", "birth_date")


@query("query_any_in_group", WITH + _OBS + "(code = 'view' or contains(code, 'ign')) and value > 50")
def query_any_in_group(spark, d):
    either = Predicate("eq", "code", "view"), Predicate("contains", "code", "ign")
    return Query("Observation").any(*either).gt("value", 50).run(observations(spark, d)).select("id", "code", "value")


@query("query_any_resource", WITH + "select 'Patient' as resource_type, id from patients where id = '12' union all select 'Observation', id from observations where id = '12' and value >= 0")
def query_any_resource(spark, d):
    people = patients(spark, d).withColumn("resource_type", F.lit("Patient"))
    both = people.unionByName(observations(spark, d).drop("subject", "ts").withColumn("resource_type", F.lit("Observation")), allowMissingColumns=True)
    # Keys that a resource lacks are ignored for it, so one value test can ride along.
    for name in ("description", "start_date", "form", "subject", "performed_date", "clinical_status", "verification_status", "class", "end_date"):
        both = both.withColumn(name, F.lit(None).cast("string"))
    return Query("Any").eq("id", "12").ge("value", 0).run(both).select("resource_type", "id")


@query("sanitize_observations", WITH + """select id, upper(trim(code)) as code,
 case lower(trim(unit)) when 'beats/min' then 'bpm' else lower(trim(unit)) end as unit from observations""")
def sanitize_observations(spark, d):
    return sanitize.observations(observations(spark, d)).select("id", "code", "unit")


@query("sanitize_patients", WITH + "select id, trim(family_name) as family_name, replace(birth_date, '-', '') as birth_date from patients")
def sanitize_patients(spark, d):
    return sanitize.patients(patients(spark, d)).select("id", "family_name", "birth_date")


@query("validate_patient", WITH + """select error, count(*) as n from (select case when right(birth_date, 2) = '31' and length(birth_date) = 8 then null
 when length(birth_date) not in (8, 10) then 'birth_date is not a date' end as error from patients) group by error""")
def validate_patient(spark, d):
    return validate.validate(patients(spark, d), "Patient").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("validate_observation", WITH + """select error, count(*) as n from (
 select case when code = 'HR' and coalesce(u, '') <> 'bpm' then 'HR needs bpm' when code = 'TEMP' and coalesce(u, '') not in ('c', 'f') then 'TEMP needs c or f'
   when value > 480 then 'value is not finite' end as error
 from (select case code when 'view' then 'HR' when 'error' then 'TEMP' when 'click' then 'HR' else upper(code) end as code, value, lower(trim(unit)) as u from observations)) group by error""")
def validate_observation(spark, d):
    coded = observations(spark, d).withColumns({
        "code": F.when(F.col("code").isin("view", "click"), "HR").when(F.col("code") == "error", "TEMP").otherwise(F.upper("code")),
        "value": F.when((F.col("value") > 480) & ~F.col("code").isin("click"), F.lit(float("inf"))).otherwise(F.col("value")),
    })
    return validate.validate(coded, "Observation").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("bundle_duplicate_ids", """with s as (select o_custkey as bundle, o_orderpriority as id, count(*) as n, min(o_orderkey) as f from orders group by all),
 l as (select o.o_custkey as bundle, o.o_orderpriority as id, o.o_orderkey as k from orders o join s on s.bundle = o.o_custkey and s.id = o.o_orderpriority where s.n > 1 and o.o_orderkey > s.f)
 select bundle, arg_min(id, k) as id, min(k) as k from l group by bundle""")
def bundle_duplicate_ids(spark, d):
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderpriority").alias("id"), F.col("o_orderkey").alias("k"))
    return validate.duplicate_ids(entries, "bundle", "k")


@query("link_conditions_encounters", """with e as (select o_custkey, min(o_orderkey) as encounter from orders group by 1)
 select c_custkey as subject, c_mktsegment as code, encounter from customer left join e on o_custkey = c_custkey""")
def link_conditions_encounters(spark, d):
    conditions = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("code"))
    encounters = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("k"))
    return linking.link_first(conditions, encounters, "subject", ["k"], {"k": "encounter"}).select("subject", "code", "encounter")


@query("omop_upsert_latest", """select o_custkey as person_id, max(o_orderkey) as k, arg_max(o_orderpriority, o_orderkey) as visit from orders group by 1""")
def omop_upsert_latest(spark, d):
    visits = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("visit"))
    return linking.latest(visits, "person_id", ["k"])


@query("omop_person_visits", "select o_orderkey as visit_id, o_custkey as person_id from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def omop_person_visits(spark, d):
    people = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("person_id"))
    visits = table(spark, d, "orders").select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("person_id"))
    return linking.of_person(visits, people).select("visit_id", "person_id")


@query("fhir_to_omop", WITH + "select id::bigint as person_id, left(birth_date, 4)::integer as year_of_birth, 0 as gender_concept_id from patients")
def fhir_to_omop(spark, d):
    return linking.to_omop_person(patients(spark, d))


@query("concept_validity", WITH + "select id, replace(birth_date, '-', '') <= '19700101' and length(birth_date) = 10 as valid from patients")
def concept_validity(spark, d):
    return patients(spark, d).select("id", linking.concept_valid("birth_date", F.lit("2099-12-31"), F.lit("1970-01-01")).alias("valid"))


@query("diagnostic_reports", WITH + "select subject, list_sort(list(distinct code))::varchar as codes from observations group by subject")
def diagnostic_reports(spark, d):
    found = linking.diagnostic_reports(observations(spark, d))
    return found.select("subject", F.concat(F.lit("["), F.array_join("result_codes", ", "), F.lit("]")).alias("codes"))


_LOINC = "(values " + ", ".join(f"({i}, '{r[0]}', '{r[2]}', '{terminology.LOINC_TO_SNOMED[r[0]]}')" for i, r in enumerate(terminology.LOINC)) + ") as t(i, code, component, snomed)"


@query("loinc_to_snomed", f"select event_id, code, snomed, component from events left join {_LOINC} on user_id % 12 = i")
def loinc_to_snomed(spark, d):
    codes = F.array(*[F.lit(r[0]) for r in terminology.LOINC])
    events = table(spark, d, "events").select("event_id", F.get(codes, (F.col("user_id") % 12).cast("int")).alias("code"))
    named = terminology.described(events, "code", terminology.loinc(spark).select("code", "component"))
    return named.select("event_id", "code", terminology.loinc_to_snomed("code").alias("snomed"), "component")


_ICD = "(values " + ", ".join("({}, '{}', '{}', {}, '{}')".format(i, r[0], r[1], f"'{r[3]}'" if r[3] else "null", r[2]) for i, r in enumerate(terminology.ICD)) + ") as t(i, code, description, parent, category)"
_CODED = f"coded as (select event_id, code, description, parent, category from events join {_ICD} on user_id % {len(terminology.ICD)} = i)"


def _coded(spark, d):
    """Events with an ICD code each."""
    codes = F.array(*[F.lit(r[0]) for r in terminology.ICD])
    return table(spark, d, "events").select("event_id", F.get(codes, (F.col("user_id") % len(terminology.ICD)).cast("int")).alias("code"))


@query("icd_hierarchy", f"with {_CODED} select event_id, c.code, c.parent, t.description as parent_description from coded c left join {_ICD} on c.parent = t.code")
def icd_hierarchy(spark, d):
    return _coded(spark, d).join(terminology.parents(terminology.icd(spark)), "code").select("event_id", "code", "parent", "parent_description")


@query("icd_children", f"with {_CODED} select event_id, c.code, t.code as child, t.description as child_description from coded c join {_ICD} on t.parent = c.code")
def icd_children(spark, d):
    return _coded(spark, d).join(terminology.children(terminology.icd(spark)), "code").select("event_id", "code", "child", "child_description")


@query("term_search", f"with {_CODED} select event_id, code, description from coded where contains(lower(description), 'diabetes')")
def term_search(spark, d):
    return _coded(spark, d).join(terminology.search(terminology.icd(spark), "description", "DIABETES").select("code", "description"), "code").select("event_id", "code", "description")


@query("term_search_by_category", f"with {_CODED} select event_id, code from coded where contains(lower(description), 'e') and lower(category) = lower('{terminology.ICD[0][2]}')")
def term_search_by_category(spark, d):
    found = terminology.search_terms(terminology.icd(spark), "E", category=terminology.ICD[0][2])
    return terminology.known(_coded(spark, d), "code", found)


@query("known_codes", f"select event_id, 'A0' || (user_id % 4) as code from events where 'A0' || (user_id % 4) in (select code from {_ICD})")
def known_codes(spark, d):
    events = table(spark, d, "events").select("event_id", F.concat(F.lit("A0"), (F.col("user_id") % 4).cast("string")).alias("code"))
    return terminology.known(events, "code", terminology.icd(spark)).select("event_id", "code")


@query("code_errors", """select p_partkey, case when octet_length(encode(p_brand)) not between 3 and 7 then 'code must have 3 to 7 bytes' end as icd10,
 case when not regexp_matches(p_partkey::varchar, '^[0-9]{5,18}$') then 'not a SNOMED code' end as snomed from part""")
def code_errors(spark, d):
    coded = table(spark, d, "part").withColumn("key", F.col("p_partkey").cast("string"))
    return coded.select("p_partkey", validate.icd10_error("p_brand").alias("icd10"), validate.snomed_error("key").alias("snomed"))


@query("contraindicated_pairs", """select a.c_custkey as a, b.c_custkey as b from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_custkey < b.c_custkey
 where least(a.c_mktsegment, b.c_mktsegment) = 'BUILDING' and greatest(a.c_mktsegment, b.c_mktsegment) = 'MACHINERY'""")
def contraindicated_pairs(spark, d):
    known = spark.createDataFrame([("machinery", "building")], "x string, y string")
    return terminology.contraindicated_within(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_mktsegment", known).select("a", "b")


@query("unit_convert", "select l_orderkey, round(l_quantity * case l_returnflag when 'A' then 1000.0 when 'R' then 0.001 end, 6) as mg from lineitem")
def unit_convert(spark, d):
    source = F.when(F.col("l_returnflag") == "A", "g").when(F.col("l_returnflag") == "R", "ug").otherwise("mL")
    return table(spark, d, "lineitem").select("l_orderkey", F.round(units.convert("l_quantity", source, F.lit("mg")), 6).alias("mg"))
