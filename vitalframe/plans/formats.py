"""Queries that write clinical formats from the tables and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitalframe.functions.shared import shared_dir
from vitalframe.operators import validate
from vitalframe.plans.frames import WITH, observations, patients, table
from vitalframe.plans.registry import query
from vitalframe.sources import genomics, hl7, ndjson


def _messages(spark, d):
    p = patients(spark, d)
    head = F.lit("MSH|^~\\&|SRC|FAC|DST|HOSP|202501010101||ADT^A01|123|P|2.5\r")
    pid = F.concat(F.lit("PID|1|ALT|"), F.col("id"), F.lit("||"), hl7.escaped("family_name"), F.lit("^"), hl7.escaped("given_name"), F.lit("||"), F.replace("birth_date", F.lit("-"), F.lit("")), F.lit("|F\r"))
    obx = F.concat(F.lit("OBX|1|NM|HR^Heart Rate||"), F.col("id"), F.lit("|bpm\rOBX|2|ST|NOTE^Note||Normal||\r"))
    return p.select("id", F.concat(head, pid, obx).alias("message"))


@query("hl7_pid_roundtrip", WITH + "select id, family_name, given_name, case when length(birth_date) = 8 then left(birth_date, 4) || '-' || substr(birth_date, 5, 2) || '-' || right(birth_date, 2) else birth_date end as birth_date from patients")
def hl7_pid_roundtrip(spark, d):
    return hl7.patients(_messages(spark, d), "message")


@query("hl7_obx_roundtrip", WITH + "select id as message_id, '1' as id, 'HR' as code, id::double as value, 'bpm' as unit from patients union all select id, '2', 'NOTE', null, null from patients")
def hl7_obx_roundtrip(spark, d):
    return hl7.observations(_messages(spark, d).withColumnRenamed("id", "message_id"), "message", "message_id")


@query("hl7_header", WITH + "select id, 'ADT^A01' as type, '2.5' as version, timestamp '2025-01-01 01:01:00' as at from patients")
def hl7_header(spark, d):
    rows = _messages(spark, d).select("id", hl7.header(hl7.segments("message")).alias("h"))
    return rows.select("id", "h.type", "h.version", hl7.timestamp(F.col("h.timestamp")).cast("timestamp_ntz").alias("at"))


@query("hl7_generate", WITH + "select count(*) as n, count(*) as same from patients")
def hl7_generate(spark, d):
    rows = _messages(spark, d)
    again = hl7.generated(hl7.segments("message")) == F.col("message")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(again.cast("long")).alias("same"))


def _visits(spark, d):
    """Messages put together by the builders, with marks of their own for every second customer."""
    # Messages cost far more than the rows, of which a few Parquet splits hold all: these are dealt out before.
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name").repartition(spark.sparkContext.defaultParallelism)
    c = rows.select(F.col("c_custkey").alias("key"), F.col("c_custkey").cast("string").alias("k"), "c_mktsegment", "c_name")
    cut = F.when(F.col("key") % 2 == 0, F.lit("^")).otherwise(F.lit("$"))
    day = F.concat(F.lit("202501"), F.lpad((F.col("key") % 28 + 1).cast("string"), 2, "0"))
    name = F.concat(F.col("c_name"), cut, F.col("c_mktsegment"), cut, F.lit("M"))
    head = hl7.segment("MSH", {1: "|", 2: F.concat(cut, F.lit("~\\&")), 9: "ADT^A01", 12: "2.5"})
    visit = hl7.segment("PV1", {2: "I", 3: F.concat(F.lit("W"), cut, F.lit("HOSP")), 10: F.when(F.col("key") % 3 == 0, F.lit("CARD")), 19: F.concat(F.lit("VN"), F.col("k")), 44: F.concat(day, F.lit("0930"))})
    order = hl7.segment("ORC", {1: "NW", 2: F.concat(F.lit("O"), F.col("k")), 9: day})
    asked = hl7.segment("OBR", {1: "1", 2: F.when(F.col("key") % 2 == 0, F.col("k")), 3: F.concat(F.lit("F"), F.col("k")), 4: F.concat(F.lit("GLU"), cut, F.lit("Glucose")), 7: day})
    kin = hl7.segment("NK1", {1: "1", 2: F.concat(F.lit("O"), F.lit("\\S\\"), F.col("k"), cut, F.lit("A\\T\\B"))})
    parts = F.array(head, hl7.pid(1, F.col("k"), "", name, "19700102", "F", address=F.concat(F.lit("1 Road"), cut, cut, F.lit("Town"))), visit, order, asked, kin)
    return c.select("key", hl7.generated(parts).alias("message"))


_DAY = "'2025-01-' || lpad((c_custkey % 28 + 1)::varchar, 2, '0')"


@query("hl7_pv1_event", f"select c_custkey as key, 'VN' || c_custkey as id, case when c_custkey % 3 = 0 then 'CARD' else 'HOSP' end as code, {_DAY} as start_date from customer")
def hl7_pv1_event(spark, d):
    return hl7.visit_events(_visits(spark, d), "message", "key")


@query("hl7_orc_event", f"select c_custkey as key, 'O' || c_custkey as id, 'NW' as code, {_DAY} as start_date from customer")
def hl7_orc_event(spark, d):
    return hl7.order_events(_visits(spark, d), "message", "key")


@query("hl7_obr_time", f"select c_custkey as key, case when c_custkey % 2 = 0 then '' else 'F' end || c_custkey as id, 'GLU' as code, null::double as value, null::varchar as unit, {_DAY} as date from customer")
def hl7_obr_time(spark, d):
    return hl7.order_observations(_visits(spark, d), "message", "key")


@query("hl7_contacts", "select c_custkey as key, 'O' || case when c_custkey % 2 = 0 then '^' else '$' end || c_custkey as family_name, 'A&B' as given_name from customer")
def hl7_contacts(spark, d):
    return hl7.contacts(_visits(spark, d), "message", "key")


@query("hl7_order_dates", f"select c_custkey as key, 0 as place, {_DAY} as date from customer")
def hl7_order_dates(spark, d):
    return hl7.order_dates(_visits(spark, d), "message", "key")


@query("hl7_message_errors", """select event_id, case event_id % 6 when 0 then 'message is empty' when 1 then 'first segment is not MSH' when 2 then 'MSH has fewer than 12 fields' when 3 then 'a segment name is not valid' when 4 then 'unknown segment type ZZZ' end as error,
 strftime(ts, '%Y%m%d%H%M%S') as at, strftime(ts, '%Y%m%d') as day from events""")
def hl7_message_errors(spark, d):
    k, head = F.col("event_id"), "MSH|^~\\&|S|F|D|H|202501010101||ADT^A01|1|P|2.5"
    text = F.when(k % 6 == 0, "").when(k % 6 == 1, "PID|1").when(k % 6 == 2, "MSH|^~\\&|S").when(k % 6 == 3, head + "\rpid|1").when(k % 6 == 4, head + "\rZZZ|1").otherwise(head + "\rPID|1")
    return table(spark, d, "events").select("event_id", hl7.message_error(text).alias("error"), hl7.timestamp_text("ts").alias("at"), hl7.date_text("ts").alias("day"))


@query("hl7_patient_info", "select c_custkey as key, '1' as set_id, c_custkey::varchar as patient_id, '' as patient_identifier_list, c_name as last_name, c_mktsegment as first_name, 'M' as middle_name, null::varchar as suffix, null::varchar as prefix, '19700102' as birth_date, 'F' as gender, '1 Road' as address_street, 'Town' as address_city, null::varchar as address_state, null::varchar as address_zip, '' as phone_number from customer")
def hl7_patient_info(spark, d):
    return hl7.patient_info(_visits(spark, d), "message", "key")


@query("profile_errors", """select c_custkey as key, case when c_custkey % 7 = 0 then 'resource is no DiagnosticReport' when c_custkey % 5 = 0 then 'code is missing' when c_custkey % 11 = 0 then 'code is empty'
 when c_custkey % 13 = 0 then 'result_codes is not an array' when c_custkey % 4 = 0 then 'result_codes has a wrong number of elements' end as error from customer""")
def profile_errors(spark, d):
    key = F.col("c_custkey")
    kind = F.when(key % 7 == 0, F.lit("Patient")).otherwise(F.lit("diagnosticreport"))
    code = F.when(key % 5 == 0, F.lit("null")).when(key % 11 == 0, F.lit('" "')).otherwise(F.lit('"x"'))
    results = F.when(key % 13 == 0, F.lit('"[1]"')).when(key % 4 == 0, F.lit("[]")).otherwise(F.lit('["a","b"]'))
    text = F.concat(F.lit('{"resourceType":"'), kind, F.lit('","id":"'), key.cast("string"), F.lit('","code":'), code, F.lit(',"result_codes":'), results, F.lit("}"))
    return table(spark, d, "customer").select(key.alias("key"), validate.profile_error(text, validate.PROFILES[2]).alias("error"))


@query("vcf_stats_roundtrip", """with v as (select 'A' as r, case p_partkey % 5 when 0 then 'G' when 1 then 'T' when 2 then 'ATT' when 3 then 'C' else 'A,G' end as a, unnest(string_split(case p_partkey % 5 when 0 then 'G' when 1 then 'T' when 2 then 'ATT' when 3 then 'C' else 'T,G' end, ',')) as x from part)
 select (select count(*) from part) as records, count(*) filter (where length(x) = 1) as snps, count(*) filter (where x = 'G') as transitions, count(*) filter (where x in ('T', 'C')) as transversions, count(*) filter (where length(x) > 1) as insertions, 0::bigint as deletions from v""")
def vcf_stats_roundtrip(spark, d):
    alt = F.get(F.array(*map(F.lit, ("G", "T", "ATT", "C", "T,G"))), (F.col("p_partkey") % 5).cast("int"))
    lines = table(spark, d, "part").select(F.concat_ws("\t", F.lit("1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("A"), alt, F.lit("99"), F.lit("PASS"), F.concat(F.lit("DP=10;S="), F.col("p_size").cast("string"), F.lit(";DB"))).alias("value"))
    records = genomics.vcf_records(lines)
    return genomics.vcf_stats(genomics.vcf_records(records.select(genomics.vcf_line().alias("value"))))


@query("fastq_stats_roundtrip", "select count(*) as reads, count(*) * 8 as bases, 8::bigint as average_length, 39.5::double as mean_quality from part")
def fastq_stats_roundtrip(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.lit("read").alias("description"), F.lit("ACGTACGT").alias("sequence"), F.lit("IHIHIHIH").alias("quality"))
    return genomics.fastq_stats(genomics.fastq_records(rows.select(F.concat(genomics.fastq_text(), F.lit("\n")).alias("value"))))


@query("ndjson_roundtrip", WITH + "select id, code, value, unit from observations")
def ndjson_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/ndjson-{uuid.uuid4().hex}"
    ndjson.write_ndjson(observations(spark, d).select("id", "code", "value", "unit"), path)
    return ndjson.read_ndjson(spark, path, "Observation")


@query("json_objects", WITH + "select id, given_name, birth_date from patients")
def json_objects(spark, d):
    texts = patients(spark, d).select(ndjson.to_json("id", "given_name", "family_name", "birth_date").alias("t"))
    return texts.select(ndjson.from_json("t", "Patient").alias("p")).select("p.id", "p.given_name", "p.birth_date")


@query("extract_by_type", WITH + "select id, family_name from patients")
def extract_by_type(spark, d):
    entry = ndjson.to_json("id", "given_name", "family_name", "birth_date")
    bundle = F.concat(F.lit('{"bundle_type":"Collection","entries":[{"Patient":'), entry, F.lit('},{"Condition":{"id":"c","code":"x","clinical_status":"a","verification_status":"b","subject":"s"}}]}'))
    entries = ndjson.bundle_entries(patients(spark, d).select(bundle.alias("text")), "text")
    return ndjson.extract(entries, "Patient").select("id", "family_name")


@query("encrypted_store", WITH + "select id, family_name from patients")
def encrypted_store(spark, d):
    secret = b"0123456789abcdef0123456789abcdef"
    sealed = patients(spark, d).select(ndjson.encrypted(secret, "id", "family_name").alias("sealed"))
    return sealed.select(ndjson.decrypted("sealed", secret, "id string, family_name string").alias("p")).select("p.*")


@query("synthetic_labs", "select 'obs-' || i as id, case when i % 2 = 0 then 'HGB' else 'GLU' end as code, (i % 100) / 10 as value, 'arb' as unit from range((select count(*) from customer)) r(i)")
def synthetic_labs(spark, d):
    return ndjson.synthetic_labs(spark, table(spark, d, "customer").count())
