"""Known values of single operators."""

import math
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions import medical, units
from vitalframe.operators import compliance, guard, isotonic, linking, models, privacy, sanitize, series, stats, survival, validate
from vitalframe.operators.query import Predicate, Query
from vitalframe.sources import genomics, hl7, imaging, ndjson
from vitalframe.streaming import live


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def numbers(spark, *values):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, i int, x double")


def values(frame, column):
    return [round(r[column], 9) for r in frame.orderBy("i").collect()]


def test_query_groups(spark):
    rows = [("p1", "Ada", "Lovelace", "1815-12-10"), ("p2", "Alan", "Turing", "1912-06-23"), ("p3", "Grace", "Hopper", "1906-12-09")]
    people = spark.createDataFrame(rows, "id string, given_name string, family_name string, birth_date string")
    q = Query("Patient").contains("family_name", "Tur").date_ge("birth_date", "1900-01-01").or_group().eq("id", "p1")
    assert {r.id for r in q.run(people).collect()} == {"p1", "p2"}
    assert Query("Patient").or_group().run(people).count() == 3
    assert Query("Patient").eq("nothing", "x").run(people).count() == 3
    with pytest.raises(ValueError):
        Query("Patient").eq("nothing", "x").run(people, strict=True)
    assert Query("Patient").any(Predicate("eq", "nothing", "x"), Predicate("eq", "id", "p3")).run(people).count() == 1


def test_sanitized_observations(spark):
    rows = [("o1", " hr ", 70.0, " BPM "), ("o2", "Hr", 72.0, "bpm"), ("o3", "TEMP", 37.0, "C"), ("o4", "HR", 65.0, " Beats/Min "), ("o5", None, None, None)]
    frame = spark.createDataFrame(rows, "id string, code string, value double, unit string")
    plain = sanitize.observations(frame, aliases=False)
    assert {r.id for r in Query("Observation").eq("code", "HR").eq("unit", "bpm").run(plain).collect()} == {"o1", "o2"}
    assert {r.id for r in Query("Observation").eq("unit", "bpm").run(sanitize.observations(frame)).collect()} == {"o1", "o2", "o4"}
    bad = validate.validate(frame, "Observation").filter("error is not null")
    assert {r.id: r.error for r in bad.collect()}["o5"] == "code is empty"


def test_bundles(spark):
    rows = [(1, "Transaction", 0, "a", False), (1, "Transaction", 1, "b", True), (1, "Transaction", 2, "a", False), (2, "Collection", 0, "a", False), (2, "Collection", 1, "a", False)]
    entries = spark.createDataFrame(rows, "bundle int, kind string, k int, id string, failed boolean")
    assert {r.bundle: r.error for r in validate.bundle_errors(entries, "bundle", "kind", "k").collect()} == {1: "duplicate id a", 2: None}
    assert {tuple(r) for r in validate.transaction_outcome(entries, "bundle", "k", "failed").collect()} == {(1, 1, False), (2, 2, True)}


def test_links(spark):
    left = spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "id string, subject string")
    right = spark.createDataFrame([("e2", "s1", 2), ("e1", "s1", 1)], "enc string, subject string, k int")
    assert {(r.id, r.found) for r in linking.link_first(left, right, "subject", ["k"], {"enc": "found"}).collect()} == {("c1", "e1"), ("c2", None)}
    people = spark.createDataFrame([("7", "19800102"), ("x", "1980-01-02"), ("8", None)], "id string, birth_date string")
    assert [tuple(r) for r in linking.to_omop_person(people).collect()] == [(7, 1980, 0)]


def test_series(spark):
    x = numbers(spark, 1, 2, 3, 4)
    assert values(series.moving_average(x, "k", "i", "x", 2), "moving_average") == [1.5, 2.5, 3.5]
    assert values(series.rolling_std(x, "k", "i", "x", 2), "rolling_std") == [round(math.sqrt(0.5), 9)] * 3
    assert values(series.rolling_std(x, "k", "i", "x", 1), "rolling_std") == [0] * 4
    assert values(series.sliding_sum(x, "k", "i", "x", 2), "sliding_sum") == [3, 5, 7]
    assert values(series.ema(x, "k", "i", "x", 0.5), "ema") == [1, 1.5, 2.25, 3.125]
    assert series.moving_average(x, "k", "i", "x", 0).count() == 0
    five = numbers(spark, 1, 2, 3, 4, 5)
    assert [r["window"] for r in series.counted_windows(five, "k", "i", 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert series.sliding_counted_windows(five, "k", "i", 3, 1).count() == 9 and series.sliding_counted_windows(five, "k", "i", 2, 2).count() == 4
    last = series.ring(numbers(spark, 1, 2, 3), "k", "i", 2)
    assert sorted((r.x, r.dropped) for r in last.collect()) == [(2, 1), (3, 1)]
    times = spark.createDataFrame([("k", i, t) for i, t in enumerate((1000, 1050, 500))], "k string, i int, ms long")
    assert [r.session for r in series.sessions(times, "k", "i", "ms", 10000).orderBy("i").collect()] == [0, 0, 1]
    lines = spark.createDataFrame([("dev1,hr,72.5,1000",), ("dev1,hr,x,1",), ("a,b,1",), (None,)], "value string")
    assert [(r.device_id, r.value) for r in live.readings(lines).collect()] == [("dev1", 72.5)]


def test_survival(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 0), (4.0, 1), (float("nan"), 1)], "t double, cause int")
    found = survival.competing_risks(rows, "t", "cause", [1, 2]).orderBy("time").collect()
    assert [r.survival for r in found] == [0.75, 0.5, 0.5, 0.0]
    assert [round(r.cif_1, 9) for r in found] == [0.25, 0.25, 0.25, 0.75] and [round(r.cif_2, 9) for r in found] == [0, 0.25, 0.25, 0.25]
    km = survival.kaplan_meier(spark.createDataFrame([(1.0, True), (2.0, False), (2.0, True), (3.0, True), (5.0, False)], "t double, e boolean"), "t", F.col("e"))
    assert [round(r.survival, 9) for r in km.orderBy("time").collect()] == [0.8, 0.6, 0.3, 0.3]
    cox = spark.createDataFrame([(float(t), t % 3 != 0, float(x)) for t, x in enumerate((2, 0, 3, 1, 1, 2, 0, 1, 0), 1)], "t double, e boolean, x double")
    fit = survival.cox(cox, "t", F.col("e"), ["x"])
    assert fit["converged"] and fit["beta"][0] > 0 and math.isfinite(fit["se"][0])


def test_statistics(spark):
    x = numbers(spark, 1, 2, 3, 4)
    r = stats.describe(x, "x").first()
    assert (r["mean"], r["median"], round(r["sd"], 12)) == (2.5, 2.5, 1.290994448736)
    assert [r.n for r in stats.bin_counts(numbers(spark, 0, 0.1, 0.9, 1, 1.1, 2), "x", [0, 1, 2]).orderBy("bin").collect()] == [3, 3]
    assert values(stats.min_max(numbers(spark, 2, 4, 6), "x"), "scaled") == [0, 0.5, 1] and values(stats.min_max(numbers(spark, 2, 2), "x"), "scaled") == [0, 0]
    meta = stats.meta_fixed(spark.createDataFrame([(1.0, 0.25), (2.0, 1.0)], "y double, v double"), "y", "v").first()
    assert round(meta.pooled, 9) == 1.2 and round(meta.se, 9) == round(math.sqrt(0.2), 9)
    assert abs(stats.t_pvalue(2.228139, 10) - 0.05) < 1e-6 and abs(stats.t_pvalue(12.7062, 1) - 0.05) < 1e-5
    assert stats.sample_size_two_sample(0.5, 0.8, 0.05) == 63 and stats.sample_size_proportion(0.5, 0.5, 0.8, 0.05) == 0
    slope, _ = stats.logistic_fit(spark.createDataFrame([(0, -1.0), (1, 1.0)], "y int, x double"), "y", "x", 0.5, 20)
    assert slope > 0


def test_formulas(spark):
    found = one(spark, medical.sensitivity(F.lit(80), F.lit(20)), medical.number_needed_to_treat(F.lit(0.2), F.lit(0.1)), medical.ratio(F.lit(1), F.lit(0)), medical.star_rating(F.lit(0.5), (0.2, 0.4, 0.6, 0.8)), units.convert(F.lit(5.0), F.lit("mg/dL"), F.lit("g/L")), units.convert(F.lit(5.0), F.lit("mg"), F.lit("m")))
    assert found[0] == 0.8 and round(found[1], 9) == 10 and found[2] is None and found[3] == 3 and round(found[4], 9) == 0.05 and found[5] is None
    path = one(spark, medical.seir_trajectory(*map(F.lit, (0.99, 0.0, 0.01, 0.0, 0.5, 0.2, 0.1, 10.0, 0.1))))[0]
    assert len(path) == 101 and all(abs(sum(p) - 1) < 1e-9 for p in path)


def test_privacy(spark):
    rows = spark.createDataFrame([("1", "a", "x"), ("1", "a", "y"), ("2", None, "x"), ("2", None, "x")], "zip string, age string, s string")
    assert privacy.k_anonymity(rows, ["zip", "age"]).first().k == 2 and privacy.l_diversity(rows, ["zip", "age"], "s").first().l == 1
    assert round(privacy.t_closeness(rows, ["zip", "age"], "s").first().t, 9) == 0.25
    clients = spark.createDataFrame([("a", [1.0, 1.0], 1), ("b", [3.0, 5.0], 3), ("c", [0.0, 0.0], 0)], "client string, w array<double>, n long")
    assert [r.weight for r in privacy.fedavg(clients, "w", "n").orderBy("pos").collect()] == [2.5, 4.0]
    assert [round(r.total, 6) for r in privacy.secure_sum(clients, "client", "w").orderBy("pos").collect()] == [4, 6]
    masked = privacy.masked_updates(clients, "client", "w", circles=1).filter("pos = 0").collect()
    assert len(masked) == 3 and all(abs(r.masked - {"a": 1, "b": 3, "c": 0}[r.client]) > 1 for r in masked)
    budget = privacy.PrivacyBudget(1.0)
    assert budget.spend(0.75) and not budget.spend(0.5) and budget.epsilon == 0.25
    with pytest.raises(ValueError):
        privacy.laplace_scale(1.0, 0.0)


def test_typed_rules(spark):
    """JSON types count, and evidence names the conditions that decided."""
    rows = ['{"k":"5"}', '{"k":null}', '{"k":"[x]"}', '{"k":5}', '{"k":5.0}', '{"k":["x",1]}', '{"k":" "}', '{"k":[]}', '{"k":{"b":1,"a":[2]}}', '{"k":true}', "no json", None, "[1]", "{}"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, d string")

    def passing(expr):
        return [r.i for r in frame.filter(compliance.rule_condition("d", expr)).orderBy("i").collect()]

    assert passing({"GreaterThan": {"path": "k", "value": 1}}) == [3, 4]
    assert passing({"Equals": {"path": "k", "value": 5}}) == [3] and passing({"Equals": {"path": "k", "value": 5.0}}) == [4]
    assert passing({"Equals": {"path": "k", "value": "5"}}) == [0] and passing({"Equals": {"path": "k", "value": None}}) == [1] and passing({"Equals": {"path": "k", "value": True}}) == [9]
    assert passing({"Equals": {"path": "k", "value": {"a": [2], "b": 1}}}) == [8]
    assert passing({"Exists": {"path": "k"}}) == list(range(10)) and passing({"Exists": {"path": "k", "should_exist": False}}) == [10, 11, 12, 13]
    assert passing({"Contains": {"path": "k", "item": "x"}}) == [2, 5] and passing({"Contains": {"path": "k", "item": 1}}) == [5]
    assert passing({"Regex": {"path": "k", "pattern": "5"}}) == [0]
    assert passing({"NonEmpty": {"path": "k"}}) == [0, 1, 2, 3, 4, 5, 8, 9]
    assert passing({"And": []}) == list(range(14)) and passing({"Or": []}) == []
    rules = {"r": ("Error", {"And": [{"Exists": {"path": "k"}}, {"Or": [{"Equals": {"path": "k", "value": 5}}, {"Regex": {"path": "k", "pattern": "5"}}]}, {"Exists": {"path": "z"}}]})}
    found = {r.i: r for r in compliance.evaluate_rules(frame, "d", rules, "i", evidence=True).collect()}
    assert [tuple(e) for e in found[3].evidence] == [("k", "5"), ("k", "5"), ("z", None)]
    assert [tuple(e) for e in found[9].evidence] == [("k", "true")] * 3 and [tuple(e) for e in found[13].evidence] == [("k", None)]
    assert found[3].message == "Rule 'r' failed (severity: Error); evidence: k=5, k=5, z"
    assert one(spark, models.json_risk(F.lit('{"a":"5","b":0.25,"c":null}'), ["a", "b", "c"])) == (0.25,)


def test_compliance(spark):
    doc = '{"patient":{"id":"p","name":{"given":["A"]}},"age":40,"tags":["phi"],"note":"SSN 123-45-6789"}'
    frame = spark.createDataFrame([(doc,), ("{}",), (None,)], "d string")
    failed = compliance.evaluate_rules(frame.limit(1), "d", compliance.HIPAA).filter("not passed")
    assert [r.rule for r in failed.collect()] == ["hipaa.note.no_ssn"]
    assert compliance.evaluate_rules(frame, "d", compliance.RAW_HIPAA).filter("passed is null").count() == 0
    path = {"Equals": {"path": "patient.name.given[0]", "value": "A"}}
    assert [r[0] for r in frame.select(compliance.rule_condition("d", path)).collect()] == [True, False, False]
    assert one(spark, compliance.mask(F.lit("123456789")), compliance.mask(F.lit("123")), compliance.redacted(F.lit(None))) == ("*****6789", "***", None)


def test_guard(spark, tmp_path):
    frame = guard.labelled(spark.createDataFrame([("a", "b")], "name string, code string"), name="PHI", code="Pseudonymized")
    assert guard.violations(frame, "print") == ["name"] and guard.violations(frame, "file") == ["name", "code"]
    assert guard.label_of(guard.derive(frame, "both", F.concat("name", "code"), "name", "code"), "both") == "PHI"
    with pytest.raises(PermissionError):
        guard.guarded_write(frame, str(tmp_path / "x"))
    guard.guarded_write(guard.derive(frame, "h", compliance.hashed("name"), "name", deidentified="Anonymized").select("h"), str(tmp_path / "y"))


def test_guard_follows_the_plan(spark, tmp_path):
    """No expression over PHI gets past the guard, whatever makes it."""
    people = guard.labelled(spark.createDataFrame([(1, "a", "x", 2.0), (2, "b", "y", 3.0)], "id int, name string, code string, size double"), name="PHI", code="Pseudonymized")
    other = spark.createDataFrame([(1, "m")], "id int, note string")
    people.createOrReplaceTempView("guarded_people")

    @F.pandas_udf("string")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper()

    def through(batches):
        yield from batches

    leaks = [
        people.select(F.upper("name")), people.select(F.upper("name").alias("name")), people.withColumn("name", F.concat("name", F.lit("!"))), people.withColumnRenamed("name", "n").select("n"),
        people.select(F.struct("id", F.struct("name")).alias("s")).select("s.*"), people.select(F.length("name").alias("n")), people.groupBy("id").agg(F.max("name").alias("m")), people.groupBy("name").count(),
        people.groupBy(F.substring("name", 1, 1).alias("initial")).agg(F.sum("size").alias("s")), people.join(other, "id").select(F.coalesce("note", "name").alias("c")), people.select("id", F.explode(F.split("name", "")).alias("e")),
        other.select("note").union(people.select("name")), people.select(shout("name").alias("u")), people.select("name", "id").mapInPandas(through, "q string, id int"), people.select(F.row_number().over(Window.orderBy("name")).alias("r")),
        people.select(F.lead("name").over(Window.orderBy("id")).alias("r")), spark.sql("select (select max(name) from guarded_people) as m, id from guarded_people"), people.alias("a").join(people.alias("b"), "id").select("a.name"), people.groupBy().pivot("id", [1, 2]).agg(F.first("name")),
        people.select("id", "name").unpivot("id", ["name"], "k", "v"), people.groupBy("id").applyInPandas(lambda f: f[["id", "name"]], "id int, anything string"), people.distinct().filter("id > 1").orderBy("id").limit(1), people.select(F.when(F.col("name") == "a", 1).otherwise(0).alias("is_a")),
    ]
    for i, frame in enumerate(leaks):
        assert guard.violations(frame, "print"), i
        with pytest.raises(PermissionError):
            guard.guarded_write(frame, str(tmp_path / f"leak{i}"))
    safe = [people.select("id", "size"), people.groupBy("id").agg(F.sum("size").alias("s")), people.join(other, "id").select("id", "note"), people.filter("name = 'a'").select("id"), people.groupBy().count(), people.select("id", F.lit("x").alias("name"))]
    for i, frame in enumerate(safe):
        assert guard.violations(frame, "file") == [], i
    assert guard.labels(people.select(F.upper("code").alias("c"), F.concat("code", F.col("id").cast("string")).alias("d"))) == {"c": "Pseudonymized", "d": "Pseudonymized"}
    hashed = guard.derive(people, "h", compliance.hashed("name"), "name", deidentified="Anonymized")
    assert guard.violations(hashed.select("id", F.upper("h").alias("u")), "file") == [] and guard.label_of(hashed.withColumn("h", F.concat("h", "name")), "h") == "PHI"
    mailed = guard.labelled(people.select("id", "name"), name="Authorized:log")
    assert [s for s in guard.SINKS if not guard.violations(mailed, s)] == ["log"]
    assert guard.joined("Authorized:log", "Authorized:print") == "PHI" and guard.joined("Authorized", "Pseudonymized") == "PHI" and guard.joined("Authorized:log", "Anonymized") == "Authorized:log"
    path = str(tmp_path / "kept")
    people.write.parquet(path)
    assert guard.label_of(spark.read.parquet(path).select(F.lower("name").alias("n")), "n") == "PHI"


def test_models(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.6), (True, 0.4), (False, 0.2)], "y boolean, s double")
    r = models.confusion(rows, F.col("y"), "s").first()
    assert round(r.precision, 9) == round(r.recall, 9) == round(r.f1, 9) == round(2 / 3, 9)
    assert round(models.auc_rank(rows, F.col("y"), "s").first().auc, 9) == round(5 / 6, 9)
    assert models.auc_rank(rows.filter("y"), F.col("y"), "s").first().auc == 0.5 and models.auc_rank(rows.limit(0), F.col("y"), "s").first().auc == 0
    assert round(models.brier(spark.createDataFrame([(True, 0.9), (False, 0.2), (True, 0.4)], "y boolean, s double"), F.col("y"), "s").first().brier, 9) == round(0.41 / 3, 9)
    steps = isotonic.isotonic_fit(spark.createDataFrame([(False, 0.1), (True, 0.2), (False, 0.3), (True, 0.9)], "y boolean, s double"), F.col("y"), "s").orderBy("low").select("low", "value").collect()
    assert [tuple(r) for r in steps] == [(0.1, 0.0), (0.2, 0.5), (0.9, 1.0)]
    assert one(spark, models.json_risk(F.lit('{"age":40,"bp":120}'), ["age", "bp"]), models.json_risk(F.lit("{}"), ["age"]), models.linear_score(F.array(F.lit(0.5)), [0.5, 9.0], 0.1)) == (1.0, 0.0, 0.35)
    registry = models.ModelRegistry()
    registry.register("m", "1.9.0", 1)
    registry.register("m", "1.10.0", 2)
    assert registry.get("m") == 2 and registry.get("x") is None and models.LinearModel([], 0).issues() == ["no weights"]


def test_formats(spark, tmp_path):
    text = "MSH|^~\\&|SRC|FAC|DST|HOSP|202501010101||ADT^A01|123|P|2.5\rPID|1|ALTID|P12345||Doe^Jane||19851224|F\rNK1|1|Doe^John\rOBR|1|||GLU^Glucose|||20250102\r"
    frame = spark.createDataFrame([(text,), ("",), ("XYZ",), (None,)], "m string")
    assert [tuple(r) for r in hl7.patients(frame, "m").collect()] == [("P12345", "Doe", "Jane", "1985-12-24")]
    assert [tuple(r) for r in hl7.contacts(frame, "m").collect()] == [("Doe", "John")] and [tuple(r) for r in hl7.orders(frame, "m").collect()] == [("1", "GLU", "20250102")]
    assert [r[0] for r in frame.select(hl7.message_error("m")).collect()] == [None, "message is empty", "first segment is not MSH", "message is empty"]
    parts, there = one(spark, hl7.components(F.lit("A^B&C~D")), hl7.unescaped(hl7.escaped(F.lit("a|b^c\\F\\~&"))))
    assert len(parts) == 2 and parts[0][1] == ["B", "C"] and there == "a|b^c\\F\\~&"
    own = "MSH|$~\\&|A|B|C|D|2025||ADT|1|P|2.5\rPID|1||P9$X||Doe$Jane||19700102\rORC|NW|| F1 ||||||20240229x\rPV1|1| I |W$101$HOSP|\rOBX|1|NM|HR$Rate||72|bpm\rNK1|1| "
    frame2 = spark.createDataFrame([(own,), (text,), ("MSH|^~\\&\rPV1|1\rNK1",)], "m string")
    assert [tuple(r) for r in hl7.patients(frame2, "m").collect()] == [("P9", "Doe", "Jane", "1970-01-02"), ("P12345", "Doe", "Jane", "1985-12-24")]
    assert [tuple(r) for r in hl7.observations(frame2, "m").collect()] == [("1", "HR", 72.0, "bpm")]
    assert [tuple(r) for r in hl7.order_events(frame2, "m").collect()] == [("", "NW", "2024-02-29")]
    assert [tuple(r) for r in hl7.visit_events(frame2, "m").collect()] == [("", "HOSP", None), ("", "", None)]
    assert [tuple(r) for r in hl7.order_observations(frame2, "m").collect()] == [("1", "GLU", None, None, "2025-01-02")]
    assert [r[0] for r in frame2.select(hl7.has_contact("m")).collect()] == [False, True, False]
    built = hl7.generated(F.array(hl7.msh(("A", "B"), ("C", "D"), "2025", "ORU^R01", "7"), hl7.obx(1, "NM", "HR^Rate", None, "72", "bpm")))
    assert one(spark, built, hl7.message_error(built)) == ("MSH|^~\\&|A|B|C|D|2025||ORU^R01|7|P|2.5\rOBX|1|NM|HR^Rate||72|bpm|||\r", None)
    assert one(spark, hl7.generated(hl7.segments(F.lit("MSH#^~\\&#A\rPID#1#x")))) == ("MSH#^~\\&#A\rPID#1#x\r",)
    rate, back = one(spark, units.convert(F.lit(6.0), F.lit("L/min"), F.lit("mL/s")), models.dequantize(models.quantize(F.lit(0.5), 0.01), 0.01))
    assert round(rate, 9) == 100 and back == 0.5
    r = genomics.fastq_stats(genomics.fastq_records(spark.createDataFrame([("@read1 desc\nATCG\n+\nIIII\n@read2\nGCTA\n+\nHHHH\n",)], "value string"))).first()
    assert tuple(r) == (2, 8, 4, 39.5)
    assert one(spark, *[genomics.phred(F.lit(c)) for c in "!I~A"]) == (0, 40, 93, 32)
    (tmp_path / "r.fastq").write_text("@a\nAC\n+\n@I\n@b x\nGT\n+\nII\n\n")
    (tmp_path / "s.fastq").write_text("".join(f"@{k}\nACGT\n+\n@@+I\n" for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    reads = genomics.read_fastq(spark, str(tmp_path / "*.fastq")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {tuple(r) for r in reads if r.sequence != "ACGT"} == {("a", None, "AC", "@I"), ("b", "x", "GT", "II")}
    assert sorted(int(r.id) for r in reads if r.quality == "@@+I") == list(range(500)) and len(reads) == 502
    aliases = spark.createDataFrame([(u,) for u in (" Beats-Per-Minute", "mm Hg", "deg C", "/min", "Cel")], "unit string").select(sanitize.unit_alias("unit").alias("u"))
    assert [r.u for r in aliases.collect()] == ["bpm", "mmhg", "c", "/min", "cel"]
    line = "1\t12345\t.\tA\tT\t.\tPASS\tDB;DP=10\tGT:DP\t0|1:9\t1|1"
    plain = "1\t7\t.\tA\tT\t.\tPASS\t."
    both = genomics.vcf_records(spark.createDataFrame([(line,), (plain,)], "value string")).select(genomics.vcf_line().alias("v")).collect()
    assert [r.v for r in both] == [line, plain]
    vcf = genomics.vcf_records(spark.createDataFrame([("##x",), ("1\t12345\t.\tA\tT\t.\tPASS\tDP=10;DB\tGT:DP\t0|1:9",)], "value string")).first()
    assert (vcf.pos, vcf.qual, vcf.info, vcf.samples) == (12345, None, {"DP": "10", "DB": "true"}, [{"GT": "0|1", "DP": "9"}])
    assert one(spark, ndjson.from_json(F.lit('{"id":"o"}'), "Observation"), ndjson.from_json(F.lit("x"), "Patient")) == (None, None)
    tag = lambda g, e, vr, v: struct.pack("<HH2sH", g, e, vr, len(v)) + v
    data = b"\0" * 128 + b"DICM" + tag(0x28, 0x10, b"US", struct.pack("<H", 1)) + tag(0x28, 0x11, b"US", struct.pack("<H", 2)) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 4) + struct.pack("<HH", 65535, 0)
    (tmp_path / "a.dcm").write_bytes(data)
    (tmp_path / "b.dcm").write_bytes(b"none")
    images = imaging.dicom_images(imaging.read_dicom(spark, str(tmp_path / "*.dcm"))).collect()
    assert [(r.rows, r.columns, r.bits, bytes(r.pixels)) for r in images] == [(1, 2, 16, b"\xff\0")]
    assert imaging.dicom_tags(imaging.read_dicom(spark, str(tmp_path / "*.dcm"))).count() == 3


def test_smoothing_by_blocks(spark):
    """Keys of several blocks and batches, ties told apart by a second column, against a loop."""
    import random

    rnd = random.Random(8)
    rows = [(k, i // 3, i, rnd.uniform(-5, 5) if rnd.random() > 0.1 else None) for k, n in (("a", 700), ("b", 1), ("c", 130), (None, 70)) for i in range(n)]
    for alpha in (0.0, 0.05, 0.3, 1.0):
        found = {(r.k, r.i): r.ema for r in series.ema(spark.createDataFrame(rows, "k string, t int, i int, x double").repartition(3), "k", ["t", "i"], "x", alpha).collect()}
        expected, last = {}, {}
        for k, _, i, x in rows:
            if x is not None:
                last[k] = x if k not in last else alpha * x + (1 - alpha) * last[k]
                expected[k, i] = last[k]
        assert found.keys() == expected.keys() and all(found[x] == pytest.approx(expected[x], abs=1e-12) for x in found)


def test_messages_are_read_once(spark):
    """Contacts and visits of odd messages; in the plan each message is cut in a fixed number of places, and no filter repeats the work."""
    full = "MSH|$~!&|A\r\n\r\nNK1|1|O!S!1$A!T!B\nNK1|2|  $ \nNK1|3|a!F!b!\nPV1||I|W$X||||||||CARD||||||||| V7 |||| 20240229x|\u3000202503010930\nPV1|||second"
    bare = "MSH#\rNK1#1#x^y\rPV1###p^q"
    rows = spark.createDataFrame([(1, full), (2, bare), (3, "MSH|^~\\&"), (4, "PID|1"), (5, ""), (6, None), (7, "MSH|^~\\&\rPV1\rNK1")], "k int, m string")
    kin, seen = hl7.contacts(rows, "m", "k"), hl7.visit_events(rows, "m", "k")
    assert sorted(tuple(r) for r in kin.collect()) == [(1, "O$1", "A&B"), (1, "a|b!", None), (2, "x", "y")]
    assert sorted(tuple(r) for r in seen.collect()) == [(1, "V7", "CARD", "2025-03-01"), (2, "", "q", None), (7, "", "", None)]
    for found in (kin, seen):
        plan = found.filter("k > 0")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("StartsWith(") + plan.count("startswith(") <= 2
