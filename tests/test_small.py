"""Operators that no query shows whole: noise, qualities, ids, stores, bundles written in one commit, importance of a model that is not linear."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import bundles, models, privacy, terminology, validate
from vitalframe.sources import genomics, ndjson, omop


def test_gaussian_noise(spark):
    sigma = privacy.gaussian_sigma(2.0, 0.5, 1e-5)
    assert sigma == pytest.approx(math.sqrt(2 * math.log(1.25e5)) * 4)
    r = spark.range(20_000).select(privacy.gaussian_noise(sigma, 7).alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.kurtosis("x").alias("k")).first()
    assert abs(r.m) < 4 * sigma / math.sqrt(20_000) and r.s == pytest.approx(sigma, rel=0.03) and abs(r.k) < 0.15
    frame = spark.createDataFrame([(1.0,), (500.0,)], "x double")
    assert privacy.private_sum(frame, "x", 1.0, 1.0, delta=1e-6, clip=(0.0, 10.0), seed=3).first()[0] == pytest.approx(11, abs=40)


def test_qualities_ids_and_blank_resources(spark):
    row = spark.range(1).select(genomics.phred_char(F.lit(0)).alias("a"), genomics.phred_char(F.lit(93)).alias("b"), genomics.phred_char(F.lit(94)).alias("c"), genomics.phred(F.lit("~")).alias("d")).first()
    assert tuple(row) == ("!", "~", None, 93)
    ids = spark.createDataFrame([(0,), (-1,), (None,)], "i int")
    assert [r[0] for r in ids.select(omop.is_concept_id("i")).collect()] == [True, False, False]
    rows = spark.createDataFrame([("a",), ("  ",), (None,)], "id string")
    assert [r[0] is None for r in rows.select(validate.resource_error()).collect()] == [True, False, False]


def test_store_lists_and_removes(spark, tmp_path):
    path = str(tmp_path / "store")
    ndjson.save_store(spark.createDataFrame([("a/b", 1), ("c d", 2), ("c d", 3)], "k string, n long"), path, "k")
    assert {r[0] for r in ndjson.store_keys(spark, path, "k").collect()} == {"a/b", "c d"}
    assert ndjson.load_store(spark, path, "n long, k string", "k", "c d").count() == 2
    assert ndjson.remove_from_store(spark, path, "k", "a/b") and not ndjson.remove_from_store(spark, path, "k", "a/b")
    assert {r[0] for r in ndjson.store_keys(spark, path, "k").collect()} == {"c d"}


def test_bundles_commit_and_json(spark, tmp_path):
    rows = [("t1", "Transaction", 1, "a", None), ("t1", "Transaction", 2, "b", None), ("t2", "Transaction", 1, "a", None), ("t2", "Transaction", 2, "b", "bad"), ("t2", "Transaction", 3, "c", None),
            ("b1", "Batch", 1, "a", "no"), ("b1", "Batch", 2, "b", None), ("b1", "Batch", 3, "b", "again"), ("c1", "Collection", 1, "a", None), ("t3", "Transaction", 1, "x", None), ("t3", "Transaction", 2, "x", None)]
    entries = spark.createDataFrame(rows, "bundle string, kind string, place int, id string, fault string")
    args = ("bundle", "kind", "place", F.col("fault"))
    report = {r.bundle: r for r in bundles.process(entries, *args).collect()}
    assert (report["t1"].applied, report["t1"].committed, report["t2"].applied, report["t2"].committed, report["t2"].first_error) == (2, True, 1, False, "bad")
    assert (report["b1"].applied, report["b1"].failures, report["b1"].committed) == (1, 2, True)
    assert report["c1"].invalid and report["c1"].applied == 0 and report["t3"].invalid == "duplicate id x" and not report["t3"].committed
    assert {tuple(r) for r in bundles.entry_errors(entries, *args).collect()} == {("t2", 2, "bad"), ("b1", 1, "no"), ("b1", 3, "again")}
    folder = str(tmp_path / "out")
    os.makedirs(folder)
    written = bundles.commit(entries, folder, *args)
    assert {(r.bundle, r.place) for r in spark.read.parquet(written).collect()} == {("t1", 1), ("t1", 2), ("b1", 2)} and [x for x in os.listdir(folder) if not x.startswith(".")] == [os.path.basename(written)]
    made = {r.bundle: r.json for r in bundles.to_json(entries.withColumn("r", F.to_json(F.struct("id"))), "bundle", "kind", "place", "r").collect()}
    assert made["t2"] == '{"bundle_type":"Transaction","entries":[{"id":"a"},{"id":"b"},{"id":"c"}]}'


def test_importance_of_any_model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(40, 3)))]
    frame = spark.createDataFrame(rows, "i int, a double, b double, c double")

    def model(x):
        return np.tanh(x[:, 0]) + x[:, 1] ** 2

    found = {r.i: r.importance for r in models.importance_rows(frame, ["a", "b", "c"], model, "i").collect()}
    for i, a, b, _ in rows:
        assert found[i] == pytest.approx([0.5 * (1 - math.tanh(a) ** 2), abs(b), 0.0], abs=2e-3)
    means = {r.feature: r.importance for r in models.feature_importance(frame, ["a", "b", "c"], model).collect()}
    assert means["b"] == pytest.approx(np.mean([v[1] for v in found.values()])) and means["c"] == 0
    assert models.feature_importance(frame.limit(0), ["a"], model).first().importance is None


def test_metrics_of_no_rows(spark):
    rows = models.validate_model(spark.createDataFrame([], "y boolean, s double"), F.col("y"), "s", list(models.METRICS)).collect()
    assert [r.metric for r in rows] == list(models.METRICS) and all(r.value == 0 for r in rows)


def test_bad_pairs_and_searches(spark):
    rows = spark.createDataFrame([(1, 1, "Warfarin"), (1, 2, "ibuprofen"), (1, 3, "IBUPROFEN"), (2, 4, "warfarin"), (1, 5, None), (1, 6, "warfarin")], "g int, i int, drug string")
    known = spark.createDataFrame([("ibuprofen", "warfarin"), ("warfarin", "IBUPROFEN")], "x string, y string")
    assert {tuple(r) for r in terminology.contraindicated_within(rows, "g", "i", "drug", known).collect()} == {(1, 1, 2), (1, 1, 3), (1, 2, 6), (1, 3, 6)}
    table = terminology.loinc(spark)
    first = table.first()
    assert first.code in {r.code for r in terminology.search_terms(table, first.long_name[:5].upper(), component=first.component.upper()).collect()}
    assert terminology.search_terms(table, None, system="none such").count() == 0


def test_bad_pairs_are_made_once(spark, monkeypatch):
    """Idents of several drugs, repeated rows, nulls and large sets in blocks against all pairs; nothing after the join makes its pairs distinct."""
    monkeypatch.setattr(terminology, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(5)
    made = [(int(g), int(i), "ABCDEF"[d] if d % 2 else "abcdef"[d]) for g, i, d in zip(rng.integers(0, 3, 150), rng.integers(0, 40, 150), rng.integers(0, 6, 150), strict=True)]
    made += [(None, 1, "a"), (1, None, "b"), (1, 50, None), *made[:20], *[(7, i, "aB"[i % 2]) for i in range(40)], *[(8, i, "c") for i in range(20)]]
    bad = {frozenset(x) for x in ("ab", "bd", "e", "c")}
    known = spark.createDataFrame([("A", "b"), ("d", "B"), ("e", "e"), ("C", "c"), ("b", "a"), (None, "a")], "x string, y string")
    whole = [(g, i, d.lower()) for g, i, d in made if g is not None and i is not None and d is not None]
    want = {(g, i, j) for g, i, x in whole for h, j, y in whole if g == h and i < j and frozenset((x, y)) in bad}
    found = terminology.contraindicated_within(spark.createDataFrame(made, "s int, i int, drug string"), "s", "i", "drug", known)
    assert found.columns == ["s", "a", "b"] and sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
