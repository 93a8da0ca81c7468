"""Ledgers against a loop over requests; secure averages, and what a single share shows."""

import random

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import ledger, secure


def test_greedy_ledger(spark):
    rnd = random.Random(4)
    keys = ["a"] * 400 + ["b"] * 30 + [None] * 20
    rows = [(i, k, rnd.choice([None, -0.1, 0.0, 0.05, 0.3, 1.1, float("nan")]), rnd.choice([0.0, 1e-6, 4e-6, None])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "i int, k string, eps double, delta double").repartition(7)
    found = {r.i: r for r in ledger.spend(df, "k", ["i"], "eps", "delta", 1.0, 1e-5).collect()}
    state = {}
    for i, k, e, d in rows:
        se, sd = state.get(k, (0.0, 0.0))
        ok = e is not None and d is not None and e >= 0 and d >= 0 and se + e <= 1.0 and sd + d <= 1e-5
        state[k] = (se + e, sd + d) if ok else (se, sd)
        assert (found[i].accepted, found[i].epsilon_spent, found[i].delta_spent) == (ok, *state[k])
    assert any(not r.accepted and r.eps == 0.3 for r in found.values()) and len(found) == len(rows)
    with pytest.raises(ValueError):
        ledger.spend(df.withColumn("accepted", F.lit(1)), "k", ["i"], "eps", None, 1.0)


def test_paid_sums(spark):
    requests = spark.createDataFrame([(i, "a", 0.5, 0.0) for i in range(4)] + [(9, "z", 0.1, 1e-6)], "i int, k string, eps double, delta double")
    sums = spark.createDataFrame([("a", 1000.0)], "k string, s double")
    rows = {r.i: r for r in ledger.private_sums_budgeted(sums, requests, "k", ["i"], "s", 1.0, "eps", 1.0, "delta", 1e-5, seed=5).collect()}
    assert [rows[i].accepted for i in (0, 1, 2, 3, 9)] == [True, True, False, False, True]
    assert rows[2].private_sum is None and 900 < rows[0].private_sum < 1100 and rows[0].private_sum != rows[1].private_sum and abs(rows[9].private_sum) < 1000


@pytest.mark.parametrize("clients", [1, 2, 3, 40, 700])
def test_exact_mean_and_even_shares(spark, clients):
    rnd = random.Random(clients)
    rows = [(c, [rnd.randint(-4000, 4000) / 1024 for _ in range(3)], rnd.randint(1, 9)) for c in range(clients)]
    df = spark.createDataFrame(rows, "c int, w array<double>, n int")
    total = sum(n for _, _, n in rows)
    found = {r.pos: r.weight for r in secure.secure_fedavg(df, "c", "w", "n", "s").collect()}
    assert found == {i: sum(int(w[i] * 1024) * n for _, w, n in rows) / 1024 / total for i in range(3)}
    if clients < 3:
        return
    plain = secure.contributions(df, "c", "w", "n")
    one, two = (secure.shares(plain, "c", key).collect() for key in ("s", "t"))
    true = {(r.c, r.pos): r.value for r in plain.collect()}
    assert len(one) == 4 * clients and all(r.share != true[r.c, r.pos] for r in one)
    # Another secret gives other shares, and shares of equal values are spread over all 64 bits.
    assert not {(r.c, r.pos, r.share) for r in one} & {(r.c, r.pos, r.share) for r in two}
    if clients == 700:
        for bit in (0, 20, 40, 62, 63):
            assert 0.42 < sum((r.share >> bit) & 1 for r in one) / len(one) < 0.58
    # Without one client nothing cancels.
    part = spark.createDataFrame([r for r in one if r.c != 0], "c int, pos int, share long")
    rest = {p: sum(v for (c, q), v in true.items() if q == p and c != 0) for p in range(-1, 3)}
    assert all(r.total != rest[r.pos] for r in secure.secure_total(part).collect())


def test_rounds_and_errors(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0], 1), (1, 2, [3.0, 4.0], 3), (2, 1, [5.0], 0), (3, 7, [8.0], 2)], "r int, c int, w array<double>, n int")
    found = {(r.r, r.pos): r.weight for r in secure.secure_fedavg(df, "c", "w", "n", "s", "r").collect()}
    assert found == {(1, 0): 2.5, (1, 1): 3.5, (3, 0): 8.0}
    with pytest.raises(Exception, match="not finite or too large"):
        secure.secure_fedavg(spark.createDataFrame([(1, [float("nan")], 1)], "c int, w array<double>, n int"), "c", "w", "n", "s").collect()
