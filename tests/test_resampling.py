"""Bootstrap and permutation against the same draws applied in numpy, and against what theory says."""

import itertools
import math

import numpy as np
import pytest

from vitalframe.operators import resampling as rs


def frame(spark, values, **more):
    return spark.createDataFrame([(None if v is None else float(v), "a" if i % 2 else "b") for i, v in enumerate(values)], "x double, g string").repartition(3)


def resamples(values, rounds, seed):
    v, n = np.unique(np.array(values, float), return_counts=True)
    w = rs._weights(v, n, rounds, seed)
    return [np.repeat(v, w[:, b]) for b in range(rounds)]


def bounds(found, confidence):
    return rs._bounds(list(found), confidence)


@pytest.mark.parametrize("leaf,parts", [(4096, 32), (5, 3)])
def test_any_statistic(spark, monkeypatch, leaf, parts):
    monkeypatch.setattr(rs, "LEAF", leaf)
    monkeypatch.setattr(rs, "PARTS", parts)
    rng = np.random.default_rng(2)
    values = [*np.round(rng.exponential(5, 400), 2), *[3.25] * 250, -0.0, 0.0, 1e9]
    df = frame(spark, [*values, None, float("nan")])
    samples = resamples(values, 40, 7)
    for name, f in (("mean", np.mean), ("median", np.median), ("q90", lambda x: np.quantile(x, 0.9)), ("sd", lambda x: x.std(ddof=1)), ("sum", np.sum)):
        assert rs.bootstrap_ci(df, "x", name, 40, 0.9, seed=7) == pytest.approx(bounds((f(s) for s in samples), 0.9), rel=1e-9), name
    cubes = ([lambda v: v**3], lambda s, w: s[0] / w)
    assert rs.bootstrap_ci(df, "x", cubes, 40, 0.9, seed=7) == pytest.approx(bounds(((s**3).mean() for s in samples), 0.9), rel=1e-9)


def test_coverage_and_odd_tables(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(10, 2, 900)
    low, high = rs.bootstrap_ci(frame(spark, values), "x", "mean", 400, 0.95)
    assert (high - low) / 2 == pytest.approx(1.96 * values.std() / math.sqrt(900), rel=0.2) and low < values.mean() < high
    assert rs.bootstrap_ci(frame(spark, [None]), "x", "median", 10, 0.9) == (None, None)
    assert rs.bootstrap_ci(frame(spark, [4.0] * 30), "x", "median", 50, 0.9) == (4.0, 4.0)
    with pytest.raises(ValueError):
        rs.bootstrap_ci(frame(spark, [1]), "x", "mode", 10, 0.9)


def test_permutation_against_all_splits(spark):
    values = [1, 2, 9, 4, 5, 6, 7, 5, 9, 2]
    a, b = values[1::2], values[::2]
    gap = abs(np.mean(a) - np.mean(b))
    splits = [s for s in itertools.combinations(range(10), 5)]
    share = np.mean([abs(np.mean([values[i] for i in s]) - np.mean([values[i] for i in range(10) if i not in s])) >= gap - 1e-12 for s in splits])
    p = rs.permutation_p(frame(spark, values), "x", "g", "a", "b", 4000).first().p
    assert p == pytest.approx(share, abs=0.03)
    assert rs.permutation_p(frame(spark, [1.0]), "x", "g", "a", "b", 10).first().p is None
    assert rs.permutation_p(frame(spark, [2.0] * 10), "x", "g", "a", "b", 9).first().p == 1.0


def test_shares_of_buckets(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 7, 3])
    assert all(s.sum() == 9 and (s <= sizes).all() for s in (rs._hypergeometric(rng, sizes, 9) for _ in range(50)))
    huge = np.array([3 * 10**9, 10**9, 5])
    drawn = [rs._hypergeometric(rng, huge, 2 * 10**9) for _ in range(50)]
    assert all(d.sum() == 2 * 10**9 and (d <= huge).all() and (d >= 0).all() for d in drawn) and np.mean([d[0] for d in drawn]) == pytest.approx(1.5e9, rel=1e-3)


def test_many_values_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(rs, "LEAF", 20)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(0.25, 1, 300)])
    df = frame(spark, np.ravel(np.column_stack([x[:300], x[300:]])))
    gaps = []
    for _ in range(3000):
        y = rng.permutation(x)
        gaps.append(abs(y[:300].mean() - y[300:].mean()))
    share = np.mean(np.array(gaps) >= abs(x[:300].mean() - x[300:].mean()))
    assert rs.permutation_p(df, "x", "g", "a", "b", 1500).first().p == pytest.approx(share, abs=0.03)
