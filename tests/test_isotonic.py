"""Isotonic fits, in ranges and whole, against pooling adjacent violators one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import isotonic


def sequential(scores, labels):
    """Blocks (start, mean) by the textbook loop over sorted scores, equal scores as one point; neighbours of equal mean stay apart."""
    points = [(s, sum(y for t, y in zip(scores, labels, strict=True) if t == s), scores.count(s)) for s in sorted(set(scores))]
    blocks = []
    for s, k, n in points:
        blocks.append([s, k, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] > blocks[-1][1] * blocks[-2][2]:
            _, k2, n2 = blocks.pop()
            blocks[-1][1] += k2
            blocks[-1][2] += n2
    return [(s, k / n) for s, k, n in blocks]


def steps(blocks, x):
    return [v for s, v in blocks if s <= x][-1] if blocks[0][0] <= x else blocks[0][1]


def lines(blocks, x):
    return float(np.interp(x, [s for s, _ in blocks], [v for _, v in blocks]))


def case(kind, n=700, seed=1):
    rng = np.random.default_rng(seed)
    s = np.round(rng.random(n) * 3 - 1, 3)
    if kind == "noisy":
        y = rng.random(n) < np.clip(s, 0, 1)
    elif kind == "falling":
        y = s < rng.random(n)
    elif kind == "apart":
        y = s > 0.4
    else:
        y = (np.floor(s * 50) % 2 == 0) ^ (rng.random(n) < s / 3)
    return s.tolist(), [int(v) for v in y]


@pytest.mark.parametrize("kind", ["noisy", "falling", "apart", "waves"])
@pytest.mark.parametrize("leaf,small", [(100_000, 100_000), (25, 7)])
def test_against_the_sequential_version(spark, monkeypatch, kind, leaf, small):
    monkeypatch.setattr(isotonic, "LEAF", leaf)
    monkeypatch.setattr(isotonic, "SMALL", small)
    scores, labels = case(kind)
    df = spark.createDataFrame([(s, y == 1) for s, y in zip(scores, labels, strict=True)], "s double, y boolean").repartition(4)
    model = isotonic.isotonic_fit(df, F.col("y"), "s")
    blocks = sequential(scores, labels)
    asked = spark.createDataFrame([(x, 1) for x in [-5.0, 9.0, *np.linspace(-1.1, 2.1, 150).tolist(), *scores[:80]]] + [(None, 2), (float("nan"), 3)], "s double, k int")
    for of, expected in ((isotonic.isotonic_step, steps), (isotonic.isotonic_interpolated, lines)):
        found = of(asked, "s", model).collect()
        assert len(found) == 234 and [r.calibrated for r in found if r.k != 1] == [None, None]
        if len(blocks) > 1 or expected is steps:
            assert all(r.calibrated == pytest.approx(expected(blocks, r.s), abs=1e-12) for r in found if r.k == 1)
    assert model.agg(F.sum("n")).first()[0] == len(scores)


def test_odd_tables(spark):
    schema = "s double, y boolean"
    empty = isotonic.isotonic_fit(spark.createDataFrame([(None, True), (0.5, None), (float("nan"), True)], schema), F.col("y"), "s")
    one = isotonic.isotonic_fit(spark.createDataFrame([(0.3, True), (0.3, False)], schema), F.col("y"), "s")
    asked = spark.createDataFrame([(0.2,), (7.0,)], "s double")
    assert empty.count() == 0 and one.count() == 1
    assert [r.calibrated for r in isotonic.isotonic_step(asked, "s", empty).collect()] == [0.5, 0.5] and [r.calibrated for r in isotonic.isotonic_step(asked, "s", one).collect()] == [0.5, 0.5]
    assert [r.calibrated for r in isotonic.isotonic_interpolated(asked, "s", empty).collect()] == [0.2, 1.0] and [r.calibrated for r in isotonic.isotonic_interpolated(asked, "s", one).collect()] == [0.2, 1.0]
