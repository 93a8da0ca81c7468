"""Whitening against numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from vitalframe.llm import whitening
from vitalframe.llm.queries import op13_embedding_whitening

SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """rows: (id, vector) that take part. Returns id -> list of (deviation, whitened), the shares and n."""
    x = {tuple(math.floor(256 * float(c)) for c in v) for _, v in rows}
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    centred = np.array(sorted(x), float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in rows:
        f = [math.floor(256 * float(c)) for c in v]
        z = (np.array(f, float) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(f, sums, strict=True)), z)
    return out, values / values.sum(), n


def compare(found, rows, k=4):
    expected, shares, n = brute(rows, k)
    assert len(found) == k * len(rows)
    for c in range(1, k + 1):
        mine = {r["vec_id"]: r for r in found if r["component"] == c}
        assert set(mine) == set(expected)
        sign = np.sign(sum(r["whitened"] * expected[i][1][c - 1] for i, r in mine.items()))
        for i, r in mine.items():
            assert r["n"] == n and r["deviation"] == expected[i][0]
            assert r["whitened"] == pytest.approx(sign * expected[i][1][c - 1], abs=1e-7)
            assert r["explained"] == pytest.approx(shares[c - 1], rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    found = op13_embedding_whitening(spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), rows)


@pytest.mark.parametrize("gap", [0.5, 0.999])
def test_narrow_block_and_close_eigenvalues(spark, gap):
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    data = rng.standard_normal((600, 40)) * (8 * gap ** np.arange(40)) @ basis + 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=6).collect()
    expected, shares, n = brute(rows)
    assert len(found) == 4 * len(rows)
    for r in found:
        assert r["deviation"] == expected[r["vec_id"]][0] and r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-8) and r["identity_error"] < 1e-8
    if gap < 0.9:
        compare(found, rows)


def test_rows_that_take_no_part_and_repeated_ones(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, 1.0, -0.25]), (2, [0.0, -0.001, 2.0]), (3, [1.0, 0.3, 0.7]), (4, [1.0, 0.3, 0.7]), (4, [0.9, -3.0, 0.7]), (5, [1.0009, 0.3, 0.7])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [1.0, nan, 0.0]), (10, [inf, 0.0, 0.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, x string")
    found = whitening.whiten(df).collect()
    assert {r["n"] for r in found} == {len({tuple(math.floor(256 * c) for c in v) for _, v in good})}
    assert sorted(r["vec_id"] for r in found if r["component"] == 1) == [1, 2, 3, 4, 4, 5]
    assert {r["component"] for r in found} == {1, 2, 3}
    same = [round(r["whitened"], 9) for r in found if r["component"] == 2 and r["vec_id"] == 3]
    assert same and same[0] in [round(r["whitened"], 9) for r in found if r["component"] == 2 and r["vec_id"] == 4]


def test_few_directions_large_numbers_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    line = spark.createDataFrame([(i, [1e5 * i, -2e5 * i, 5.0]) for i in range(50)], schema)
    found = whitening.whiten(line).collect()
    assert {r["component"] for r in found} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in found)
    x = [[256 * 10**5 * i, -512 * 10**5 * i, 1280] for i in range(50)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((50 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
