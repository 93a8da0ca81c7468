"""Bootstrap and permutation without copies of the rows: draws are made for counted values, in all rounds at once.

Equal values are counted first. A value that occurs n times has a Poisson(n) weight in a bootstrap round and a
hypergeometric share of the labels in a permutation round, drawn from a generator keyed by seed and value, so every task
that meets the value draws the same, and a retried one too. Only sums for each round leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.shared import discard, written

#: Parts into which a range of values is cut by quantiles, and distinct values of a range that one task sorts at once.
PARTS, LEAF = 32, 4096
#: Values handled together (times rounds numbers in memory), and the largest total for which numpy draws hypergeometric numbers.
STEP, LARGEST = 1024, 10**9 - 1


def counted(frame: DataFrame, value: str) -> DataFrame:
    """(v, n): how often each value occurs; null and NaN are left out, -0.0 is 0.0. Written once."""
    v = F.col(value).cast("double") + F.lit(0.0)
    return written(frame.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")))


def _weights(v: np.ndarray, n: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Poisson(n) weights, a row for each value and a column for each round."""
    out = np.empty((len(v), rounds), np.int64)
    for i, (bits, mean) in enumerate(zip(v.view(np.uint64).tolist(), n.tolist(), strict=True)):
        out[i] = np.random.Generator(np.random.Philox(key=np.array([bits, seed], np.uint64))).poisson(mean, rounds)
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            yield tuple(c.to_numpy(zero_copy_only=False) for c in batch.slice(i, STEP).columns)


def _summed(cells: DataFrame, rounds: int, seed: int, of: Callable[[np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """(round, sum of weight * f(v) for each f): partial sums of all rounds leave a task, whatever its rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), rounds))
        for v, n in _steps(batches):
            w = _weights(v, n, rounds, seed).astype(float)
            total += np.stack(of(v)) @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), *[pa.array(t) for t in total]], names=["round", *names])

    out = cells.select("v", "n").mapInArrow(partial, ", ".join(["round int", *[f"{x} double" for x in names]]))
    return out.groupBy("round").agg(*[F.sum(x).alias(x) for x in names])


def _bounds(values: list[float | None], confidence: float) -> tuple[float | None, float | None]:
    """The values at floor(alpha * rounds) and ceil((1 - alpha) * rounds) - 1 of the sorted ones; rounds without a value do not count."""
    found, alpha = sorted(v for v in values if v is not None), (1 - confidence) / 2
    if not found:
        return None, None
    at = lambda i: found[max(0, min(i, len(found) - 1))]
    return at(math.floor(alpha * len(found))), at(math.ceil((1 - alpha) * len(found)) - 1)


@dataclass
class _Range:
    """Values in (low, high]: how many distinct ones, and in each round the weight below them and their own."""

    low: float
    high: float
    size: int
    below: np.ndarray
    own: np.ndarray

    def holds(self, ranks: np.ndarray) -> np.ndarray:
        return (ranks >= self.below) & (ranks < self.below + self.own)


def _which(ranges: list[_Range]) -> Callable[[np.ndarray], np.ndarray]:
    """A function from values to the place of their range, -1 for none. The ranges are disjoint and in order."""
    low, high = np.array([r.low for r in ranges]), np.array([r.high for r in ranges])

    def of(v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(low, v, "left") - 1
        return np.where((at >= 0) & (v <= high[np.maximum(at, 0)]), at, -1)

    return of


def _inside(cells: DataFrame, ranges: list[_Range]) -> DataFrame:
    """(b, v, n): the cells that lie in a range, with its place."""
    which = _which(ranges)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = which(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1)], names=["b", "v", "n"]).filter(pa.array(at >= 0))

    return cells.select("v", "n").mapInArrow(tag, "b int, v double, n long")


def _cut(cells: DataFrame, ranges: list[_Range], rounds: int, seed: int) -> list[_Range]:
    """The ranges, each cut into up to PARTS by quantiles of its distinct values."""
    at = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    edges = {r["b"]: r["e"] for r in _inside(cells, ranges).groupBy("b").agg(F.percentile_approx("v", at, F.lit(1000)).alias("e")).collect()}
    new, parent = [], []
    for b, r in enumerate(ranges):
        marks = [r.low, *sorted({e for e in edges.get(b, []) if r.low < e < r.high}), r.high]
        new += [_Range(x, y, 0, np.zeros(rounds, np.int64), np.zeros(rounds, np.int64)) for x, y in zip(marks, marks[1:], strict=False)]
        parent += [b] * (len(marks) - 1)
    which = _which(new)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = np.zeros((len(new), rounds), np.int64), np.zeros(len(new), np.int64)
        for v, n in _steps(batches):
            b = which(v)
            v, n, b = v[b >= 0], n[b >= 0], b[b >= 0]
            np.add.at(own, b, _weights(v, n, rounds, seed))
            sizes += np.bincount(b, minlength=len(new))
        for b in np.flatnonzero(sizes):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sizes[b]]), pa.array([own[b]], pa.list_(pa.int64()))], names=["b", "k", "w"])

    parts = cells.select("v", "n").mapInArrow(partial, "b int, k long, w array<long>")
    sums = parts.select("b", "k", F.posexplode("w").alias("round", "w")).groupBy("b", "round").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
    for r in sums.collect():
        new[r["b"]].size, new[r["b"]].own[r["round"]] = r["k"], r["w"]
    for i, r in enumerate(new):
        first = i == 0 or parent[i] != parent[i - 1]
        r.below = ranges[parent[i]].below if first else new[i - 1].below + new[i - 1].own
    return new


def _leaves(cells: DataFrame, ranges: list[_Range], ranks: np.ndarray, rounds: int, seed: int) -> list[tuple[int, int, float]]:
    """(which rank, round, value) for the ranks that fall into the ranges, each sorted in one task."""

    def find(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, frame = ranges[key[0]], frame.sort_values("v")
        v = frame["v"].to_numpy(float)
        upto = np.cumsum(_weights(v, frame["n"].to_numpy(np.int64), rounds, seed), axis=0) + r.below
        out = []
        for i, rank in enumerate(ranks):
            for b in np.flatnonzero(r.holds(rank)):
                out.append((i, int(b), v[np.searchsorted(upto[:, b], rank[b], "right")]))
        return pd.DataFrame(out, columns=["i", "round", "v"])

    found = _inside(cells, ranges).groupBy("b").applyInPandas(find, "i int, round int, v double").collect()
    return [(r["i"], r["round"], r["v"]) for r in found]


def quantiles_by_round(cells: DataFrame, q: float, rounds: int, seed: int) -> list[float | None]:
    """The q-quantile (linear between the two ranks around it) of each bootstrap round over counted cells (v, n).

    Values are cut into ranges by quantiles, and the weights of a range in each round tell in which one a rank falls. Only
    ranges that hold some round's rank are cut again, until one has LEAF distinct values at most and a task can sort it.
    """
    none = np.zeros(rounds, np.int64)
    ranges = _cut(cells, [_Range(-np.inf, np.inf, 0, none, none)], rounds, seed)
    total = ranges[-1].below + ranges[-1].own
    h = np.maximum(total - 1, 0) * q
    ranks = np.stack([np.floor(h), np.ceil(h)]).astype(np.int64)
    found = np.full((2, rounds), np.nan)
    while ranges:
        ranges = [r for r in ranges if r.size and any(r.holds(rank).any() for rank in ranks)]
        small = [r for r in ranges if r.size <= LEAF]
        for i, b, v in _leaves(cells, small, ranks, rounds, seed) if small else []:
            found[i, b] = v
        large = [r for r in ranges if r.size > LEAF]
        ranges = _cut(cells, large, rounds, seed) if large else []
    mixed = found[0] + (h - ranks[0]) * (found[1] - found[0])
    return [float(x) if t else None for x, t in zip(mixed, total, strict=True)]


def bootstrap_ci(frame: DataFrame, value: str, statistic: str | tuple[list[Callable], Callable], rounds: int, confidence: float, seed: int = 1) -> tuple[float | None, float | None]:
    """Bounds of a statistic by a Poisson bootstrap: (low, high), null without values.

    statistic: "mean", "sd" (sample), "sum", "median", "q<percent>" like "q90", or (functions of the values, function of their weighted sums and
    the weight) for any other that follows from sums: ([lambda v: v, lambda v: v ** 3], lambda s, w: ...).
    """
    if rounds < 1 or not 0 < confidence < 1:
        raise ValueError("rounds must be positive and confidence between 0 and 1")
    cells = counted(frame, value)
    sums = {
        "mean": ([lambda v: v], lambda s, w: s[0] / w),
        "sum": ([lambda v: v], lambda s, w: s[0]),
        "sd": ([lambda v: v, np.square], lambda s, w: math.sqrt(max(s[1] - s[0] * s[0] / w, 0.0) / (w - 1)) if w > 1 else None),
    }
    chosen = sums.get(statistic) if isinstance(statistic, str) else statistic
    if chosen:
        of, combine = chosen
        names = [f"s{i}" for i in range(len(of))]
        rows = _summed(cells, rounds, seed, lambda v: [*(f(v) for f in of), np.ones(len(v))], [*names, "w"]).collect()
        values = [combine([r[n] for n in names], r["w"]) if r["w"] else None for r in rows]
    else:
        if statistic != "median" and not (isinstance(statistic, str) and statistic.startswith("q")):
            raise ValueError(f"unknown statistic {statistic}")
        values = quantiles_by_round(cells, 0.5 if statistic == "median" else float(statistic[1:]) / 100, rounds, seed)
    discard(cells)
    return _bounds(values, confidence)


def _hypergeometric(rng: np.random.Generator, sizes: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` rows drawn without replacement come from each group. Totals beyond numpy's limit are split by the normal limit of the law, group by group."""
    if sizes.sum() <= LARGEST:
        return rng.multivariate_hypergeometric(sizes, take, method="marginals")
    out, left, rest = np.zeros(len(sizes), np.int64), int(sizes.sum()), take
    for i, n in enumerate(sizes.tolist()):
        if left <= LARGEST:
            out[i:] = rng.multivariate_hypergeometric(sizes[i:], rest, method="marginals")
            return out
        mean, p = rest * n / left, rest / left
        drawn = round(rng.normal(mean, math.sqrt(max(n * p * (1 - p) * (left - n) / max(left - 1, 1), 0.0))))
        out[i] = min(max(drawn, 0, rest - (left - n)), n, rest)
        left, rest = left - n, rest - int(out[i])
    return out


def permutation_p(frame: DataFrame, value: str, group: str, a, b, rounds: int, seed: int = 1) -> DataFrame:
    """One row: share of label shuffles whose difference of means is at least the seen one, with add-one smoothing; null if a group is empty.

    In a round label a goes to as many rows as have it, drawn without replacement: first the buckets of values get their shares, on the driver
    (buckets times rounds numbers), then each bucket deals its share out to its values. No row is copied or sorted.
    """
    rows = frame.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    seen = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("s")).collect()
    seen = {r[group]: r for r in seen}
    spark = frame.sparkSession
    if a not in seen or b not in seen:
        return spark.createDataFrame([(None,)], "p double")
    cells = counted(rows, value)
    buckets = int(min(4096, max(1, cells.count() // LEAF)))
    bucket = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(buckets)).cast("int")
    sizes = np.zeros(buckets, np.int64)
    for r in cells.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        sizes[r["b"]] = r["n"]
    na, nb = seen[a]["n"], seen[b]["n"]
    takes = np.stack([_hypergeometric(np.random.default_rng([seed, r]), sizes, na) for r in range(rounds)])

    def deal(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v")
        v, n = part["v"].to_numpy(float), part["n"].to_numpy(np.int64)
        sums = [float(_hypergeometric(np.random.default_rng([seed, r, key[0]]), n, int(takes[r, key[0]])) @ v) for r in range(rounds)]
        return pd.DataFrame({"round": np.arange(rounds, dtype=np.int32), "s": sums})

    drawn = cells.withColumn("b", bucket).groupBy("b").applyInPandas(deal, "round int, s double").groupBy("round").agg(F.sum("s").alias("s"))
    whole, gap = seen[a]["s"] + seen[b]["s"], abs(seen[a]["s"] / na - seen[b]["s"] / nb)
    # Sums of doubles come in any order: what differs by rounding only counts as equal.
    far = F.abs(F.col("s") / na - (F.lit(whole) - F.col("s")) / nb) >= F.lit(gap * (1 - 1e-12))
    return drawn.agg(((F.sum(far.cast("long")) + 1) / (F.lit(rounds) + 1)).alias("p"))
