"""Isotonic calibration: fitted in ranges of scores, then over what is left of them, and looked up as steps or interpolated.

Pooling adjacent violators may be done in any order, so scores are counted, dealt out by range and pooled inside each
range; only blocks go on. Neighbours of equal mean are one block that remembers where its last part starts, which is all
that the lookups need. Labels are 0 or 1, so means that rise from block to block leave at most about n**(2/3) blocks of n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.shared import discard, written

#: Blocks that one task pools, and blocks of a model that every task may get; larger models are joined by ranges of about so many blocks.
LEAF, SMALL = 100_000, 100_000
_BLOCKS = "low double, last double, n long, positive long, part int"


def pool(rows: Iterator[tuple[float, float, int, int]]) -> list[list]:
    """Pool rows (low, last, n, positive) in rising order: blocks of rising mean. Whole numbers are compared, so that no rounding decides."""
    blocks: list[list] = []
    for low, last, n, k in rows:
        blocks.append([low, last, n, k])
        while len(blocks) > 1:
            (a, _, n1, k1), (_, z, n2, k2) = blocks[-2:]
            if k1 * n2 < k2 * n1:
                break
            # Equal means: one block, whose last part keeps its start. A violation: one new block.
            blocks[-2:] = [[a, z if k1 * n2 == k2 * n1 else a, n1 + n2, k1 + k2]]
    return blocks


def _pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [f for f in frames if len(f)]
    if frames:
        rows = pd.concat(frames, ignore_index=True)
        found = pool(zip(rows["low"].tolist(), rows["last"].tolist(), rows["n"].tolist(), rows["positive"].tolist(), strict=True))
        yield pd.DataFrame(found, columns=["low", "last", "n", "positive"]).assign(part=np.int32(rows["part"].iloc[0]))


def _in_ranges(blocks: DataFrame, ranges: int) -> DataFrame:
    dealt = blocks.repartitionByRange(ranges, "low") if ranges > 1 else blocks.repartition(1)
    return written(dealt.sortWithinPartitions("low").select("low", "last", "n", "positive", F.spark_partition_id().alias("part")).mapInPandas(_pooled, _BLOCKS))


def isotonic_fit(frame: DataFrame, label: Column, score: str) -> DataFrame:
    """(low, last, n, value): the blocks of the isotonic fit of label on score, rising in low and value.

    A block starts at the score low, its last part at last (they differ where neighbours of equal mean are one). Rows with one score are
    one part, whatever their order. Null and NaN scores and null labels are left out; no rows give no blocks. Scores are taken as they are.
    """
    s = F.col(score).cast("double") + F.lit(0.0)
    rows = frame.select(s.alias("low"), label.cast("long").alias("y")).filter(F.col("low").isNotNull() & ~F.isnan("low") & F.col("y").isNotNull())
    blocks = written(rows.groupBy("low").agg(F.col("low").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive")))
    size, extra = blocks.count(), 0
    while size > LEAF:
        ranges = math.ceil(size / LEAF) + 1 + extra
        new = _in_ranges(blocks, ranges)
        discard(blocks)
        blocks, before, size = new, size, new.count()
        if size > 0.7 * before:
            # Hardly any violation was left inside the ranges; done if none is left between them. Else other borders are tried.
            mean = F.col("positive") / F.col("n")
            ends = blocks.groupBy("part").agg(F.min("low").alias("low"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("end")).orderBy("low").collect()
            if all(a["end"] <= b["first"] for a, b in zip(ends, ends[1:], strict=False)):
                break
            extra += 1
    else:
        new = _in_ranges(blocks, 1)
        discard(blocks)
        blocks = new
    return blocks.select("low", "last", "n", (F.col("positive") / F.col("n")).alias("value"))


def _steps(x: np.ndarray, low: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value[np.maximum(np.searchsorted(low, x, "right") - 1, 0)]


def _lines(x: np.ndarray, low: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Between the thresholds low and last of the blocks the values are interpolated; outside of them they are the first and last."""
    at = np.column_stack([low, last]).ravel()
    keep = np.concatenate([[True], at[1:] > at[:-1]])
    return np.interp(x, at[keep], np.repeat(value, 2)[keep])


def _lookup(frame: DataFrame, score: str, model: DataFrame, name: str, how, otherwise: Column) -> DataFrame:
    rows = model.orderBy("low").limit(SMALL + 1).collect()
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    if not rows or (how is _lines and len(rows) == 1 and rows[0]["low"] == rows[0]["last"]):
        return frame.withColumn(name, F.when(usable, otherwise))
    if len(rows) <= SMALL:
        low, last, value = (np.array([r[c] for r in rows]) for c in ("low", "last", "value"))

        @F.pandas_udf("double")
        def of(s: pd.Series) -> pd.Series:
            return pd.Series(np.where(s.isna(), np.nan, how(s.to_numpy(float), low, last, value)))

        found = of(F.col(score).cast("double"))
        return frame.withColumn(name, F.when(usable, found))
    # Ranges of blocks, each with the block before and after it, meet the distinct scores of the range; rows then meet their score.
    k = math.ceil(model.count() / SMALL) + 1
    edges = sorted(set(model.approxQuantile("low", [i / k for i in range(1, k)], 0.001)))
    at = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(c)))
    mine = model.withColumn("b", at("low"))
    ends = mine.groupBy("b").agg(F.min_by(F.struct("low", "last", "value"), "low").alias("f"), F.max_by(F.struct("low", "last", "value"), "low").alias("l"))
    over = Window.orderBy("b")  # one row a range
    # A range without a block of its own still needs its neighbours.
    every = frame.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("b")).join(ends, "b", "left")
    sides = every.select("b", F.last("l", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.first("f", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("q"))
    around = sides.select("b", F.explode(F.array("p", "q")).alias("x")).filter("x is not null").select("b", "x.*")
    blocks = mine.select("b", "low", "last", "value").unionByName(around)
    scores = frame.select(F.col(score).cast("double").alias("s")).filter("s is not null and not isnan(s)").distinct().withColumn("b", at("s"))

    def meet(own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("low")
        x = own["s"].to_numpy(float)
        return pd.DataFrame({"s": x, "v": how(x, *(blocks[c].to_numpy(float) for c in ("low", "last", "value"))) if len(x) else np.empty(0)})

    found = scores.groupBy("b").cogroup(blocks.groupBy("b")).applyInPandas(meet, "s double, v double")
    joined = frame.withColumn("_s", F.col(score).cast("double")).join(found.withColumnsRenamed({"s": "_s", "v": name}), "_s", "left")
    return joined.select(*frame.columns, name)


def isotonic_step(frame: DataFrame, score: str, model: DataFrame, name: str = "calibrated") -> DataFrame:
    """frame with the value of the block in which the score lies, the first one below all blocks; 0.5 for a model without blocks, null for a null or NaN score."""
    return _lookup(frame, score, model, name, _steps, F.lit(0.5))


def isotonic_interpolated(frame: DataFrame, score: str, model: DataFrame, name: str = "calibrated") -> DataFrame:
    """frame with the value interpolated between the starts of the parts of the blocks; with fewer than two of them the score itself, in 0 to 1."""
    clamped = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    return _lookup(frame, score, model, name, _lines, clamped)
