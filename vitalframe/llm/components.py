"""Connected components of a links table, by alternating star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(links: DataFrame, rounds: int = 60, stages: list[str] | None = None) -> DataFrame:
    """links (a, b): pairs of ids in any order. Returns (node, component): each linked node but the
    smallest of its component, with that smallest id.

    Each round costs a few shuffles of the links, and their number falls with the logarithm of the
    longest chain. Lineage is cut after each. Minima are combined before the shuffle and the joins have
    no aggregate on top that would keep Spark from splitting a hub's rows. The folders of the rounds are added to `stages`, for discard().
    """
    e = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), stages=stages)
    state = None
    for _ in range(rounds):
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(seen)
        e = materialize(_small_star(_large_star(e).distinct()), stages=stages)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
