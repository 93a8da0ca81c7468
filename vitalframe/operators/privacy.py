"""Anonymity measures, noise mechanisms and federated averages."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.exprs import clamp, col, safe_div


def _present(quasi: list[str]) -> list[Column]:
    return [F.coalesce(F.col(q).cast("string"), F.lit("")).alias(q) for q in quasi]


def equivalence_classes(frame: DataFrame, quasi: list[str]) -> DataFrame:
    """Class sizes by the quasi-identifiers; a missing one counts as empty."""
    return frame.groupBy(*_present(quasi)).agg(F.count(F.lit(1)).alias("size"))


def k_anonymity(frame: DataFrame, quasi: list[str]) -> DataFrame:
    """One row: the size of the smallest class (null without rows, which holds for any k)."""
    return equivalence_classes(frame, quasi).agg(F.min("size").alias("k"))


def l_diversity(frame: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """One row: the least number of distinct present sensitive values of a class. Counted in two steps, so that a large class is spread."""
    pairs = frame.groupBy(*_present(quasi), F.col(sensitive).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(*quasi).agg(F.count("_s").alias("l")).agg(F.min("l").alias("l"))


def t_closeness(frame: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """One row: the largest total variation distance between a class and the whole table."""
    value = F.coalesce(F.col(sensitive).cast("string"), F.lit("")).alias("_s")
    cells = frame.groupBy(*_present(quasi), value).agg(F.count(F.lit(1)).alias("_n"))
    whole = cells.groupBy("_s").agg(F.sum("_n").alias("_g"))
    total = cells.agg(F.sum("_n").alias("_t"))
    sizes = cells.groupBy(*quasi).agg(F.sum("_n").alias("_c"))
    near = cells.join(sizes, quasi).join(whole, "_s").crossJoin(F.broadcast(total))
    share, global_share = F.col("_n") / F.col("_c"), F.col("_g") / F.col("_t")
    # A value that the class lacks adds its global share: one minus the global shares of those it has.
    by_class = near.groupBy(*quasi).agg(((F.sum(F.abs(share - global_share)) + 1 - F.sum(global_share)) / 2).alias("t"))
    return by_class.agg(F.max("t").alias("t"))


def laplace_scale(sensitivity: float, epsilon: float) -> float:
    if not (epsilon > 0 and sensitivity >= 0 and math.isfinite(epsilon) and math.isfinite(sensitivity)):
        raise ValueError("epsilon must be positive and sensitivity not negative")
    return sensitivity / epsilon


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    if not (epsilon > 0 and sensitivity >= 0 and 0 < delta < 1):
        raise ValueError("epsilon must be positive, sensitivity not negative and delta in (0, 1)")
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def laplace_noise(scale: float, seed: int | None = None) -> Column:
    """Laplace noise by the inverse distribution function, kept off the endpoint where that is infinite."""
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(2.0**-53)))


def gaussian_noise(sigma: float, seed: int | None = None) -> Column:
    return F.randn(seed) * sigma


def private_sum(frame: DataFrame, value: str, sensitivity: float, epsilon: float, delta: float | None = None, clip: tuple[float, float] | None = None, seed: int | None = None) -> DataFrame:
    """One row: the sum plus Laplace noise, or Gaussian noise where delta is given. clip bounds each value first."""
    x = clamp(F.col(value), *clip) if clip else F.col(value)
    noise = laplace_noise(laplace_scale(sensitivity, epsilon), seed) if delta is None else gaussian_noise(gaussian_sigma(sensitivity, epsilon, delta), seed)
    return frame.agg(F.sum(x).alias("_s")).select((F.coalesce("_s", F.lit(0.0)) + noise).alias("private_sum"))


def private_mean(frame: DataFrame, value: str, sensitivity: float, epsilon: float, seed: int | None = None) -> DataFrame:
    return frame.agg(F.avg(value).alias("_m")).select((F.col("_m") + laplace_noise(laplace_scale(sensitivity, epsilon), seed)).alias("private_mean"))


def private_histogram(frame: DataFrame, key: str, epsilon: float, seed: int | None = None) -> DataFrame:
    """Counts by key with Laplace noise, not below 0."""
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(key, F.greatest(F.col("_n") + laplace_noise(laplace_scale(1.0, epsilon), seed), F.lit(0.0)).alias("private_count"))


def response_probability(epsilon: float) -> float:
    return math.exp(epsilon) / (math.exp(epsilon) + 1)


def randomized_response(truth: Column, epsilon: float, seed: int | None = None) -> Column:
    return F.when(F.rand(seed) < response_probability(epsilon), truth).otherwise(~truth)


def debiased_share(observed, epsilon: float) -> Column:
    """The true share behind an observed share of randomized responses, in 0 to 1."""
    p = response_probability(epsilon)
    return clamp((col(observed) - (1 - p)) / (2 * p - 1), 0.0, 1.0)


@dataclass
class PrivacyBudget:
    """A ledger of epsilon and delta under sequential composition."""

    epsilon: float
    delta: float = 0.0

    def can_spend(self, epsilon: float, delta: float = 0.0) -> bool:
        return epsilon >= 0 and delta >= 0 and epsilon <= self.epsilon and delta <= self.delta

    def spend(self, epsilon: float, delta: float = 0.0) -> bool:
        """Take it off if enough is left; tells whether it was."""
        if not self.can_spend(epsilon, delta):
            return False
        self.epsilon, self.delta = self.epsilon - epsilon, self.delta - delta
        return True


def fedavg(updates: DataFrame, weights: str, examples: str, *by: str) -> DataFrame:
    """(by, pos, weight): example-weighted mean of client vectors, place by place; partial sums combine before the shuffle."""
    flat = updates.select(*by, F.col(examples).cast("double").alias("_n"), F.posexplode(weights).alias("pos", "_w"))
    return flat.groupBy(*by, "pos").agg(safe_div(F.sum(F.col("_w") * F.col("_n")), F.sum("_n")).alias("weight"))


def pairwise_mask(a, b, pos, scale: float = 1e6) -> Column:
    """A mask in [-scale, scale) that two clients share, whatever their order: added by the smaller, taken off by the larger."""
    low, high = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    size = (F.pmod(F.xxhash64(low, high, col(pos)), F.lit(1 << 40)) / (1 << 40) * 2 - 1) * scale
    return F.when(col(a) < col(b), size).otherwise(-size)


def masked_updates(updates: DataFrame, client: str, weights: str, circles: int = 64) -> DataFrame:
    """(client, pos, masked): each client's vector under the masks that it shares with its neighbours.

    Clients are dealt into circles by a hash and sorted there; each has a mask with the next one. So masks
    grow with the clients and not with their square, no window holds all clients, and masks cancel in the sum.
    """
    circle = updates.select(F.col(client).alias("_a")).distinct().withColumn("_g", F.pmod(F.xxhash64("_a"), F.lit(circles)))
    ordered = Window.partitionBy("_g").orderBy("_a")
    nearby = F.coalesce(F.lead("_a").over(ordered), F.first("_a").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = circle.withColumn("_b", nearby).filter("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    flat = updates.select(F.col(client).alias("_a"), F.posexplode(weights).alias("pos", "_w"))
    masks = flat.select("_a", "pos").join(both, "_a").groupBy("_a", "pos").agg(F.sum(pairwise_mask("_a", "_b", "pos")).alias("_m"))
    return flat.join(masks, ["_a", "pos"], "left").select(F.col("_a").alias(client), "pos", (F.col("_w") + F.coalesce("_m", F.lit(0.0))).alias("masked"))


def secure_sum(updates: DataFrame, client: str, weights: str) -> DataFrame:
    """(pos, total): the sum of all vectors, seen only under masks that cancel."""
    return masked_updates(updates, client, weights).groupBy("pos").agg(F.sum("masked").alias("total"))


def aggregate_round(updates: DataFrame, round_: str, client: str, weights: str, examples: str, least_clients: int = 1) -> DataFrame:
    """fedavg of each round that has enough clients."""
    enough = updates.groupBy(round_).agg(F.count_distinct(client).alias("_c")).filter(F.col("_c") >= least_clients).select(round_)
    return fedavg(updates.join(enough, round_, "left_semi"), weights, examples, round_)
