"""Federated averages of vectors that nobody sees: whole numbers under masks that cancel exactly.

Numbers are fixed-point, modulo 2**64. Two clients share a mask for each place, made from a keyed hash (SHA-256 of the pair's
secret and the place): one adds it, the other takes it off. To anyone without the secrets a share is evenly spread over all
2**64 numbers, whatever the vector; modulo arithmetic has no rounding, so the sum is exact.

Each client shares masks with its neighbours on a circle, not with all others, so masks grow with the clients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.exprs import col

#: Bits of the fraction, neighbours on either side of a client, and about how many clients a circle has.
FRACTION, NEIGHBOURS, CIRCLE = 32, 2, 256
_HALF, _WHOLE = "cast('9223372036854775808' as decimal(38,0))", "cast('18446744073709551616' as decimal(38,0))"


def _wrapped(x: Column) -> Column:
    """A decimal, modulo 2**64, as a long."""
    return (F.pmod(x + F.expr(_HALF), F.expr(_WHOLE)) - F.expr(_HALF)).cast("long")


def fixed(x) -> Column:
    """A number as a long with FRACTION bits of fraction, rounded to even; null and numbers that are not finite or too large are errors."""
    x = col(x).cast("double")
    return F.when(F.abs(x) < F.lit(2.0 ** (62 - FRACTION)), F.rint(x * F.lit(2.0**FRACTION)).cast("long")).otherwise(F.raise_error(F.lit("a weight is null, not finite or too large")).cast("long"))


def mask(secret, a, b, *place: Column) -> Column:
    """The long that two clients share for a place, by SHA-256 of their secret: the same from either side, and even over all longs."""
    low, high = F.least(col(a), col(b)).cast("string"), F.greatest(col(a), col(b)).cast("string")
    pair = F.sha2(F.to_json(F.array(col(secret), low, high)), 256)
    digest = F.sha2(F.concat_ws("|", pair, *[p.cast("string") for p in place]), 256)
    return _wrapped(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(38,0)"))


def _pairs(clients: DataFrame, by: list[str]) -> DataFrame:
    """(by, _a, _b): each client with its neighbours on its circle. Circles are dealt by a hash, in each round as many as its clients need."""
    few = clients.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")) if by else clients.agg(F.count(F.lit(1)).alias("_c"))
    sized = clients.join(few, by) if by else clients.crossJoin(F.broadcast(few))
    placed = sized.withColumn("_g", F.pmod(F.xxhash64(F.col("_a").cast("string")), F.greatest(F.floor(F.col("_c") / CIRCLE), F.lit(1)).cast("long")))
    around = Window.partitionBy(*by, "_g").orderBy("_a")
    # The circle closes: the first clients follow the last.
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumn("_start", F.slice(F.collect_list("_a").over(Window.partitionBy(*by, "_g").orderBy("_a").rowsBetween(Window.unboundedPreceding, NEIGHBOURS - 1)), 1, NEIGHBOURS))
    heads = F.first("_start").over(whole)
    following = {f"_b{k}": F.coalesce(F.lead("_a", k).over(around), F.get(heads, F.lit(k - 1) - (F.count(F.lit(1)).over(whole) - F.row_number().over(around)).cast("int"))) for k in range(1, NEIGHBOURS + 1)}
    pairs = placed.withColumns(following).select(*by, "_a", F.explode(F.array(*following)).alias("_b")).filter("_b is not null and _a <> _b")
    pairs = pairs.select(*by, F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    return pairs.unionByName(pairs.select(*by, F.col("_b").alias("_a"), F.col("_a").alias("_b")))


def shares(values: DataFrame, client: str, secret: str, *by: str) -> DataFrame:
    """(by, client, pos, share): values (by, client, pos, value long) under the masks that the client shares with its neighbours. A client alone in its round has none."""
    by = list(by)
    both = _pairs(values.select(*by, F.col(client).alias("_a")).distinct(), by)
    each = values.withColumnRenamed(client, "_a")
    own = F.when(F.col("_a") < F.col("_b"), 1).otherwise(-1) * mask(F.lit(secret), "_a", "_b", *[F.col(c) for c in by], F.col("pos")).cast("decimal(38,0)")
    masks = each.select(*by, "_a", "pos").join(both, [*by, "_a"]).groupBy(*by, "_a", "pos").agg(F.sum(own).alias("_m"))
    return each.join(masks, [*by, "_a", "pos"], "left").select(*by, F.col("_a").alias(client), "pos", _wrapped(F.col("value").cast("decimal(38,0)") + F.coalesce("_m", F.lit(0).cast("decimal(38,0)"))).alias("share"))


def secure_total(shared: DataFrame, *by: str) -> DataFrame:
    """(by, pos, total): the sum of the shares modulo 2**64, in which all masks cancel if every client's share is there."""
    return shared.groupBy(*by, "pos").agg(_wrapped(F.sum(F.col("share").cast("decimal(38,0)"))).alias("total"))


def contributions(updates: DataFrame, client: str, weights: str, examples: str, *by: str) -> DataFrame:
    """(by, client, pos, value): weights times examples as fixed-point numbers, and the examples themselves at place -1."""
    n = F.col(examples).cast("double")
    places = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), n.alias("x"))), F.transform(weights, lambda w, i: F.struct(i.alias("pos"), (w.cast("double") * n).alias("x"))))
    return updates.select(*by, client, F.explode(places).alias("_p")).select(*by, client, "_p.pos", fixed("_p.x").alias("value"))


def secure_fedavg(updates: DataFrame, client: str, weights: str, examples: str, secret: str, *by: str) -> DataFrame:
    """(by, pos, weight): the example-weighted mean of the clients' vectors, from their shares only.

    Weights times examples are taken to FRACTION bits; where they need no more, the result is the exact mean. A client has one row in a
    round. Without examples a round has no result, and totals must stay below 2**31.
    """
    total = secure_total(shares(contributions(updates, client, weights, examples, *by), client, secret, *by), *by)
    n = total.filter("pos = -1").select(*by, F.col("total").alias("_n"))
    rest = total.filter("pos >= 0")
    rest = rest.join(n, list(by)) if by else rest.crossJoin(F.broadcast(n))
    return rest.filter("_n > 0").select(*by, "pos", (F.col("total") / F.col("_n")).alias("weight"))
