"""Checks of vector columns and the merge of partial nearest lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (ident, embedding array<double>) with an id and a vector that is not null or empty and holds finite numbers only."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(ident).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False))).select(F.col(ident).cast("long").alias(ident), v.alias(column))


def one_width(vectors: DataFrame, queries: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Both frames without the rows whose array in `column` has another length than most of vectors have (ties: the smaller length)."""
    width = vectors.groupBy(F.size(column).alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    of = F.size(column) == (width["w"] if width else 0)
    return vectors.filter(of), queries.filter(of)


def stacked(column, width: int | None = None) -> np.ndarray:
    """A pandas column of equal-length vectors as a matrix."""
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """Of rows (query_id, vec_id, score), the k highest scores of each query, ties to the smaller vec_id; adds rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(members: DataFrame, n: int) -> DataFrame:
    """The n smallest vec_id of each node, first within 64 slices of it, then over those, so that a hot node is shared out."""
    slice_ = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("node", *keys).orderBy("vec_id"))
    first = members.withColumn("r", rank(slice_)).filter(F.col("r") <= n)
    return first.withColumn("r", rank()).filter(F.col("r") <= n).drop("r")


def expanded(hits: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best vec_id of each query from hits (query_id, node, score) and members (node, vec_id).

    The k + 1 best nodes do, as each stands for one vec_id or more and one may be the query itself; and of
    a node's ids the k + 1 smallest, as ties go to the smaller vec_id.
    """
    near = best(hits.withColumnRenamed("node", "vec_id"), k + 1).withColumnRenamed("vec_id", "node").select("query_id", "node", "score")
    few = _smallest(members.distinct(), k + 1)
    return best(near.join(few, "node").filter("query_id <> vec_id").select("query_id", "vec_id", "score"), k)
