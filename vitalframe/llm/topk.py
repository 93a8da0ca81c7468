"""Exact top-k by inner product: a Voronoi kNN join.

Bounded pivots cut data and queries into cells. A cell's summary (rows, radius, largest norm, the rows
nearest to its pivot) bounds every inner product in it: q.v <= min(q.p + |q| radius, |q| norm). The
summaries' own rows give each query a score that its k-th best cannot fall below. So a query goes only
to cells whose bound reaches that score, and a cell's data only to the groups of queries that ask for it.
A group holds the queries of one cell, or of several neighbouring cells with few queries, up to a block; a
cell with more is cut into blocks. So data is copied at most once a block, however many cells there are.
Cells are solved in chunks, so a cell with a third of all rows is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import materialize
from vitalframe.llm.vectors import best, expanded, one_width, stacked, usable

#: Rows of a chunk of a cell and of a block of queries; most pivots.
CHUNK_ROWS, BLOCK_QUERIES, MAX_PIVOTS = 4096, 1024, 256


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): each usable vector with components floor(scale * x), x as double."""
    return usable(vectors).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b, by doubles while these hold them exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def groups(pivots: np.ndarray, asked: dict[int, int], block: int) -> tuple[dict[int, int], dict[int, int]]:
    """For each cell with queries (asked: their number), the first block of its group and how many blocks the group has.

    Cells are taken along a chain of nearest pivots, so that the cells of one group lie close to each other.
    """
    first, parts, rest = {}, {}, sorted(asked)
    number, filled, last = -1, block, rest[0] if rest else 0
    while rest:
        last = rest[int(((pivots[rest] - pivots[last]) ** 2).sum(axis=1).argmin())]
        rest.remove(last)
        parts[last] = max(1, math.ceil(asked[last] / block))
        if filled + asked[last] > block:
            number, filled = number + 1, 0
        first[last], filled = number, filled + asked[last]
        number += parts[last] - 1
    return first, parts


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query, exactly.

    vectors, queries: (vec_id long, embedding). Null or empty vectors, those with null or non-finite numbers and those of
    another width than most of `vectors` (ties: the smaller width) take no part; zero vectors do. An empty table gives no rows. A query's own id is no candidate; ties go to the smaller vec_id; with
    fewer candidates, all are given. Copies are one row of the join and come back as all their ids. Rows
    that repeat an id and vector count once. Components up to 2**28 in size keep their products within a long.
    """
    data, asked = one_width(integers(vectors, scale), integers(queries, scale), "v")
    asked = asked.dropDuplicates(["vec_id", "v"])
    nodes = materialize(data.groupBy("v").agg(F.min("vec_id").alias("node")))
    n = nodes.count()
    count = max(1, min(MAX_PIVOTS, n, int(math.sqrt(n) / 4) or 1))
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(5))).limit(count).toPandas()
    if not len(chosen):
        return expanded(nodes.selectExpr("node as query_id", "node", "0L as score").limit(0), nodes.selectExpr("node", "node as vec_id"), k)
    pivots = stacked(chosen["v"])
    lengths = (pivots**2).sum(axis=1)

    def cells(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it, rounded up."""
        cell = (lengths - 2 * found @ pivots.T).argmin(axis=1)
        return cell, np.linalg.norm(found - pivots[cell], axis=1) * (1 + 1e-9)

    def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = stacked(frame["v"]) if len(frame) else np.empty((0, pivots.shape[1]))
            cell, away = cells(found)
            yield frame.assign(cell=cell.astype(np.int32), away=away, norm=np.linalg.norm(found, axis=1) * (1 + 1e-9))

    celled = materialize(nodes.mapInPandas(grouped, "v array<long>, node long, cell int, away double, norm double"))
    summary = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"), F.max("norm").alias("norm")).toPandas()
    ranked = best(celled.selectExpr("cell as query_id", "node as vec_id", "-away as score"), k + 2)
    nearest = ranked.select(F.col("vec_id").alias("node")).join(nodes, "node").select("v").toPandas()
    examples = stacked(nearest["v"])
    index = summary["cell"].to_numpy(int)
    radius, norm = summary["radius"].to_numpy(float), summary["norm"].to_numpy(float)
    chunks = np.ceil(summary["rows"].to_numpy(float) / CHUNK_ROWS).astype(int)

    def owned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, _ = cells(stacked(frame["v"]) if len(frame) else np.empty((0, pivots.shape[1])))
            yield frame.rename(columns={"vec_id": "query_id"}).assign(own=own.astype(np.int32))

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = stacked(frame["v"]) if len(frame) else np.empty((0, pivots.shape[1]))
            scores = found @ examples.T
            least = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] if scores.shape[1] > k else np.full(len(found), -np.inf)
            size = np.linalg.norm(found, axis=1)[:, None] * (1 + 1e-9)
            bound = np.minimum(found @ pivots[index].T + size * radius, size * norm)
            row, hit = np.nonzero(bound >= least[:, None] - 1e-6 * np.abs(least[:, None]) - 1)
            yield frame.iloc[row].assign(cell=index[hit].astype(np.int32))

    def by_cell(values: dict[int, int], cell: str):
        return F.create_map(*[F.lit(int(x)) for pair in values.items() for x in pair])[F.col(cell)]

    own = materialize(asked.select("vec_id", "v").mapInPandas(owned, "query_id long, v array<long>, own int"))
    first, parts = groups(pivots, {r["own"]: r["count"] for r in own.groupBy("own").count().collect()}, BLOCK_QUERIES)
    if not first:
        return expanded(nodes.selectExpr("node as query_id", "node", "0L as score").limit(0), nodes.selectExpr("node", "node as vec_id"), k)
    blocked = own.select("query_id", "v", (by_cell(first, "own") + F.pmod(F.xxhash64("query_id"), by_cell(parts, "own"))).cast("int").alias("block"))
    sent = materialize(blocked.mapInPandas(needed, "query_id long, v array<long>, block int, cell int"))
    chunk_count = by_cell(dict(zip(index.tolist(), chunks.tolist(), strict=True)), "cell")
    wanted = sent.select(*[F.col(c).alias(c) for c in ("cell", "block")]).distinct()
    split = celled.withColumn("chunk", F.pmod(F.xxhash64("node"), chunk_count).cast("int")).select("cell", "chunk", "node", "v").join(wanted, "cell")
    spread = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_count - 1)))

    def solve(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "node": [], "score": []}
        if len(rows) and len(queries):
            rows = rows.sort_values("node", kind="stable")
            scores = _product(stacked(queries["v"]), stacked(rows["v"]))
            order = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            out["query_id"] = np.repeat(queries["query_id"].to_numpy(), order.shape[1])
            out["node"] = rows["node"].to_numpy()[order].ravel()
            out["score"] = np.take_along_axis(scores, order, 1).ravel()
        return pd.DataFrame(out).astype("int64")

    key = ["cell", "chunk", "block"]
    hits = split.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(solve, "query_id long, node long, score long")
    return expanded(hits, data.join(nodes, "v").select("node", "vec_id"), k)
