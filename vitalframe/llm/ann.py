"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Shards are cut by a hash of the id, so no label or cluster makes one larger. A shard's graph is flat:
a neighbour array per level, filled with -1. Each query searches every shard's graph and the shards'
lists are merged. Graphs are written as a table, so a lost executor costs a search task, not a build.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import materialize
from vitalframe.llm.vectors import expanded, one_width, stacked, usable

#: Vectors of a shard, about; neighbours of a node on the upper levels (twice as many on the lowest).
SHARD_ROWS, M = 8192, 16
#: Candidates looked at for a new node's neighbours, and kept while searching.
EF_BUILD, EF_SEARCH = 96, 96
#: Queries that meet one copy of a graph, about as large as the graph is, and how many of them are searched together.
QUERY_BLOCK, TOGETHER = 4096, 512


def _chosen(candidates: np.ndarray, near: np.ndarray, unit: np.ndarray, m: int) -> list[int]:
    """Up to m candidates, nearest first, each nearer to the node than to any chosen before it; then the nearest of the rest."""
    order = np.lexsort((candidates, -near))
    candidates, near = candidates[order], near[order]
    among = unit[candidates] @ unit[candidates].T
    kept: list[int] = []
    worst = np.full(len(candidates), -np.inf)
    for i in range(len(candidates)):
        if near[i] > worst[i]:
            kept.append(i)
            if len(kept) == m:
                break
            worst = np.maximum(worst, among[i])
    if len(kept) < m:
        rest = [i for i in range(len(candidates)) if i not in set(kept)]
        kept += rest[: m - len(kept)]
    return [int(candidates[i]) for i in kept]


def build(unit: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Graph over the rows of unit (n, d), inserted in their order: neighbours of all levels stacked
    (levels * n, 2 M; absent: -1), level of each node, entry node.

    A node's candidates are the EF_BUILD nearest of the nodes inserted before it on the level, found by
    a product of blocks within the shard (bounded by its size), where the textbook runs a graph search.
    """
    n = len(unit)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n)) / math.log(M)).astype(np.int32), 8)
    level[0] = max(level.max(), 0)
    top = int(level[0])
    links = np.full((top + 1, n, 2 * M), -1, np.int32)
    for at in range(top + 1):
        nodes = np.flatnonzero(level >= at)
        most = 2 * M if at == 0 else M
        held: list[list[int]] = [[] for _ in nodes]
        vectors = unit[nodes]
        for start in range(0, len(nodes), 512):
            block = vectors[start : start + 512] @ vectors[: start + 512].T
            for row in range(block.shape[0]):
                i = start + row
                if not i:
                    continue
                near = block[row, :i]
                candidates = np.argpartition(-near, EF_BUILD)[:EF_BUILD] if i > EF_BUILD else np.arange(i)
                for j in _chosen(candidates, near[candidates], vectors, M):
                    held[i].append(j)
                    held[j].append(i)
                    if len(held[j]) > most + M // 2:  # prune in batches
                        mine = np.array(held[j])
                        held[j] = _chosen(mine, vectors[mine] @ vectors[j], vectors, most)
        for i, mine in enumerate(held):
            if len(mine) > most:
                mine = _chosen(np.array(mine), vectors[mine] @ vectors[i], vectors, most)
            links[at, nodes[i], : len(mine)] = nodes[mine]
    return links, level, 0


def search(unit: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query row, the ef nearest nodes met by descending the levels and a beam on the lowest: nodes (-1: none), cosines.

    All queries of the block advance together, each expanding its nearest open candidate per step.
    """
    q, n = len(queries), len(unit)
    rows = np.arange(q)
    at = np.full(q, entry)
    near = queries @ unit[entry]
    for level in range(len(links) - 1, 0, -1):
        moving = np.ones(q, bool)
        while moving.any():
            mine = rows[moving]
            around = links[level, at[mine]]
            cos = np.where(around >= 0, np.einsum("qd,qmd->qm", queries[mine], unit[around]), -np.inf)
            j = cos.argmax(axis=1)
            value = cos[np.arange(len(mine)), j]
            better = value > near[mine]
            at[mine[better]], near[mine[better]] = around[np.arange(len(mine)), j][better], value[better]
            moving[mine[~better]] = False
    nodes, score, open_ = np.full((q, ef), -1), np.full((q, ef), -np.inf), np.zeros((q, ef), bool)
    nodes[:, 0], score[:, 0], open_[:, 0] = at, near, True
    met = np.zeros((q, n), bool)
    met[rows, at] = True
    active = rows
    while len(active):
        candidate = np.where(open_[active], score[active], -np.inf)
        j = candidate.argmax(axis=1)
        alive = candidate[np.arange(len(active)), j] > -np.inf
        active, j = active[alive], j[alive]
        if not len(active):
            break
        open_[active, j] = False
        around = links[0, nodes[active, j]]
        fresh = (around >= 0) & ~met[active[:, None], around]
        met[active[:, None], np.where(fresh, around, nodes[active, j][:, None])] = True
        cos = np.where(fresh, np.einsum("qd,qmd->qm", queries[active], unit[around]), -np.inf)
        all_score = np.hstack([score[active], cos])
        all_nodes = np.hstack([nodes[active], np.where(fresh, around, -1)])
        all_open = np.hstack([open_[active], fresh])
        order = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        score[active] = np.take_along_axis(all_score, order, 1)
        nodes[active] = np.take_along_axis(all_nodes, order, 1)
        open_[active] = np.take_along_axis(all_open, order, 1)
    return nodes, score


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled by the largest component first, so that huge and tiny vectors keep their direction."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found for each query by cosine.

    vectors, queries: (vec_id long, embedding array<float>). Vectors that are null, empty or zero, hold a null or
    non-finite number or have another width than most of `vectors` (ties: the smaller width) take no part. An empty table gives no rows. A query's own id is no candidate; ties go to
    the smaller vec_id; with fewer candidates, all are given. Copies of a vector are one node of the graph and
    come back as all their ids, so a hot vector cannot crowd the beam. Rows that repeat an id and vector count once.
    score is the cosine in double precision of the vectors as given.
    """
    nonzero = F.exists("embedding", lambda x: x != 0.0)
    data, asked = one_width(usable(vectors).filter(nonzero), usable(queries).filter(nonzero), "embedding")
    asked = asked.dropDuplicates(["vec_id", "embedding"])
    nodes = data.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        raw = stacked(frame["embedding"])
        links, _, entry = build(_unit(raw).astype(np.float32))
        ids = frame["node"].to_numpy(np.int64)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "entry": [entry], "levels": [len(links)], "ids": [ids.tobytes()], "raw": [raw.tobytes()], "links": [links.tobytes()]})

    graphs = materialize(placed.groupBy("shard").applyInPandas(graph, "shard int, entry int, levels int, ids binary, raw binary, links binary"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "node": [], "score": []}
        if len(graph) and len(queries):
            g = graph.iloc[0]
            ids = np.frombuffer(g["ids"], np.int64)
            raw = np.frombuffer(g["raw"], np.float64).reshape(len(ids), -1)
            links = np.frombuffer(g["links"], np.int32).reshape(g["levels"], len(ids), -1)
            unit = _unit(raw)
            single = unit.astype(np.float32)
            parts = []
            for start in range(0, len(queries), TOGETHER):
                some = queries.iloc[start : start + TOGETHER]
                mine = _unit(stacked(some["embedding"]))
                found, _ = search(single, links, int(g["entry"]), mine.astype(np.float32), min(ef, max(2, len(ids))))
                row, column = np.nonzero(found >= 0)
                hits = found[row, column]
                exact = np.einsum("id,id->i", mine[row], unit[hits])
                rank = np.lexsort((ids[hits], -exact, row))
                row, hits, exact = row[rank], hits[rank], exact[rank]
                keep = np.arange(len(row)) - np.searchsorted(row, row) <= k  # one more, as a query may meet itself
                parts.append((some["vec_id"].to_numpy()[row[keep]], ids[hits[keep]], exact[keep]))
            out = dict(zip(out, map(np.concatenate, zip(*parts, strict=True)), strict=True))
        return pd.DataFrame(out).astype({"query_id": "int64", "node": "int64", "score": "float64"})

    hits = copies.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(answer, "query_id long, node long, score double")
    return expanded(hits, data.join(nodes, "embedding").select("node", "vec_id"), k)
