"""N-gram Jaccard self-join in metric space: pivots, Voronoi cells, windows from the triangle inequality, recursion.

Jaccard distance d = 1 - |x ∩ y| / |x ∪ y| is a metric on shingle sets; sets link at d <= R = 0.1. Between sets that
have nothing in common every distance is 1 and no window tells them apart, so the sets that cannot link go first,
by exact bounds: shingles that no other set has are in no intersection, so more than a tenth of them rule a set out. A
quarter of all shingles shows that for most sets; for the rest all are counted.

What is left lies close together, and there the metric serves. First regions: a set falls to the regions of its
rarest shingles, as many as any partner must meet (the window of a one-shingle pivot follows from R and the
set's size). Within each region the set whose shingles are the most common is the pivot. All distances to pivots are
exact; those within R are links. Then |d(x, p) - d(y, p)| <= R and size(x) >= 0.9 size(y) hold for any linked pair, so
each pivot's region falls into cells one window wide in both, and every set also goes into the next cell up (the
boundary). A cell whose sets are one component already is done; the others are regions of the next level with a
pivot of their own. After LEVELS of that, one more level takes as pivot the set nearest to what most of a region's sets hold
(`_centred`). Sets of one cell that are still in different components then meet by their differences from the pivot (`_met`),
which are small and rarely alike where the sets themselves are nearly equal; what meets is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.llm.common import bounded, discard, materialize
from vitalframe.llm.components import connected
from vitalframe.llm.near_dedup import picked
from vitalframe.llm.words import WordHashes, shingles, slices, words

#: Words of a shingle, and levels of pivots.
WIDTH, LEVELS = 3, 3
#: A window is a little wider than R, against rounding; links themselves are decided in whole numbers.
R, SLACK = 0.1, 1e-9


def linked(common, n, m):
    """100 * intersection >= 90 * union, of numbers or columns."""
    return 190 * common >= 90 * (n + m)


def _digest(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), np.int64)[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        sizes, node, quarter = [], [], []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = shingles(hashes.of(words(text)), WIDTH)
            sizes.append(len(found))
            part = len(found) > 0 and ident is not None
            node.append(_digest(found) if part else None)
            quarter.append(found[found & np.uint64(3) == 0].view(np.int64) if part else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, quarter)]), pa.int32()), pa.array(np.concatenate(quarter)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), lists], names=["doc_id", "n_shingles", "node", "quarter"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        found = [shingles(hashes.of(words(t)), WIDTH) for t in batch.column(1).to_pylist()]
        found = [f for f in found if len(f)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "n", "members"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])), pa.array(np.concatenate(found))], names=["node", "s"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            out.append(len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.int64())], names=["a", "b", "common"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.empty(0, np.uint64)]
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            out.append(np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
        times = [len(f) for f in out[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), times)) for c in ("b", "a")] + [pa.array(np.concatenate(out).view(np.int64))], names=["pivot", "node", "s"])


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the members of both sets as x and y."""
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("members").alias(name))
    return pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width + SLACK)).cast("int")


def _open(regions: DataFrame, components: DataFrame) -> DataFrame:
    """Rows (region, node, ...) of the regions that span several components, with the component."""
    rows = regions.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("region").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("region")
    return rows.join(several, "region", "left_semi")


def _differing(rows: DataFrame, sets: DataFrame, stages: list[str]) -> DataFrame:
    """(pivot, node, s): the shingles that just one of node and pivot has, for rows (pivot, node)."""
    pairs = rows.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return materialize(_beside(pairs, sets).mapInArrow(_differences, "pivot long, node long, s long"), stages=stages)


def _centred(rows: DataFrame, sets: DataFrame, stages: list[str]) -> DataFrame:
    """rows (pivot, node, n, weight, pivot_n, common) with another pivot for each one's: the set that differs least from what over half of its sets hold."""
    flat = _differing(rows, sets, stages)
    many = rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("k"))
    most = flat.groupBy("pivot", "s").agg(F.count(F.lit(1)).alias("df")).join(many, "pivot").filter("2 * df > k").select("pivot", "s")
    within = flat.join(most, ["pivot", "s"]).groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("within"))
    apart = F.expr("n + pivot_n - 2 * (common + coalesce(within, 0))")
    centre = rows.join(within, ["pivot", "node"], "left").groupBy("pivot").agg(F.min(F.struct(apart.alias("apart"), "node", "n")).alias("c"))
    return rows.join(centre, "pivot").select("node", "n", "weight", F.col("c.node").alias("pivot"), F.col("c.n").alias("pivot_n")).distinct()


def _met(rows: DataFrame, sets: DataFrame, stages: list[str]) -> DataFrame:
    """(a, b), repeatedly: pairs of rows (pivot, node, n, pivot_n, common, most, component, by_distance, by_size) of one pivot and of different components that may link.

    Let X be the shingles that just one of x and its pivot p has. x and y link if 19 |X ^ Y| <= n + n2, and |X ^ Y| = |X| + |Y| - 2 |X & Y|.
    Sets linked with p are one component, so one of a pair is not (`far`). Then, in whole numbers, if x and y link,
    |X & Y| >= |X| - n div 9 for either, and if y is far, 38 |X & Y| > 19 |X| + pivot_n - n, which is never negative. So with shingles in one order for
    all of a pivot, the first that X and Y share is among the first |X| - need + 1 of each; those that no other X
    of the pivot has come first and are in no list. What follows the first shared one bounds the rest of the intersection.
    """
    far = F.expr("19 * size > n + pivot_n").alias("far")
    rows = rows.withColumn("size", F.expr("n + pivot_n - 2 * common")).filter("size > 0").withColumn("far", far)
    flat = _differing(rows, sets, stages)
    often = flat.groupBy("pivot", "s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("pivot", "node")
    listed = flat.join(often, ["pivot", "s"]).withColumn("rank", F.row_number().over(own.orderBy("df", "s"))).withColumn("shared", F.count(F.lit(1)).over(own))
    listed = listed.select("pivot", "node", "s", "rank", "shared").join(rows, ["pivot", "node"]).withColumn("rest", F.expr("shared - rank"))
    listed = materialize(listed.withColumn("need", F.expr("greatest(1, size - n div 9)")).filter("rest + 1 >= need"), stages=stages)
    kept = ("node", "n", "most", "component", "by_distance", "by_size", "size", "rest")
    left = listed.filter("far").select("pivot", "s", *kept)
    right = listed.filter("38 * (rest + 1) > 19 * size + pivot_n - n").select("pivot", "s", "far", *[F.col(c).alias(f"{c}2") for c in kept])
    near = "abs(by_distance - by_distance2) <= 1 and abs(by_size - by_size2) <= 1 and n2 <= most and n <= most2"
    pairs = left.join(right, ["pivot", "s"]).filter(f"component <> component2 and (not far or node < node2) and {near} and 19 * (size + size2 - 2 * (1 + least(rest, rest2))) <= n + n2")
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def links(sets: DataFrame, stages: list[str]) -> DataFrame:
    """(a, b): pairs of nodes that link, enough of them to connect all that links of the sets (node, n, members) do."""
    flat = sets.select("node", "members").mapInArrow(_flat, "node long, s long")
    often = flat.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Rows that are left have a partner; the lone shingles of a set come first in its order and have no region.
    known = flat.join(often, "s").join(sets.select("node", "n"), "node")
    own = Window.partitionBy("node")
    ranked = known.withColumn("rank", F.row_number().over(own.orderBy("df", "s"))).withColumn("m", F.count(F.lit(1)).over(own)).withColumn("weight", F.avg("df").over(own))
    prefix = ranked.filter("10 * m >= 9 * n and rank + (n - m) <= n - ceil(9 * n / 10.0) + 1")
    regions = materialize(prefix.select(F.col("s").alias("region"), "node", "n", "weight"), stages=stages)

    measured = found = components = None
    for level in range(LEVELS + 1):
        rows = regions if components is None else materialize(_open(regions, components).drop("component"), stages=stages)
        if level < LEVELS:
            rows = rows.select("region", "node", "n", "weight")
            pivots = rows.groupBy("region").agg(F.max(F.struct("weight", "node", "n")).alias("p"), F.count(F.lit(1)).alias("members")).filter("members > 1")
            near = rows.join(pivots.select("region", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "region").select("node", "n", "weight", "pivot", "pivot_n").distinct()
        else:
            near = _centred(rows.select("pivot", "node", "n", "weight", "pivot_n", "common").distinct(), sets, stages)
        near = materialize(near, stages=stages)
        fresh = near.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        fresh = fresh if measured is None else fresh.join(measured, ["a", "b"], "left_anti")
        new = materialize(_beside(fresh, sets).mapInArrow(_common, "a long, b long, common long"), stages=stages)
        measured = new if measured is None else measured.unionByName(new)
        size = sets.select("node", "n")
        sized = new.join(size.select(F.col("node").alias("a"), "n"), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
        more = materialize(sized.filter(linked(F.col("common"), F.col("n"), F.col("m"))).select("a", "b"), stages=stages)
        found = more if found is None else found.unionByName(more)
        components = connected(found, stages=stages)

        known = measured.select("a", "b", "common")
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "common")).withColumnsRenamed({"a": "node", "b": "pivot"})
        placed = near.join(both, ["node", "pivot"], "left").withColumn("common", F.when(F.col("node") == F.col("pivot"), F.col("n")).otherwise(F.col("common")))
        distance = 1 - F.col("common") / (F.col("n") + F.col("pivot_n") - F.col("common"))
        placed = placed.withColumn("by_distance", _cell(distance, R)).withColumn("by_size", _cell(F.log("n"), float(-np.log(1 - R))))
        up = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1))
        placed = placed.withColumn("d", up("by_distance")).withColumn("s", up("by_size"))
        regions = placed.select(F.xxhash64("pivot", "d", "s").alias("region"), "node", "n", "weight", "pivot", "pivot_n", "common", "by_distance", "by_size")

    rows = _open(regions, components).select("pivot", "node", "n", "pivot_n", "common", "component", "by_distance", "by_size").distinct()
    rows = materialize(rows, stages=stages)
    # Shingles that no other set in an open cell has are in none of the intersections still asked for. So I <= min(m, m2) for the
    # rest m of a set, and as a link needs 19 I >= 9 (n + n2), each set has a largest size that a partner may have.
    left = flat.join(rows.select("node").distinct(), "node", "left_semi")
    shared = left.join(left.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("s"), "s", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.join(shared, "node").withColumn("most", F.expr("(19 * m) div 9 - n")).filter("10 * m >= 9 * n")
    rows = materialize(rows.drop("m"), stages=stages)
    pairs = _met(rows, sets, stages).distinct().join(measured, ["a", "b"], "left_anti")
    last = _beside(materialize(pairs, stages=stages), sets).mapInArrow(_common, "a long, b long, common long")
    size = sets.select("node", "n")
    last = last.join(size.select(F.col("node").alias("a"), "n"), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("m")), "b").filter(linked(F.col("common"), F.col("n"), F.col("m")))
    return found.unionByName(last.select("a", "b"))


def join_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, component_id.

    A text's set: its distinct shingles of three words, A-Z lower-cased; a text of fewer words is one shingle. Documents
    with 100 * intersection >= 90 * union link; component_id is the smallest doc_id reachable by links. A null text, or one without
    words, has an empty set and links with nothing. A null doc_id links with nothing and has a null component_id. Rows
    that share a doc_id are one document with several texts, so what links to any of them is connected. Equal
    sets are one class from the start, however many rows repeat them. Texts count whole at any length, other
    columns are ignored, and an empty table gives no rows.
    """
    stages: list[str] = []
    docs = bounded(docs.select("doc_id", "text"))
    signed_rows = materialize(docs.mapInArrow(_signed, "doc_id long, n_shingles long, node long, quarter array<long>"))
    signed = signed_rows.filter("node is not null")
    lone = signed.select("node", F.explode("quarter").alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    classes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), stages=stages)
    left = materialize(classes.join(lone, "node", "left").filter("10 * (n - coalesce(lone, 0)) >= 9 * n").select("node", "rep"), stages=stages)
    texts = picked(docs, left.select(F.col("rep").alias("doc_id")).distinct(), "left_semi")
    sets = texts.mapInArrow(_sets, "node long, n long, members binary")
    sets = materialize(sets.join(left.select("node"), "node", "left_semi").dropDuplicates(["node"]), stages=stages)

    several = signed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("x")).filter("b <> x").select("doc_id", "b")
    same_id = signed.join(several, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    joined = connected(links(sets, stages).unionByName(same_id), stages=stages)
    named = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "component").select("node", "component_id"))
    discard(docs.sparkSession, stages)
    out = signed_rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
