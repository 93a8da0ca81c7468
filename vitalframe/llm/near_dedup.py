"""MinHash near-dedup by an inverted join on signature coordinates.

Each distinct shingle set (equal sets are one class from the start) is posted under each of its K
minimum hashes. Two sets with Jaccard similarity 0.75 share a coordinate with probability 0.75, so of
K = 64 they share fewer than T = 28 with probability below 1e-6; pairs that share T or more are candidates
and are then confirmed on the full sets.

Counting uses two well-known savings. Prefix: of its coordinates, rarest first, a set needs only the
first K - T + 1 to meet every partner, so common passages fall into the skipped rest. Skip merging:
lists of one member are dropped at once, and so is a set with more than K - T of them.

Links come in two steps, so that no group of copies is expanded into all its pairs. First each set is
compared with the member of its lists that has the smallest doc_id (if they share T lists at least). What this links is one
component. Then lists that still span several components are compared across components, and only there.
Before that, the members of such lists lose those that cannot be linked: shingles that no other member has
are in no intersection, which bounds the overlap of any pair exactly. Loosely edited copies of one text and
texts around one common passage have many of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.llm.common import bounded, discard, materialize, text_digest
from vitalframe.llm.components import connected
from vitalframe.llm.words import WordHashes, shingles, slices, words

#: Coordinates of a signature, and how many a candidate pair must share.
K, T = 64, 28
#: Ids up to this number (16 bytes each) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000

_rng = np.random.default_rng(20_240_607)
_A = (_rng.integers(0, 1 << 63, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """The K minimum hashes of a non-empty set."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (_A[:, None] * found[i : i + 2048] + _B[:, None]).min(axis=1))
    return least


def _digest(found: np.ndarray) -> int:
    """The node of a non-empty set: a 64-bit hash of it."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), np.int64)[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        sizes, nodes, signs = [], [], []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = shingles(hashes.of(words(text)))
            sizes.append(len(found))
            if len(found) and ident is not None:
                nodes.append(_digest(found))
                signs.append(signature(found).view(np.int64))
            else:
                nodes.append(None)
        keys = pa.array(np.concatenate(signs) if signs else np.empty(0, np.int64))
        lengths = [0 if x is None else K for x in nodes]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), keys)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists],
            names=["doc_id", "digest", "n_shingles", "node", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        found = [f for f in (shingles(hashes.of(words(t))) for t in batch.column(1).to_pylist()) if len(f)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "members"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
        owner = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found))], names=["node", "s"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        overlap, linked = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            overlap.append(both)
            linked.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).columns, pa.array(overlap, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "overlap", "linked"])


def picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with ids (doc_id, and other columns that docs has): by broadcast while they are few enough, else by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, ids.columns, how)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, stages: list[str]) -> DataFrame:
    """(node, members): the full sets of nodes (node), from the text of each one's first document."""
    wanted = materialize(classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id")), stages=stages)
    found = picked(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "left_semi").mapInArrow(_sets, "node long, members binary")
    # Other rows of these ids may hold other texts, or the same one again.
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, stages: list[str]) -> DataFrame:
    """The pairs (a, b) of nodes with the overlap of their full sets and whether that links them."""
    sets = materialize(full_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), classes, docs, stages), stages=stages)
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long, overlap long, linked boolean")


def _open(members: DataFrame) -> DataFrame:
    """Rows of the lists (key) that span more than one component."""
    keys = members.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("key")
    return members.join(keys, "key", "left_semi")


def _lone_shingles(nodes: DataFrame, classes: DataFrame, docs: DataFrame, stages: list[str]) -> DataFrame:
    """(node, lone): how many shingles each of the nodes (node) has that no other of them has; none: no row.

    These cannot be in an intersection, so a set's links are bounded by the rest.
    """
    flat = full_sets(nodes, classes, docs, stages).mapInArrow(_members, "node long, s long")
    return flat.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))


def _judged(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, digest (of the text), n_shingles, node, component (of nodes), component_id; see near_duplicates()."""
    stages: list[str] = []
    keep = partial(materialize, stages=stages)
    docs = bounded(docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest")))
    signed = materialize(docs.mapInArrow(_signed, "doc_id long, digest binary, n_shingles long, node long, sig array<long>"))
    classes = keep(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    postings = classes.select("node", "rep", "n", F.explode("sig").alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rep", "node"))["node"].alias("lead")).filter("members > 1")
    shared = keep(postings.drop("rep").join(lists, "key"))

    stars = shared.filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= T)
    stars = keep(stars.select(F.col("lead").alias("a"), F.col("node").alias("b")))
    compared = keep(confirm(stars, classes, docs, stages))
    joined = connected(compared.filter("linked").select("a", "b"), stages=stages)
    # The member that a set overlaps most with is its centre; a centre is its own.
    centres = compared.groupBy(F.col("b").alias("node")).agg(F.max(F.struct("overlap", F.col("a").alias("centre"))).alias("x")).select("node", "x.centre", "x.overlap")

    own = Window.partitionBy("node")
    prefix = (
        shared.withColumn("rank", F.row_number().over(own.orderBy("members", "key")))
        .withColumn("single", K - F.count(F.lit(1)).over(own))
        .filter(F.col("rank") + F.col("single") <= K - T + 1)
        .select("node", "n", "key")
    )
    prefix = prefix.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_members = keep(_open(prefix))
    lone = keep(_lone_shingles(open_members.select("node"), classes, docs, stages))
    linkable = open_members.join(lone, "node", "left").withColumn("m", F.col("n") - F.coalesce("lone", F.lit(0))).filter("4 * m >= 3 * n").drop("lone")
    linkable = linkable.join(centres, "node", "left").withColumn("overlap", F.coalesce("overlap", "n")).withColumn("centre", F.coalesce("centre", "node"))
    left = keep(_open(linkable))
    # Sets around one centre meet once, by the centre, and share at most what the smaller overlap holds of it and the
    # smaller rest outside of it. Others meet by each key that they share.
    # Sizes are in bands as wide as a link allows; each set goes into its own and the next, and a pair is taken from the upper one.
    columns = ("node", "n", "m", "component", "centre", "overlap", "band")
    again = lambda df, *keys: df.select(*keys, *[F.col(c).alias(f"{c}2") for c in columns if c not in keys])
    ordered = F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")
    apart = F.col("component") < F.col("component2")
    left = left.withColumn("band", F.floor(F.log("n") / F.lit(math.log(4 / 3) + 1e-9)))
    cell = F.explode(F.array("band", F.col("band") + 1)).alias("cell")
    upper = F.col("cell") == F.greatest("band", "band2")
    enough = lambda most: F.expr(f"7 * ({most}) >= 3 * (n + n2)")
    around = left.select(*columns).distinct().select("*", cell)
    left = left.select("*", cell)
    inside = around.join(again(around, "centre", "cell"), ["centre", "cell"]).filter(apart & upper & enough("least(overlap, overlap2) + least(m - overlap, m2 - overlap2)")).select(*ordered)
    between = left.join(again(left, "key", "cell"), ["key", "cell"]).filter(apart & upper & (F.col("centre") != F.col("centre2")) & enough("least(m, m2)")).select(*ordered).distinct()
    across = keep(inside.unionByName(between).join(stars, ["a", "b"], "left_anti"))
    signs = classes.select("node", "sig")
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    close = (
        across.join(signs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
        .join(signs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
        .filter(same >= T)
        .select("a", "b")
    )
    more = confirm(keep(close), classes, docs, stages)
    final = connected(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.filter("linked").select("a", "b")), stages=stages)

    named = classes.select("node", "rep").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "component").select("node", "component", "component_id"))
    discard(docs.sparkSession, stages)
    return signed.select("doc_id", "digest", "n_shingles", "node").join(named, "node", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Links: shingle sets (five words) with 100 * intersection >= 75 * union. component_id is the smallest
    doc_id reachable by links; kept tells whether that is the document itself. A null text, or one
    without words, has an empty set and is linked with nothing. A null doc_id is linked with nothing,
    has a null component_id and is kept. Rows that share a doc_id are each
    judged by their own text. Other columns are ignored, texts count whole, and an empty table gives no rows.
    """
    found = _judged(docs)
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near-duplicates, columns unchanged: that of the smallest doc_id, then of the smallest digest of the text.

    Rows with different texts that are linked with nothing all stay, whether they share a doc_id or not; so do rows without words or id.
    Of rows that agree in doc_id and text, the first by their other columns stays.
    """
    row = F.struct("doc_id", "digest")
    stages: list[str] = []
    judged = materialize(_judged(docs).filter("component is not null").select("component", row.alias("row")), stages=stages)
    first = judged.groupBy("component").agg(F.min("row").alias("first"))
    gone = materialize(judged.join(first, "component").filter("row <> first").select("row.*").distinct())
    again = materialize(judged.join(first, "component").filter("row = first").groupBy("row").count().filter("count > 1").select("row.*"))
    discard(docs.sparkSession, stages)
    # A digest column of the documents' own stays out of the way.
    ids, digest = ["doc_id", "_text_digest"], text_digest(F.col("text"))
    named = lambda rows: rows.withColumnRenamed("digest", "_text_digest")
    left = picked(docs.withColumn("_text_digest", digest), named(gone), "left_anti")
    if not again.isEmpty():
        order = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        single = picked(left, named(again), "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy(*ids).orderBy(order))).filter("_place = 1").drop("_place")
        left = picked(left, named(again), "left_anti").unionByName(single)
    return left.drop("_text_digest")
