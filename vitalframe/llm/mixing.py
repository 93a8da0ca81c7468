"""Mixing sources to target weights by Pfair scheduling (rows move by DataFrame functions only).

Each source's rows, in a seeded shuffle, are cut into blocks, and a slot of the mixture takes one block.
Let every source that still has blocks progress in proportion to its weight, one block a slot together.
The slot in which this ideal starts block j is the block's release, the one in which it ends its last
(release and deadline are floor(j / w) and ceil((j + 1) / w) for a share w, until a source runs out).
Earliest-deadline-first over the released blocks meets every deadline and leaves, after any number of
slots, each source less than one block away from its exact share.

Every row appears once. When a source runs out, the others share its slots in proportion to their
weights. No row is dropped or repeated; sources of weight 0 follow after all others, in equal parts.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import seeded_rank

#: Blocks that are put into one batch of the schedule, least rows of a block, and most blocks of a schedule (besides one a source): it is made on the driver.
BATCH, LEAST_ROWS, MOST_BLOCKS = 100_000, 16, 1_000_000
_PLAN = pa.schema([("_key", pa.string()), *[(k, pa.int64()) for k in ("block", "round", "release", "deadline", "slot")]])


def source_weights(rows: DataFrame, key: str, weights: dict[str, float] | None, alpha: float) -> list[tuple[str, int, Fraction]]:
    """Key, rows and weight of every source, by key. Without weights, a source's weight is n ** alpha.

    A weight that is missing, negative or not finite counts as 0. One row per source reaches the driver.
    """
    counts = sorted((r[0], r[1]) for r in rows.groupBy(key).agg(F.count(F.lit(1))).collect())

    def weight(k: str, n: int) -> Fraction:
        if weights is None:
            return Fraction(n**alpha)
        found = float(weights.get(k[1:], 0.0)) if k[:1] == "s" else 0.0
        return Fraction(repr(found)) if 0 < found < math.inf else Fraction(0)  # 0.3 is three tenths, not the nearest double

    return [(k, n, weight(k, n)) for k, n in counts]


def earliest_deadline_first(sources: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) slot by slot, for sources of so many blocks and of so large an integer weight above 0.

    All in whole numbers. After a virtual time v the ideal has given a source min(blocks, weight * v)
    blocks; with the sources in the order in which they run out, the slots used by v are the blocks of
    those that have run out and v times the weights of the others.
    """
    order = sorted(range(len(sources)), key=lambda i: Fraction(sources[i][0], sources[i][1]))
    gone, left = [0], [sum(w for _, w in sources)]
    for i in order:
        gone.append(gone[-1] + sources[i][0])
        left.append(left[-1] - sources[i][1])

    def phase(j: int, w: int, low: int) -> int:
        """How many sources have run out by j / w, `low` at least."""
        if low == len(order) or sources[order[low]][0] * w > j * sources[order[low]][1]:
            return low
        return bisect_right(order, False, lo=low, key=lambda i: sources[i][0] * w > j * sources[i][1])

    at = [0] * len(sources)

    def window(i: int, j: int) -> tuple[int, int]:
        w = sources[i][1]
        a = phase(j, w, at[i])
        b = at[i] = phase(j + 1, w, a)
        return gone[a] + j * left[a] // w, gone[b] - (-(j + 1) * left[b] // w)

    waiting, ready = [], []
    for i in range(len(sources)):
        release, deadline = window(i, 0)
        waiting.append((release, deadline, i, 0))
    heapq.heapify(waiting)
    for slot in range(gone[-1]):
        while waiting and waiting[0][0] <= slot:
            release, deadline, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        yield i, j, release, deadline
        if j + 1 < sources[i][0]:
            release, deadline = window(i, j + 1)
            heapq.heappush(waiting, (release, deadline, i, j + 1))


def schedule(sources: list[tuple[str, int, Fraction]], slots: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """The slot of each block: (_key, block, round, release, deadline, slot), counted from the start of the mixture; a round is `slots` slots.

    One pass over the blocks that holds one block a source and a batch.
    """
    start = 0
    parts = [[x for x in sources if x[2] > 0], [(k, n, Fraction(1)) for k, n, w in sources if w <= 0]]
    for part in parts:
        whole = math.lcm(*[w.denominator for _, _, w in part])
        blocks = [(-(-n // block_rows), int(w * whole)) for _, n, w in part]
        found = enumerate(earliest_deadline_first(blocks), start)
        while rows := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_pydict(
                {
                    "_key": [part[i][0] for _, (i, _, _, _) in rows],
                    "block": [j for _, (_, j, _, _) in rows],
                    "round": [slot // slots for slot, _ in rows],
                    "release": [start + r for _, (_, _, r, _) in rows],
                    "deadline": [start + d for _, (_, _, _, d) in rows],
                    "slot": [slot for slot, _ in rows],
                },
                _PLAN,
            )
        start += sum(b for b, _ in blocks)


def block_size(rows: int) -> int:
    """Rows of a block: so many that a schedule has MOST_BLOCKS full ones at most, whatever the input."""
    return max(LEAST_ROWS, -(-rows // MOST_BLOCKS))


def _placed(docs: DataFrame, keep: list[str], weights: dict[str, float] | None, alpha: float, slots: int, block_rows: int | None, seed: str) -> DataFrame:
    """(_row: struct of the `keep` columns) with the columns of the schedule."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    source = F.col("source")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    rows = docs.select(key.alias("_key"), F.struct(*quoted).alias("_row"), F.col("doc_id").alias("_id"))
    sources = source_weights(rows, "_key", weights, alpha)
    block_rows = block_rows or block_size(sum(n for _, n, _ in sources))
    plan = docs.sparkSession.createDataFrame(pa.Table.from_batches(schedule(sources, slots, block_rows), _PLAN))
    ranked = seeded_rank(rows, "_key", "_id", seed, ["_id"]).withColumn("block", F.expr(f"rank div {block_rows}"))
    return ranked.join(plan, ["_key", "block"]).select(
        "_row", F.col("rank").alias("source_rank"), "block", "round", "release", "deadline", "slot",
        (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("mix_position"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, slots: int = 100, block_rows: int | None = None,
        seed: str = "mix-1", keep: list[str] | None = None) -> DataFrame:
    """Order all rows of docs (doc_id, source) as one mixture of its sources.

    weights: target weight by source (missing ones count as 0: these sources come after all others);
    None: rows ** alpha. Returns the `keep` columns (default doc_id, source) with source_rank, block,
    round (of `slots` slots), release, deadline, slot and mix_position (slot * block_rows + place in the block: unique and
    rising along the mixture; a source's last block may be short). block_rows: None for block_size(rows). A null source is a source of its own;
    equal rows are all kept; null ids are shuffled as the text 'null'; an empty table gives no rows.
    """
    return _placed(docs, keep or ["doc_id", "source"], weights, alpha, slots, block_rows, seed).select("_row.*", "source_rank", "block", "round", "release", "deadline", "slot", "mix_position")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, slots: int = 100, block_rows: int | None = None, seed: str = "mix-1") -> DataFrame:
    """The rows of docs themselves, all columns as they were, range-partitioned and sorted by their place in the mixture."""
    placed = _placed(docs, docs.columns, weights, alpha, slots, block_rows, seed)
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("_row.*")
