"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are ranked by a seeded shuffle within their source, placed at the fraction (rank + 1/2) / source
rows, and the line of all rows sorted by that fraction is cut into equal runs. Every run holds each
source in its share, within one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.llm.common import seeded_rank, text_crc32


def stratified_shards(docs: DataFrame, shards: int = 8, seed: str = "shard-7", stratum: str = "source", slices: int = 4096) -> DataFrame:
    """Give every row of docs (doc_id, text, <stratum>) a shard and a slot; law `rows`.

    Returns doc_id, size (UTF-8 bytes of text plus 1; null text: 1), text_crc32 (null text: null),
    law ('rows'), source, shard (0..shards-1), slot (0.. without gaps in a shard), grown_shard (null:
    that column belongs to another law). Shard counts differ by one at most. A null stratum is a
    stratum of its own; equal rows are all kept; ties between them do not matter, as they are alike.
    Null ids are shuffled as the text 'null'. An empty table gives an empty result.

    The place in the line of all rows is found by slices of the fraction, which hold near-equal
    numbers of rows whatever the sizes of the strata, plus the counts of the slices before.
    """
    rows = docs.select(
        "doc_id",
        F.when(F.col(stratum).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(stratum))).alias("_stratum"),
        F.col(stratum).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
    )
    ranked = seeded_rank(rows, "_stratum", "doc_id", seed, ["doc_id", "text_crc32", "size"])
    # Integers only: the fraction (2 rank + 1) / (2 rows) is compared through its slice and then as a double.
    placed = ranked.withColumn("_f", (2 * F.col("rank") + 1) / (2 * F.col("group_rows")).cast("double"))
    placed = placed.withColumn("_cut", F.floor(F.col("_f") * slices).cast("int"))
    cuts = placed.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.orderBy("_cut")  # at most `slices` rows
    offsets = cuts.select(
        "_cut",
        (F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_cut").orderBy("_f", "_stratum", "rank")
    lined = placed.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, "_cut")
    lined = lined.withColumn("_pos", F.col("_before") + F.col("_in"))
    base, extra = F.floor(F.col("_total") / shards), F.col("_total") % shards
    first = extra * (base + 1)  # rows in the shards that hold one more
    late = F.col("_pos") - first
    shard = F.when(F.col("_pos") < first, F.floor(F.col("_pos") / (base + 1))).otherwise(extra + F.floor(late / F.greatest(base, F.lit(1))))
    slot = F.when(F.col("_pos") < first, F.col("_pos") % (base + 1)).otherwise(late % F.greatest(base, F.lit(1)))
    return lined.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
