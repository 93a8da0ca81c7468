"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of an Arrow batch that is sent to a Python task; a longer row stands alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a default where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/vitalframe"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, partition_by: list[str] | None = None, stages: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files outlive any executor, so a lost one costs only its running tasks. The folder is added to `stages`, for discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if stages is not None:
        stages.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, stages: list[str]) -> None:
    """Delete folders that materialize() wrote and that nothing reads any more."""
    for path in stages:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    stages.clear()


def bounded(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches for Python tasks are bounded by bytes (BATCH_BYTES), so that long texts do not meet in one."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def text_crc32(col) -> F.col:
    """Unsigned CRC-32 of the UTF-8 bytes; null stays null."""
    return F.crc32(F.encode(col, "UTF-8"))


def text_digest(col):
    """The 16 bytes of the MD5 of a text; null stays null."""
    return F.unhex(F.md5(F.encode(col, "UTF-8")))


def id_remainder(col, modulus: int):
    """crc32 of the id written as text, modulo; the fold of a document. A null id has no fold (null)."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % F.lit(modulus)


def seeded_rank(df: DataFrame, group: str, ident: str, seed: str, ties: list[str], buckets_hex: int = 3) -> DataFrame:
    """Add `rank` (0-based, long) and `group_rows`: each row's place in its group's seeded shuffle.

    A keyed MD5 of the id orders the rows. The first hex digits cut every group into 16**buckets_hex
    slices, ranked apart and shifted by the sizes of the slices before, so that no task ever holds a
    whole group. Only pre-aggregated slice counts meet per group.
    """
    keyed = df.withColumn("_h", F.md5(F.encode(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(ident).cast("string"), F.lit("null"))), "UTF-8")))
    keyed = keyed.withColumn("_slice", F.substring("_h", 1, buckets_hex))
    sizes = keyed.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(group)
    offsets = sizes.select(
        group,
        "_slice",
        (F.sum("_n").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_group).alias("group_rows"),
    )
    inside = Window.partitionBy(group, "_slice").orderBy("_h", *ties)
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [group, "_slice"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_h", "_slice", "_in", "_before")


def keep_by_text(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs, all columns as they were, whose text passes: judge() gives, once a task, a function from texts to flags."""
    at = docs.columns.index("text")

    def kept(batches):
        passes = judge()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(at).to_pylist()), pa.bool_()))

    return bounded(docs).mapInArrow(kept, docs.schema)
