"""Tables written once in the folder that driver and executors share, for code that reads them again and again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local default, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/vitalframe"
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later passes read the files, and a lost executor costs only its running tasks."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what written() wrote for these frames, once nothing reads them any more."""
    for frame in frames:
        spark = frame.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(frame._written_to)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
