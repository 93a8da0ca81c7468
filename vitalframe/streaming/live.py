"""Structured Streaming over device readings: event-time windows, alerts and a smoothed value kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalframe.operators.series import alerts, device_message


def readings(lines: DataFrame, value: str = "value") -> DataFrame:
    """device_id, metric, value, timestamp_ms, ts of text lines, batch or stream; lines that cannot be read are left out."""
    found = lines.select(device_message(F.col(value)).alias("r")).filter("r is not null").select("r.*")
    return found.withColumn("ts", F.timestamp_millis("timestamp_ms"))


def window_stats(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(start, end, key, n, mean): event-time windows, with a watermark that bounds the state kept for late rows."""
    found = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "mean")


class Smoother(StatefulProcessor):
    """Exponential smoothing of each key's values in the order of ts, over micro-batches."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for x in frame["value"]:
            last = float(x) if last is None else self.alpha * float(x) + (1 - self.alpha) * last
            out.append(last)
        self.last.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "ts": frame["ts"], "value": frame["value"], "smoothed": out})

    def close(self) -> None:
        pass


def smoothed(stream: DataFrame, key: str, alpha: float) -> DataFrame:
    """(key, ts, value, smoothed) of a stream with ts and value. Needs the RocksDB state store."""
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Smoother(alpha), outputStructType=f"key {kind}, ts timestamp, value double, smoothed double", outputMode="Append", timeMode="None"
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Read all there is now and stop."""
    stream.writeStream.outputMode(mode).format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema, glob: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance, sd) of all values so far, null and NaN left out: count, mean and sum of squared gaps are the state, merged on the JVM side. For update mode."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return stream.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("sd"))


class Ring(StatefulProcessor):
    """The last `size` values of each key in the order of ts, and how many were dropped."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "ts timestamp, value double")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.items.get()]
        dropped = self.dropped.get()[0] if self.dropped.exists() else 0
        new = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        # Only the last ones can stay, whatever the size of the batch.
        dropped += len(held) + len(new)
        held = (held + list(zip((t.to_pydatetime() for t in new["ts"].iloc[-self.size :]), map(float, new["value"].iloc[-self.size :]), strict=True)))[-self.size :] if self.size else []
        dropped -= len(held)
        self.items.put(held) if held else self.items.clear()
        self.dropped.update((dropped,))
        yield pd.DataFrame({"key": [key[0]], "dropped": [dropped], "items": [[v for _, v in held]]})

    def close(self) -> None:
        pass


def ring(stream: DataFrame, key: str, size: int) -> DataFrame:
    """(key, dropped, items): after each batch the last values of its keys, oldest first. The stream has ts and value. Needs the RocksDB state store; for update mode."""
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Ring(size), outputStructType=f"key {kind}, dropped long, items array<double>", outputMode="Update", timeMode="None")


def alert_rows(stream: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """(keep, metric, value, rule, message): an alert for each reading (metric, value) and rule that it matches."""
    return alerts(stream, rules).select(*keep, "metric", "value", "rule", "message")


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Read all there is now, write each micro-batch under path/batch=<id>, and stop.

    A batch that is run again after a failure replaces its own folder, so each counts once. `then` is applied to each batch first.
    """

    def put(batch: DataFrame, number: int) -> None:
        (then(batch) if then else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row of each key among all batches that write_batches() put under a path."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_x")).select(*keys, "_x.*")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that transformWithState needs, for streams started inside; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
