"""Windows over ordered rows of a key: moving statistics, smoothing, counted windows, sessions, last rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(order: str | list[str]) -> list[str]:
    """The order's columns: one, or several where the first has ties."""
    return [order] if isinstance(order, str) else list(order)


def _frame(key: str, order: str | list[str], width: int):
    ordered = Window.partitionBy(key).orderBy(*_by(order))
    return ordered, ordered.rowsBetween(1 - width, 0)


def _full(frame: DataFrame, key: str, order: str | list[str], width: int, name: str, value: Column) -> DataFrame:
    """Rows at which a full window of `width` ends, with its value; none for a width under 1."""
    if width < 1:
        return frame.withColumn(name, F.lit(None).cast("double")).limit(0)
    ordered, window = _frame(key, order, width)
    return frame.withColumns({name: value.over(window), "_i": F.row_number().over(ordered)}).filter(F.col("_i") >= width).drop("_i")


def moving_average(frame: DataFrame, key: str, order: str | list[str], value: str, width: int) -> DataFrame:
    return _full(frame, key, order, width, "moving_average", F.avg(value))


def sliding_sum(frame: DataFrame, key: str, order: str | list[str], value: str, width: int) -> DataFrame:
    return _full(frame, key, order, width, "sliding_sum", F.sum(value))


def rolling_std(frame: DataFrame, key: str, order: str | list[str], value: str, width: int) -> DataFrame:
    """Sample deviation of full windows; 0 for a width of 1."""
    out = _full(frame, key, order, width, "rolling_std", F.stddev_samp(value))
    return out.withColumn("rolling_std", F.coalesce("rolling_std", F.lit(0.0)))


#: Rows that the smoothing takes at once.
EMA_ROWS = 64


def smoothed_run(x: np.ndarray, last: float, alpha: float) -> np.ndarray:
    """alpha * x + (1 - alpha) * the value before, one after the other from `last`, by blocks: each is one product with a triangular matrix."""
    r = 1 - alpha
    gap = np.subtract.outer(np.arange(EMA_ROWS), np.arange(EMA_ROWS))
    weights = np.where(gap >= 0, alpha * np.power(r, np.maximum(gap, 0)), 0.0)
    decay = np.power(r, np.arange(1, EMA_ROWS + 1))
    out = np.empty(len(x))
    for i in range(0, len(x), EMA_ROWS):
        part = x[i : i + EMA_ROWS]
        n = len(part)
        out[i : i + n] = weights[:n, :n] @ part + decay[:n] * last
        last = out[i + n - 1]
    return out


def ema(frame: DataFrame, key: str, order: str | list[str], value: str, alpha: float, *keep: str) -> DataFrame:
    """(key, order, value, keep, ema): ema is the first value, then alpha * x + (1 - alpha) * ema. Null values are left out.

    A recurrence: rows are sorted by key and order in their partitions and read once as Arrow batches, with
    one carried number, so a key of any size needs no more memory than a batch.
    """
    names = [key, *_by(order), value, *keep]
    rows = frame.filter(F.col(value).isNotNull()).select(key, *_by(order), F.col(value).cast("double").alias(value), *keep)
    sorted_ = rows.withColumn("_k", F.xxhash64(key)).repartition(key).sortWithinPartitions(key, *_by(order))

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column("_k").to_numpy(zero_copy_only=False), batch.column(value).to_numpy(zero_copy_only=False)
            out = np.empty(len(x))
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(x)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a or keys[a] != last_key:
                    last = x[a]  # the first value of a key is its own average
                out[a:b] = smoothed_run(x[a:b], last, alpha)
                last = out[b - 1]
            last_key = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(out)], names=[*names, "ema"])

    return sorted_.mapInArrow(smooth, rows.schema.add("ema", "double"))


def counted_windows(frame: DataFrame, key: str, order: str | list[str], size: int) -> DataFrame:
    """Add `window`: 0 for the first `size` rows of a key, then 1, ...; the last one may be short."""
    return frame.withColumn("window", ((F.row_number().over(Window.partitionBy(key).orderBy(*_by(order))) - 1) / size).cast("long"))


def sliding_counted_windows(frame: DataFrame, key: str, order: str | list[str], size: int, step: int) -> DataFrame:
    """Rows with `window`, once for each full window of `size` rows that begins at a multiple of `step`."""
    every = Window.partitionBy(key)
    placed = frame.withColumns({"_i": F.row_number().over(every.orderBy(*_by(order))) - 1, "_n": F.count(F.lit(1)).over(every)})
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / F.lit(step)), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("_i") / F.lit(step)), F.floor((F.col("_n") - size) / F.lit(step))).cast("long")
    spread = placed.withColumns({"_a": first, "_b": last}).filter("_a <= _b and _n >= " + str(size))
    return spread.withColumn("window", F.explode(F.sequence("_a", "_b"))).drop("_i", "_n", "_a", "_b")


def sessions(frame: DataFrame, key: str, arrival: str, ms: str, gap: int) -> DataFrame:
    """Add `session` (from 0): a new one begins where the time since the row before is over `gap` or negative."""
    ordered = Window.partitionBy(key).orderBy(arrival)
    away = F.col(ms) - F.lag(ms).over(ordered)
    begins = F.coalesce(((away > gap) | (away < 0)).cast("long"), F.lit(0))
    return frame.withColumn("_new", begins).withColumn("session", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ring(frame: DataFrame, key: str, order: str | list[str], capacity: int) -> DataFrame:
    """The last `capacity` rows of a key, with `dropped`: how many came before them."""
    sizes = frame.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - capacity, F.lit(0)).alias("dropped"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in _by(order)]))
    return frame.withColumn("_r", back).filter(F.col("_r") <= capacity).drop("_r").join(sizes, key)


def alerts(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each reading and rule of its metric that fires, batch or stream.

    readings: metric, value, ...; rules (broadcast by Spark where they are small enough): metric, rule, kind (above, below, outside), low, high.
    above and below include their bound; outside does not include its bounds.
    """
    fires = F.expr("(kind = 'above' and value >= high) or (kind = 'below' and value <= low) or (kind = 'outside' and (value < low or value > high))")
    hit = readings.join(rules, "metric").filter(fires)
    whole = (F.col("value") == F.floor("value")) & (F.abs("value") < 1e15)
    text = F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return hit.withColumn("message", F.concat("metric", F.lit(" triggered alert: "), text)).drop("kind", "low", "high")


def device_message(text: Column) -> Column:
    """`device_id,metric,value,timestamp_ms` as a struct; null unless it has four parts that can be read."""
    parts = F.split(text, ",")
    number, ms = F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    good = (F.size(parts) == 4) & number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & ms.rlike(r"^[+-]?\d{1,18}$")
    fields = F.struct(
        F.get(parts, F.lit(0)).alias("device_id"), F.get(parts, F.lit(1)).alias("metric"),
        number.try_cast("double").alias("value"), ms.try_cast("long").alias("timestamp_ms"),
    )
    return F.when(good, fields)
