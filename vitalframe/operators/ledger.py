"""Privacy budgets kept over a log of requests, and sums that are paid for from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.operators.privacy import gaussian_noise, laplace_noise


def spend(requests: DataFrame, key: str, order: list[str], epsilon: str, delta: str | None, epsilon_total: float, delta_total: float = 0.0) -> DataFrame:
    """requests with accepted, epsilon_spent and delta_spent (of the key, after the request).

    The requests of a key are taken in order; one is accepted if what is spent so far plus its own stays within both totals, and
    only then counts. So acceptance is a fold: a refused request leaves the state, and a smaller one after it may pass. Null and
    negative epsilon or delta are refused; NaN too. A null key is a key. A key's requests stream through one task, which keeps two numbers for the key it is at.
    """
    names = [*requests.columns]
    clash = {"accepted", "epsilon_spent", "delta_spent"} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    needs = requests.select("*", F.col(epsilon).cast("double").alias("_e"), (F.col(delta).cast("double") if delta else F.lit(0.0)).alias("_d"), F.struct(key).alias("_k"))
    # A state goes by the whole key, so that streaming needs no other column.
    needs = needs.withColumn("_first", F.coalesce(F.lag("_k").over(Window.partitionBy(key).orderBy(*order)) != F.col("_k"), F.lit(True))).drop("_k")
    schema = requests.schema.add("accepted", "boolean").add("epsilon_spent", "double").add("delta_spent", "double")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = d = 0.0
        for batch in batches:
            accepted, spent_e, spent_d = np.zeros(batch.num_rows, bool), np.empty(batch.num_rows), np.empty(batch.num_rows)
            columns = (batch.column(c).to_pylist() for c in ("_first", "_e", "_d"))
            for i, (first, x, y) in enumerate(zip(*columns, strict=True)):
                if first:
                    e = d = 0.0
                if x is not None and y is not None and x >= 0 and y >= 0 and e + x <= epsilon_total and d + y <= delta_total:
                    e, d, accepted[i] = e + x, d + y, True
                spent_e[i], spent_d[i] = e, d
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(accepted), pa.array(spent_e), pa.array(spent_d)], names=[*names, "accepted", "epsilon_spent", "delta_spent"])

    # The window has brought each key's rows together, in order: the function reads them as they come.
    return needs.mapInArrow(fold, schema)


def private_sums_budgeted(
    sums: DataFrame, requests: DataFrame, key: str, order: list[str], value: str, sensitivity: float, epsilon: str, epsilon_total: float, delta: str | None = None, delta_total: float = 0.0, seed: int | None = None
) -> DataFrame:
    """One row for each request: whether it was paid for, and if so the sum of its key with noise of its own, by Laplace, or by Gauss where delta is positive; else null.

    sums has one row for each key with the true sum in `value`; a key without one has the sum 0.
    """
    paid = spend(requests, key, order, epsilon, delta, epsilon_total, delta_total)
    joined = paid.join(sums.select(key, F.col(value).cast("double").alias("_s")), key, "left")
    scale = F.lit(float(sensitivity)) / F.nullif(F.col(epsilon).cast("double"), F.lit(0.0))
    noise = laplace_noise(1.0, seed) * scale
    if delta:
        gauss = gaussian_noise(1.0, seed) * F.sqrt(2 * F.ln(1.25 / F.nullif(F.col(delta).cast("double"), F.lit(0.0)))) * scale
        noise = F.when(F.col(delta) > 0, gauss).otherwise(noise)
    return joined.withColumn("private_sum", F.when(F.col("accepted"), F.coalesce("_s", F.lit(0.0)) + noise)).drop("_s")
