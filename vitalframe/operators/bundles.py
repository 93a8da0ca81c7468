"""Bundles processed as Batch or Transaction, written in one commit, and put together as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.operators.validate import bundle_errors


def _judged(entries: DataFrame, bundle: str, kind: str, order: str, error: Column) -> tuple[DataFrame, DataFrame]:
    """(entries with error, invalid and first_bad of their bundle; one row a bundle with its kind, invalid and first_bad).

    Bundles are aggregated and met again by a join, so that no window holds one.
    """
    rows = entries.withColumn("error", error)
    first = rows.groupBy(bundle).agg(F.min(F.when(F.col("error").isNotNull(), F.struct(order, "error"))).alias("first_bad"))
    wrong = F.when(F.col(kind) == "Collection", "a Collection cannot be processed").otherwise(F.col("error"))
    known = bundle_errors(entries, bundle, kind, order).select(bundle, F.col(kind).alias("_kind"), wrong.alias("invalid")).join(first, bundle)
    return rows.join(known.drop("_kind"), bundle), known.withColumnRenamed("_kind", kind)


def _applied(kind: str, order: str) -> Column:
    """Whether an entry is applied, before any rollback: in a Transaction those before the first failure, in a Batch all without one."""
    before = F.col("first_bad").isNull() | (F.col(order) < F.col(f"first_bad.{order}"))
    return F.col("invalid").isNull() & F.when(F.col(kind) == "Transaction", before).otherwise(F.col("error").isNull())


def process(entries: DataFrame, bundle: str, kind: str, order: str, error: Column) -> DataFrame:
    """One row a bundle: kind, invalid, applied, failures, first_error, committed.

    entries: one row an entry with its bundle, the bundle's kind, its place (unique in the bundle) and an id; error: what an entry fails with, or null.
    A bundle that is not valid as one, or is a Collection, is not processed: `invalid` says why, and nothing is applied. A Transaction
    stops at its first failure and is rolled back: `applied` counts the entries before it, failures is 1. A Batch goes on past failures.
    Bundles without entries have no row.
    """
    rows, known = _judged(entries, bundle, kind, order, error)
    counted = rows.groupBy(bundle).agg(F.sum(_applied(kind, order).cast("long")).alias("applied"), F.sum(F.col("error").isNotNull().cast("long")).alias("_bad"))
    valid = F.col("invalid").isNull()
    failures = F.when(~valid, 0).when(F.col(kind) == "Transaction", F.least("_bad", F.lit(1))).otherwise(F.col("_bad"))
    return known.join(counted, bundle).select(
        bundle, kind, "invalid", "applied", failures.cast("long").alias("failures"), F.when(valid, F.col("first_bad.error")).alias("first_error"),
        (valid & ((F.col(kind) == "Batch") | F.col("first_bad").isNull())).alias("committed"),
    )


def entry_errors(entries: DataFrame, bundle: str, kind: str, order: str, error: Column) -> DataFrame:
    """(bundle, order, error): every failure of the Batches, and the one that stopped a Transaction."""
    rows, _ = _judged(entries, bundle, kind, order, error)
    stopped = (F.col(kind) == "Batch") | (F.col(order) == F.col(f"first_bad.{order}"))
    return rows.filter(F.col("invalid").isNull() & F.col("error").isNotNull() & stopped).select(bundle, order, "error")


def applied_entries(entries: DataFrame, bundle: str, kind: str, order: str, error: Column) -> DataFrame:
    """The entries that stand after processing: of Transactions without a failure all, of Batches those without one. Columns unchanged."""
    rows, _ = _judged(entries, bundle, kind, order, error)
    kept = _applied(kind, order) & ((F.col(kind) == "Batch") | F.col("first_bad").isNull())
    return rows.filter(kept).select(*entries.columns)


def commit(entries: DataFrame, path: str, bundle: str, kind: str, order: str, error: Column) -> str:
    """Write the entries that stand as one new folder below path, and return its name. They are written beside it first; a single rename makes all of them visible, or none."""
    spark = entries.sparkSession
    number = uuid.uuid4().hex
    staged, final = f"{path}/_staged-{number}", f"{path}/commit-{number}"
    applied_entries(entries, bundle, kind, order, error).write.parquet(staged)
    files = spark._jvm.org.apache.hadoop.fs
    system = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.rename(files.Path(staged), files.Path(final)):
        raise OSError(f"{staged} could not be renamed")
    return final


def to_json(entries: DataFrame, bundle: str, kind: str, order: str, resource: str) -> DataFrame:
    """(bundle, json): one document a bundle with bundle_type and its entries (JSON texts in `resource`, in order); a document is as large as its bundle."""
    listed = F.array_sort(F.collect_list(F.struct(order, resource)))
    made = entries.groupBy(bundle, kind).agg(F.transform(listed, lambda e: e[resource]).alias("_e"))
    head = F.concat(F.lit('{"bundle_type":'), F.to_json(F.array(kind)).substr(F.lit(2), F.length(F.to_json(F.array(kind))) - 2))
    return made.select(bundle, F.concat(head, F.lit(',"entries":['), F.array_join("_e", ","), F.lit("]}")).alias("json"))
