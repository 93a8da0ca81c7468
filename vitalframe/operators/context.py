"""Checks of clinical rows against a context of tables: code systems, units, allowed units and reference ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.exprs import ascii_lower, blank, safe_div

#: A small context for examples.
DEMO_UNITS = ["mg/dL", "mmHg", "bpm", "g/dL", "%", "kg", "cm", "mmol/L", "MG/DL"]
DEMO_ALLOWED = [("2345-7", "mg/dL"), ("2345-7", "mmol/L")]
DEMO_SNOMED = ["44054006", "38341003"]
DEMO_RANGES = [("2345-7", "mg/dL", 70.0, 99.0), ("2345-7", "mmol/L", 3.9, 5.5)]


@dataclass
class Context:
    """Tables of what is known: units (unit), allowed (code, unit: the codes and their units), snomed (code), ranges (code, unit, low, high).

    They may be of any size: rows meet them by key, and Spark broadcasts a table only if it is small enough.
    """

    units: DataFrame
    allowed: DataFrame
    snomed: DataFrame
    ranges: DataFrame

    @classmethod
    def demo(cls, spark: SparkSession) -> Context:
        one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
        return cls(one(DEMO_UNITS, "unit"), spark.createDataFrame(DEMO_ALLOWED, "code string, unit string"), one(DEMO_SNOMED, "code"), spark.createDataFrame(DEMO_RANGES, "code string, unit string, low double, high double"))


def _flag(rows: DataFrame, known: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """rows with a flag: whether their keys are in the table. A key that repeats there changes nothing."""
    marks = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct().withColumn(name, F.lit(True))
    on = None
    for k, value in keys.items():
        same = value == F.col(f"_k_{k}")
        on = same if on is None else on & same
    return rows.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(*[f"_k_{k}" for k in keys])


def reference_range(rows: DataFrame, context: Context, code: str = "code", unit: str = "unit") -> DataFrame:
    """rows with `low` and `high` of their (code, unit), null without one. Of several ranges for one key the smallest low and largest high hold."""
    ranges = context.ranges.groupBy(F.col("code").alias("_rc"), F.col("unit").alias("_ru")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return rows.join(ranges, (F.col(code) == F.col("_rc")) & (F.col(unit) == F.col("_ru")), "left").drop("_rc", "_ru")


def _base(fields: dict[str, str], at: str, what: str) -> Column:
    checks = [F.when(blank(f), f"{name}: is empty") for name, f in fields.items()]
    return F.coalesce(*checks, F.when(F.coalesce(F.col(at) <= 0, F.lit(True)), f"{at}: {what}"))


def lab_error() -> Column:
    """The first fault of a lab result (code, unit, timestamp_ms) by itself, or null."""
    return _base({"code": "code", "unit": "unit"}, "timestamp_ms", "must be a positive epoch millis")


def vital_error() -> Column:
    """The first fault of a vital sign (name, unit, timestamp_ms), or null."""
    return _base({"name": "name", "unit": "unit"}, "timestamp_ms", "must be a positive epoch millis")


def diagnosis_error() -> Column:
    """The first fault of a diagnosis (code, description, created_at_ms) by itself, or null."""
    return _base({"code": "code", "description": "description"}, "created_at_ms", "must be positive epoch millis")


def medication_error() -> Column:
    """The first fault of a medication (name, dose, created_at_ms), or null."""
    return _base({"name": "name", "dose": "dose"}, "created_at_ms", "must be positive epoch millis")


def validate_lab(rows: DataFrame, context: Context) -> DataFrame:
    """rows (code, value, unit, timestamp_ms) with `error`, the first fault or null.

    After the checks of the row itself: the code must be one that has units, the unit a known one (as written or in lower case), the unit
    one of the code's, and the value inside the reference range, where there is one. A NaN or null value is in no conflict with a range.
    """
    lower = ascii_lower("unit")
    found = _flag(rows, context.allowed.select("code"), {"code": F.col("code")}, "_loinc")
    found = _flag(found, context.units, {"unit": F.col("unit")}, "_unit")
    found = _flag(found, context.units, {"unit": lower}, "_lower")
    found = _flag(found, context.allowed, {"code": F.col("code"), "unit": F.col("unit")}, "_allowed")
    found = reference_range(found, context)
    outside = ~F.isnan("value") & ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    error = F.coalesce(
        lab_error(), F.when(~F.col("_loinc"), F.concat(F.lit("unknown LOINC code "), "code")), F.when(~(F.col("_unit") | F.col("_lower")), F.concat(F.lit("invalid unit "), "unit")),
        F.when(~F.col("_allowed"), "unit: unit not preferred for given LOINC"), F.when(outside, F.concat(F.lit("out of reference range "), F.col("code"), F.lit(" "), F.col("unit"))),
    )
    return found.withColumn("error", error).select(*rows.columns, "error")


def validate_diagnosis(rows: DataFrame, context: Context) -> DataFrame:
    """rows (code, description, created_at_ms) with `error`, the first fault or null; the code must be a known SNOMED one."""
    found = _flag(rows, context.snomed, {"code": F.col("code")}, "_known")
    error = F.coalesce(diagnosis_error(), F.when(~F.col("_known"), F.concat(F.lit("unknown SNOMED code "), "code")))
    return found.withColumn("error", error).select(*rows.columns, "error")


def fault_summary(rows: DataFrame, *by: str) -> DataFrame:
    """rows, faults and the share of faults of rows with `error`."""
    bad = F.sum(F.col("error").isNotNull().cast("long"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), bad.alias("faults"), safe_div(bad, F.count(F.lit(1))).alias("share"))
