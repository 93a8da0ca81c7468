"""Clinical frames over the star-schema tables, and the same frames as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.exprs import lookup

#: Units as devices write them, by event type.
RAW_UNITS = {"view": " BPM ", "click": "Beats/Min", "purchase": "mmHg", "error": "C"}
WITH = """
with patients as (
  select c_custkey::varchar as id, c_mktsegment as given_name, c_name as family_name,
    case when c_custkey % 2 = 0 then strftime(d, '%Y-%m-%d') else strftime(d, '%Y%m%d') end as birth_date
  from (select *, date '1930-01-01' + (c_custkey * 37 % 30000)::integer as d from customer)),
observations as (
  select event_id::varchar as id, event_type as code, value,
    case event_type when 'view' then ' BPM ' when 'click' then 'Beats/Min' when 'purchase' then 'mmHg' when 'error' then 'C' end as unit,
    user_id as subject, ts from events),
survival as (
  select l_quantity as t, l_returnflag <> 'N' as e, l_linestatus as g, case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as cause from lineitem),
scores as (
  select d.doc_id, least(d.n_chars / 5000::double, 1) as score, l.quality = 1 as label, l.toxic as grp
  from documents d join labels l on d.doc_id = l.doc_id)
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def patients(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") * 37 % 30000).cast("int"))
    born = F.when(F.col("c_custkey") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyyMMdd"))
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("given_name"), F.col("c_name").alias("family_name"), born.alias("birth_date"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("code"), "value", lookup(F.col("event_type"), RAW_UNITS).alias("unit"), F.col("user_id").alias("subject"), "ts"
    )


def survival(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("t"), (flag != "N").alias("e"), F.col("l_linestatus").alias("g"), F.when(flag == "A", 1).when(flag == "R", 2).otherwise(0).alias("cause")
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("score"))
    return docs.join(table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("label"), F.col("toxic").alias("grp")), "doc_id")


def updates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("client"), F.col("embedding").cast("array<double>").alias("weights"), (F.col("label") + 1).alias("examples"), F.col("label").alias("round"))
