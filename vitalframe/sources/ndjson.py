"""Typed clinical resources as JSON lines, single objects and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.exprs import col

SCHEMAS = {
    "Patient": "id string, given_name string, family_name string, birth_date string",
    "Observation": "id string, code string, value double, unit string",
    "MedicalEvent": "id string, code string, start_date string, description string",
    "Medication": "id string, code string, form string, ingredients array<string>",
    "Procedure": "id string, code string, performed_date string, subject string",
    "Condition": "id string, code string, clinical_status string, verification_status string, subject string",
    "Encounter": "id string, class string, start_date string, end_date string, subject string",
    "DiagnosticReport": "id string, code string, result_codes array<string>, subject string",
}
#: Fields that a resource cannot do without.
REQUIRED = {
    "Patient": ["id"], "Observation": ["id", "code"], "MedicalEvent": ["id", "code"], "Medication": ["id", "code", "ingredients"],
    "Procedure": ["id", "code", "subject"], "Condition": ["id", "code", "clinical_status", "verification_status", "subject"],
    "Encounter": ["id", "subject"], "DiagnosticReport": ["id", "code", "result_codes", "subject"],
}


def read_ndjson(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """One resource a line; blank lines are skipped and a line that is not JSON fails the job."""
    return spark.read.schema(SCHEMAS[resource]).json(path, mode="FAILFAST")


def write_ndjson(frame: DataFrame, path: str) -> None:
    """One object a line, nulls written out."""
    frame.write.json(path, ignoreNullFields=False)


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_json(text, resource: str) -> Column:
    """A struct, or null for a text that is no such object or lacks a required field."""
    found = F.from_json(col(text), SCHEMAS[resource])
    complete = F.lit(True)
    for name in REQUIRED[resource]:
        complete = complete & found[name].isNotNull()
    return F.when(complete, found)


def bundle_schema() -> str:
    entry = ", ".join(f"{r}: struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in s.split(', '))}>" for r, s in SCHEMAS.items())
    return f"bundle_type string, entries array<struct<{entry}>>"


def bundle_entries(frame: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, bundle_type, entry, resource_type, <resource structs>): one row an entry of JSON bundles whose entries are tagged by type."""
    parsed = frame.select(*keep, F.from_json(text, bundle_schema()).alias("_b"))
    flat = parsed.select(*keep, F.col("_b.bundle_type").alias("bundle_type"), F.posexplode("_b.entries").alias("entry", "_e"))
    kind = F.coalesce(*[F.when(F.col(f"_e.{r}").isNotNull(), F.lit(r)) for r in SCHEMAS])
    return flat.select(*keep, "bundle_type", "entry", kind.alias("resource_type"), "_e.*")


def extract(entries: DataFrame, resource: str, *keep: str) -> DataFrame:
    """The entries of one type as its own columns."""
    return entries.filter(F.col("resource_type") == resource).select(*keep, f"{resource}.*")


def save_store(frame: DataFrame, path: str, key: str) -> None:
    """A store of JSON objects by key, one folder a key, as Spark partitions it."""
    frame.write.mode("append").partitionBy(key).json(path)


def load_store(spark: SparkSession, path: str, schema: str, key: str, value=None) -> DataFrame:
    """All objects, or those of one key, for which only its folder is read."""
    found = spark.read.schema(schema).json(path)
    return found if value is None else found.filter(F.col(key) == value)


def store_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key): the keys that a store has, from the names of its folders."""
    return spark.read.schema(f"{key} string").option("basePath", path).json(path).select(key).distinct()


def remove_from_store(spark: SparkSession, path: str, key: str, value: str) -> bool:
    """Delete the folder of one key; tells whether there was one."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={escaped}")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def encrypted(secret: bytes, *columns: str) -> Column:
    """The columns as one AES-GCM value, its nonce in front."""
    return F.aes_encrypt(to_json(*columns), F.lit(secret), F.lit("GCM"))


def decrypted(value, secret: bytes, schema: str) -> Column:
    """The struct back, or null where the key is wrong."""
    return F.from_json(F.try_aes_decrypt(col(value), F.lit(secret), F.lit("GCM")).cast("string"), schema)


def synthetic_labs(spark: SparkSession, n: int) -> DataFrame:
    """Lab results made by rule: HGB and GLU in turn, values (i % 100) / 10."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("obs-"), i.cast("string")).alias("id"), F.when(i % 2 == 0, "HGB").otherwise("GLU").alias("code"), ((i % 100) / 10).alias("value"), F.lit("arb").alias("unit")
    )


def synthetic_patients(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("p"), i).alias("id"), F.concat(F.lit("Jane"), i).alias("given_name"), F.lit("Doe").alias("family_name"), F.lit("1980-01-01").alias("birth_date")
    )
