"""Validators: each adds `error`, the message of the first rule that a row breaks, or null."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.exprs import ascii_lower, blank, finite, uni_trim

Rule = tuple[Column, str]


def first_error(rules: list[Rule]) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in rules], F.lit(None).cast("string"))


def bad_date(c: str) -> Column:
    """A present date that is neither YYYY-MM-DD nor YYYYMMDD, or has month or day out of 1-12 and 1-31."""
    shape = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$|^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"
    return F.col(c).isNotNull() & ~F.col(c).rlike(shape)


def _filled(*names: str) -> list[Rule]:
    return [(blank(n), f"{n} is empty") for n in names]


def patient_error() -> Column:
    return first_error([*_filled("id"), (blank("given_name") & blank("family_name"), "name is empty"), (bad_date("birth_date"), "birth_date is not a date")])


def observation_error() -> Column:
    unit = ascii_lower(uni_trim("unit"))
    wants = lambda code, units: (F.col("code") == code) & ~F.coalesce(unit.isin(*units), F.lit(False))
    return first_error([
        *_filled("id", "code"),
        (~uni_trim("code").rlike("^[A-Z0-9]*$"), "code has other characters than A-Z and 0-9"),
        (F.col("value").isNotNull() & ~finite("value"), "value is not finite"),
        (F.col("unit").isNotNull() & blank("unit"), "unit is empty"),
        (wants("HR", ["bpm"]), "HR needs bpm"), (wants("BP", ["mmhg"]), "BP needs mmhg"), (wants("TEMP", ["c", "f"]), "TEMP needs c or f"),
    ])


#: Errors of the resources that have plain rules only.
ERRORS = {
    "Patient": patient_error,
    "Observation": observation_error,
    "MedicalEvent": lambda: first_error([*_filled("id", "code"), (bad_date("start_date"), "start_date is not a date")]),
    "Medication": lambda: first_error([*_filled("id", "code"), (F.exists("ingredients", lambda x: blank(x)), "an ingredient is empty")]),
    "Procedure": lambda: first_error([*_filled("id", "code", "subject"), (bad_date("performed_date"), "performed_date is not a date")]),
    "Condition": lambda: first_error(_filled("id", "code", "clinical_status", "verification_status", "subject")),
    "Encounter": lambda: first_error([*_filled("id"), (bad_date("start_date"), "start_date is not a date"), (bad_date("end_date"), "end_date is not a date"), *_filled("subject")]),
    "DiagnosticReport": lambda: first_error(_filled("id", "code", "subject")),
}


def validate(frame: DataFrame, resource: str) -> DataFrame:
    return frame.withColumn("error", ERRORS[resource]())


def validate_any(frame: DataFrame) -> DataFrame:
    """Each row of a frame of all resources by the rules of its own resource_type."""
    error = F.coalesce(*[F.when(F.col("resource_type") == r, e()) for r, e in ERRORS.items()])
    return frame.withColumn("error", error)


def validate_profile(frame: DataFrame, required: list[str], cardinality: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Required columns present and not blank; arrays within [least, most] elements, null counting as none."""
    rules = []
    for name in required:
        kind = dict(frame.dtypes)[name]
        rules.append((F.col(name).isNull(), f"{name} is missing"))
        if kind == "string":
            rules.append((blank(name), f"{name} is empty"))
    for name, (least, most) in cardinality.items():
        size = F.coalesce(F.size(name), F.lit(0))
        size = F.when(size < 0, 0).otherwise(size)
        rules.append(((size < least) | (size > most if most is not None else F.lit(False)), f"{name} has a wrong number of elements"))
    return frame.withColumn("error", first_error(rules))


@dataclass(frozen=True)
class Profile:
    """What a resource of one type must have; cardinality: least and most elements (None: any number) of an array."""

    name: str
    resource_type: str
    required_fields: list[str] = field(default_factory=list)
    cardinality: dict[str, tuple[int, int | None]] = field(default_factory=dict)


#: The profiles that come with the library.
PROFILES = [
    Profile("BasicPatient", "Patient", ["id", "given_name"]),
    Profile("BasicObservation", "Observation", ["id", "code"]),
    Profile("BasicDiagnosticReport", "DiagnosticReport", ["id", "code"], {"result_codes": (1, 3)}),
]


def load_profiles(text: str) -> list[Profile]:
    """Profiles from a JSON array of objects with the names of Profile's fields."""
    return [Profile(**x) for x in json.loads(text)]


def read_profiles(spark: SparkSession, path: str) -> list[Profile]:
    """Profiles from a JSON file, read by Spark so that any file system works."""
    return load_profiles(spark.read.text(path, wholetext=True).first().value)


def profile_error(text, profile: Profile) -> Column:
    """The first rule of a profile that a JSON object's text breaks, or null. A resourceType counts only where the object has one."""
    whole = F.try_parse_json(text)
    at = lambda name: F.try_variant_get(whole, f"$['{name}']", "variant")
    kind = F.try_variant_get(whole, "$.resourceType", "string")
    rules: list[Rule] = [
        (F.coalesce(~F.schema_of_variant(whole).startswith("OBJECT"), F.lit(True)), "not a JSON object"),
        (ascii_lower(kind) != profile.resource_type.lower(), f"resource is no {profile.resource_type}"),
    ]
    for name in profile.required_fields:
        value, of = at(name), F.coalesce(F.schema_of_variant(at(name)), F.lit("VOID"))
        rules += [(of == "VOID", f"{name} is missing"), ((of == "STRING") & blank(value.cast("string")), f"{name} is empty")]
    for name, (least, most) in profile.cardinality.items():
        of = F.coalesce(F.schema_of_variant(at(name)), F.lit("VOID"))
        size = F.when(of == "VOID", 0).otherwise(F.size(F.try_variant_get(whole, f"$['{name}']", "array<variant>")))
        rules.append(((of != "VOID") & ~of.startswith("ARRAY"), f"{name} is not an array"))
        rules.append(((size < least) | (size > most if most is not None else F.lit(False)), f"{name} has a wrong number of elements"))
    return first_error(rules)


def validate_against(frame: DataFrame, resource: str, profile: Profile) -> DataFrame:
    """Rows of a resource by a profile: its type must be the profile's, and its columns are checked as JSON."""
    if resource.lower() != profile.resource_type.lower():
        return frame.withColumn("error", F.lit(f"resource is no {profile.resource_type}"))
    return frame.withColumn("error", profile_error(F.to_json(F.struct(*frame.columns)), profile))


def duplicate_ids(entries: DataFrame, bundle: str, order: str, ident: str = "id") -> DataFrame:
    """(bundle, id, order): the first entry of each bundle, by order, whose id stood before. Aggregates by id first, so a hot bundle stays spread."""
    seen = entries.groupBy(bundle, ident).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    repeated = seen.filter("n > 1").select(bundle, ident, "first")
    later = entries.join(repeated, [bundle, ident]).filter(F.col(order) > F.col("first"))
    return later.groupBy(bundle).agg(F.min(F.struct(order, ident)).alias("x")).select(bundle, f"x.{ident}", f"x.{order}")


def bundle_errors(entries: DataFrame, bundle: str, kind: str, order: str) -> DataFrame:
    """One row a bundle: its kind and error. Transaction: ids filled and unique; Batch: not empty; Collection: always fine."""
    sizes = entries.groupBy(bundle).agg(F.first(kind).alias(kind), F.count("id").alias("n"), F.max(blank("id").cast("int")).alias("hollow"))
    doubled = duplicate_ids(entries, bundle, order).select(bundle, F.col("id").alias("doubled"))
    error = F.when(F.col(kind) == "Collection", F.lit(None).cast("string")).when(F.col("n") == 0, "bundle is empty")
    error = error.when((F.col(kind) == "Transaction") & (F.col("hollow") == 1), "an id is empty")
    error = error.when((F.col(kind) == "Transaction") & F.col("doubled").isNotNull(), F.concat(F.lit("duplicate id "), "doubled"))
    return sizes.join(doubled, bundle, "left").select(bundle, kind, error.alias("error"))


def transaction_outcome(entries: DataFrame, bundle: str, order: str, failed: str) -> DataFrame:
    """What processing in order would do: per bundle, entries applied before the first failure and whether all were. bundles.process() does all kinds of bundles."""
    first = entries.filter(F.col(failed)).groupBy(bundle).agg(F.min(order).alias("_bad"))
    marked = entries.join(first, bundle, "left")
    applied = F.sum((F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).cast("long"))
    return marked.groupBy(bundle).agg(applied.alias("applied"), F.max("_bad").isNull().alias("committed"))


def icd10_error(c: str) -> Column:
    return first_error([(blank(c), "code is empty"), (~F.octet_length(c).between(3, 7), "code must have 3 to 7 bytes"), (~F.col(c).rlike("^[A-Z]"), "code must begin with A-Z")])


def icd11_error(c: str) -> Column:
    return first_error([(blank(c), "code is empty"), (~F.octet_length(c).between(3, 8), "code must have 3 to 8 bytes"), (~F.col(c).rlike("^[A-Z]"), "code must begin with A-Z")])


def loinc_error(c: str) -> Column:
    return first_error([(~F.coalesce(F.col(c).rlike(r"^\d{4,5}-\d$"), F.lit(False)), "not a LOINC code")])


def snomed_error(c: str) -> Column:
    return first_error([(~F.coalesce(F.col(c).rlike(r"^\d{5,18}$"), F.lit(False)), "not a SNOMED code")])


def text_error(c: str, most: int) -> Column:
    return first_error([(blank(c), "text is empty"), (F.octet_length(c) > most, f"text is over {most} bytes")])


def resource_error() -> Column:
    """The light check that any resource must pass, whatever its type: an id that is not blank."""
    return F.when(blank("id"), "resource id must not be empty")
