"""OMOP rows as JSON lines, and trial results as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.exprs import col

#: The columns of the common data model's tables. A column with ! cannot be missing.
TABLES = {
    "Person": "person_id! long, gender_concept_id! int, year_of_birth! int, month_of_birth int, day_of_birth int, birth_datetime string, race_concept_id int, ethnicity_concept_id int, location_id long, provider_id long, care_site_id long, person_source_value string, gender_source_value string, gender_source_concept_id int, race_source_value string, race_source_concept_id int, ethnicity_source_value string, ethnicity_source_concept_id int",
    "Observation": "observation_id! long, person_id! long, observation_concept_id! int, observation_date! string, observation_datetime string, observation_type_concept_id! int, value_as_number double, value_as_string string, value_as_concept_id int, qualifier_concept_id int, unit_concept_id int, provider_id long, visit_occurrence_id long, visit_detail_id long, observation_source_value string, observation_source_concept_id int, unit_source_value string, qualifier_source_value string, value_source_value string, observation_event_id long, obs_event_field_concept_id int",
    "ConditionOccurrence": "condition_occurrence_id! long, person_id! long, condition_concept_id! int, condition_start_date! string, condition_start_datetime string, condition_end_date string, condition_end_datetime string, condition_type_concept_id! int, condition_status_concept_id int, stop_reason string, provider_id long, visit_occurrence_id long, visit_detail_id long, condition_source_value string, condition_source_concept_id int, condition_status_source_value string",
    "ProcedureOccurrence": "procedure_occurrence_id! long, person_id! long, procedure_concept_id! int, procedure_date! string, procedure_datetime string, procedure_type_concept_id! int, modifier_concept_id int, quantity int, provider_id long, visit_occurrence_id long, visit_detail_id long, procedure_source_value string, procedure_source_concept_id int, modifier_source_value string",
    "DrugExposure": "drug_exposure_id! long, person_id! long, drug_concept_id! int, drug_exposure_start_date! string, drug_exposure_start_datetime string, drug_exposure_end_date string, drug_exposure_end_datetime string, verbatim_end_date string, drug_type_concept_id! int, stop_reason string, refills int, quantity double, days_supply int, sig string, route_concept_id int, lot_number string, provider_id long, visit_occurrence_id long, visit_detail_id long, drug_source_value string, drug_source_concept_id int, route_source_value string, dose_unit_source_value string",
    "Measurement": "measurement_id! long, person_id! long, measurement_concept_id! int, measurement_date! string, measurement_datetime string, measurement_time string, measurement_type_concept_id! int, operator_concept_id int, value_as_number double, value_as_concept_id int, unit_concept_id int, range_low double, range_high double, provider_id long, visit_occurrence_id long, visit_detail_id long, measurement_source_value string, measurement_source_concept_id int, unit_source_value string, value_source_value string, measurement_event_id long, meas_event_field_concept_id int",
    "VisitOccurrence": "visit_occurrence_id! long, person_id! long, visit_concept_id! int, visit_start_date! string, visit_start_datetime string, visit_end_date! string, visit_end_datetime string, visit_type_concept_id! int, provider_id long, care_site_id long, visit_source_value string, visit_source_concept_id int, admitting_source_concept_id int, admitting_source_value string, discharge_to_concept_id int, discharge_to_source_value string, preceding_visit_occurrence_id long",
    "Concept": "concept_id! int, concept_name! string, domain_id! string, vocabulary_id! string, concept_class_id! string, standard_concept string, concept_code! string, valid_start_date! string, valid_end_date! string, invalid_reason string",
}


def schema(table: str) -> str:
    return TABLES[table].replace("!", "")


def to_json(frame: DataFrame, table: str) -> Column:
    """A row of a frame as the JSON object of a table, all columns of the table in order; those that the frame lacks are null."""
    have = set(frame.columns)
    fields = [x.split() for x in schema(table).split(", ")]
    return F.to_json(F.struct(*[(F.col(n) if n in have else F.lit(None)).cast(k).alias(n) for n, k in fields]), {"ignoreNullFields": "false"})


def from_json(text, table: str) -> Column:
    """The struct of a table, or null for a text that is no such object or lacks a column that cannot be missing."""
    found = F.from_json(col(text), schema(table))
    complete = F.lit(True)
    for name in (x.split()[0] for x in TABLES[table].split(", ")):
        if name.endswith("!"):
            complete = complete & found[name[:-1]].isNotNull()
    return F.when(complete, found)


def is_concept_id(concept_id) -> Column:
    """Whether an id may be that of a concept: not negative. Null is none."""
    return F.coalesce(col(concept_id) >= 0, F.lit(False))


def trial_results(spark: SparkSession, path: str) -> DataFrame:
    """(group, outcome) of a CSV with a header and these two columns. Lines with another number of parts, or an outcome that is no number, are left out."""
    return trial_lines(spark.read.text(path))


def trial_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same from lines of text; a header is no number and falls out by itself."""
    parts = F.split(value, ",")
    outcome = F.trim(F.get(parts, F.lit(1)))
    number = F.when(outcome.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), outcome.try_cast("double"))
    return lines.filter(F.size(parts) == 2).select(F.trim(F.get(parts, F.lit(0))).alias("group"), number.alias("outcome")).filter("outcome is not null")
