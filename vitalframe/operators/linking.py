"""Joins between clinical tables and OMOP helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.exprs import col, norm_date, uni_trim


def first_by(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first by order. A min over structs, so it combines before the shuffle and no window holds a hot key."""
    rest = [c for c in frame.columns if c != key and c not in order]
    return frame.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_x")).select(key, "_x.*")


def link_first(left: DataFrame, right: DataFrame, key: str, order: list[str], keep: dict[str, str]) -> DataFrame:
    """Left outer join with at most one match: the first row of right, by order, with the same key. keep: right column -> new name."""
    first = first_by(right.select(key, *dict.fromkeys([*order, *keep])), key, order)
    return left.join(first.select(key, *[F.col(c).alias(n) for c, n in keep.items()]), key, "left")


def latest(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What upserts in this order leave: the last row of each key."""
    rest = [c for c in frame.columns if c != key and c not in order]
    return frame.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(key, "_x.*")


def of_person(frame: DataFrame, people: DataFrame, key: str = "person_id") -> DataFrame:
    """Facts of the given people."""
    return frame.join(people.select(key).distinct(), key, "left_semi")


def concept_valid(start, end, on) -> Column:
    """start <= on <= end as dates; false where one of them cannot be read."""
    date = lambda c: F.to_date(F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd")))
    return F.coalesce((date(start) <= date(on)) & (date(on) <= date(end)), F.lit(False))


def to_omop_person(patients: DataFrame) -> DataFrame:
    """(person_id, year_of_birth, gender_concept_id): patients whose id is a number and whose birth_date begins with a year."""
    number = F.when(F.col("id").rlike(r"^[+-]?\d{1,18}$"), F.col("id").cast("long"))
    digits = norm_date(uni_trim("birth_date"))
    year = F.when(digits.rlike(r"^\d{4}"), F.substring(digits, 1, 4).cast("int"))
    found = patients.select(number.alias("person_id"), year.alias("year_of_birth"), F.lit(0).alias("gender_concept_id"))
    return found.filter("person_id is not null and year_of_birth is not null")


def age(year_of_birth, current_year: int) -> Column:
    return F.lit(current_year) - col(year_of_birth)


def diagnostic_reports(observations: DataFrame, subject: str = "subject") -> DataFrame:
    """A report for each subject with its distinct codes, sorted."""
    codes = observations.select(subject, "code").distinct()
    return codes.groupBy(subject).agg(F.array_sort(F.collect_list("code")).alias("result_codes"))
