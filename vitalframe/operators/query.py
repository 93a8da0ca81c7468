"""A query builder: OR of AND-groups of predicates on a resource, compiled to one Catalyst condition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.exprs import all_of, any_of, ascii_lower, norm_date, norm_date_text, ordered

#: Keys that each resource answers to: name -> kind (text, number, date).
_TEXT = {"id": "text", "code": "text"}
KEYS = {
    "Patient": {"id": "text", "given_name": "text", "family_name": "text", "birth_date": "date"},
    "Observation": {**_TEXT, "unit": "text", "value": "number"},
    "MedicalEvent": {**_TEXT, "description": "text", "start_date": "date"},
    "Medication": {**_TEXT, "form": "text"},
    "Procedure": {**_TEXT, "subject": "text", "performed_date": "date"},
    "Condition": {**_TEXT, "clinical_status": "text", "verification_status": "text", "subject": "text"},
    "Encounter": {"id": "text", "class": "text", "start_date": "date", "end_date": "date", "subject": "text"},
    "DiagnosticReport": {**_TEXT, "subject": "text"},
}
EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Predicate:
    """One test. op: eq, contains, contains_ci, eq_ci, gt, ge, lt, le, between, date_ge, date_le, any."""

    op: str
    key: str = ""
    value: object = None
    high: float | None = None
    inner: tuple[Predicate, ...] = ()

    def kind(self) -> str:
        return "number" if self.op in ("gt", "ge", "lt", "le", "between") else "date" if self.op.startswith("date") else "text"

    def compile(self, keys: dict[str, str], inside: bool = False) -> Column:
        """The condition on a resource with these keys. A key it does not have counts as true in a group and as false inside any()."""
        if self.op == "any":
            return any_of([p.compile(keys, True) for p in self.inner])
        missing = F.lit(not inside)
        if self.key not in keys:
            return missing
        c, have = F.col(self.key), keys[self.key]
        if self.kind() == "number":
            if have != "number":
                return missing
            tests = {"gt": c > self.value, "ge": c >= self.value, "lt": c < self.value, "le": c <= self.value}
            return ordered(c.between(self.value, self.high) if self.op == "between" else tests[self.op], c)
        if self.kind() == "date":
            if have != "date":
                return missing
            bound = norm_date_text(str(self.value))
            return F.coalesce(norm_date(c) >= bound if self.op == "date_ge" else norm_date(c) <= bound, F.lit(False))
        if have == "number":
            if self.op != "eq":
                return missing
            try:
                return ordered(F.abs(c - float(self.value)) < EPSILON, c)
            except ValueError:
                return missing
        value = str(self.value)
        fold = ascii_lower(c)
        low = value.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        tests = {"eq": c == value, "contains": c.contains(value), "eq_ci": fold == low, "contains_ci": fold.contains(low)}
        return F.coalesce(tests[self.op], F.lit(False))


@dataclass(frozen=True)
class Query:
    """Predicates in groups: a row passes if all of some group hold. Methods add to the last group and return a new query."""

    resource: str
    groups: tuple[tuple[Predicate, ...], ...] = field(default=((),))

    def where(self, op: str, key: str, value, high=None) -> Query:
        return self._add(Predicate(op, key, value, high))

    def _add(self, p: Predicate) -> Query:
        return Query(self.resource, (*self.groups[:-1], (*self.groups[-1], p)))

    def eq(self, key, value) -> Query:
        return self.where("eq", key, value)

    def eq_ci(self, key, value) -> Query:
        return self.where("eq_ci", key, value)

    def contains(self, key, value) -> Query:
        return self.where("contains", key, value)

    def contains_ci(self, key, value) -> Query:
        return self.where("contains_ci", key, value)

    def gt(self, key, value) -> Query:
        return self.where("gt", key, value)

    def ge(self, key, value) -> Query:
        return self.where("ge", key, value)

    def lt(self, key, value) -> Query:
        return self.where("lt", key, value)

    def le(self, key, value) -> Query:
        return self.where("le", key, value)

    def between(self, key, low, high) -> Query:
        return self.where("between", key, low, high)

    def date_ge(self, key, value) -> Query:
        return self.where("date_ge", key, value)

    def date_le(self, key, value) -> Query:
        return self.where("date_le", key, value)

    def family_name_contains(self, value) -> Query:
        return self.contains_ci("family_name", value)

    def given_name_is(self, value) -> Query:
        return self.eq_ci("given_name", value)

    def event_code_contains(self, value) -> Query:
        return self.contains_ci("code", value)

    def any(self, *inner: Predicate) -> Query:
        """One of several predicates, inside the current group."""
        return self._add(Predicate("any", inner=tuple(inner)))

    def or_group(self) -> Query:
        """Start another group. A group without predicates matches everything."""
        return Query(self.resource, (*self.groups, ()))

    def condition(self, resource: str | None = None, strict: bool = False) -> Column:
        keys = KEYS[resource or self.resource]
        if strict:
            unknown = {p.key for g in self.groups for p in g if p.op != "any"} - set(keys)
            if unknown:
                raise ValueError(f"unknown keys: {sorted(unknown)}")
        return any_of([all_of([p.compile(keys) for p in g]) for g in self.groups])

    def run(self, frame: DataFrame, strict: bool = False) -> DataFrame:
        """The rows of one resource's frame that pass. For "Any", frame has all resources under resource_type and each row is judged by its own keys."""
        if self.resource != "Any":
            return frame.filter(self.condition(strict=strict))
        judged = any_of([(F.col("resource_type") == r) & self.condition(r) for r in KEYS])
        return frame.filter(judged)


def of_type(frame: DataFrame, resource: str, *columns: str) -> DataFrame:
    """The entries of one resource type, with that type's columns only."""
    found = frame.filter(F.col("resource_type") == resource)
    return found.select(*columns) if columns else found


def series_by_code(observations: DataFrame, code: str) -> DataFrame:
    """Finite values of the observations with a code."""
    from vitalframe.functions.exprs import finite

    return observations.filter((F.col("code") == code) & finite("value"))
