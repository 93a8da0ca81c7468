"""Row-wise clean-up of clinical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.exprs import ascii_lower, ascii_upper, lookup, norm_date, uni_trim

#: Spellings of a unit, lower-cased -> unit.
UNIT_ALIASES = {
    "bpm": "bpm", "beat/min": "bpm", "beats/min": "bpm", "beats per minute": "bpm", "beats-per-minute": "bpm",
    "mmhg": "mmhg", "mm hg": "mmhg",
    "c": "c", "celsius": "c", "°c": "c", "degc": "c", "deg c": "c",
}


def patients(frame: DataFrame) -> DataFrame:
    """Trim both names (nulls stay) and bring birth_date to YYYYMMDD."""
    return frame.withColumns({"given_name": uni_trim("given_name"), "family_name": uni_trim("family_name"), "birth_date": norm_date("birth_date")})


def code(c):
    return ascii_upper(uni_trim(c))


def unit(c):
    return ascii_lower(uni_trim(c))


def unit_alias(c):
    """The canonical unit of a known spelling, else the trimmed lower-case text."""
    return F.coalesce(lookup(unit(c), UNIT_ALIASES), unit(c))


def observations(frame: DataFrame, aliases: bool = True) -> DataFrame:
    """Canonical code and unit in one projection."""
    return frame.withColumns({"code": code("code"), "unit": unit_alias("unit") if aliases else unit("unit")})
