"""Guarded column expressions: IEEE results under ANSI mode, ASCII case folding, Unicode trimming, date keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b, zero=None) -> Column:
    """a / b as double; `zero` (null by default) where b is 0. Never throws."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when(b == 0, F.lit(zero).cast("double")))


def ascii_lower(c) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def ascii_upper(c) -> Column:
    return F.translate(col(c), LOWER, UPPER)


def uni_trim(c) -> Column:
    """Strip all Unicode white space on both ends. Only a text that has some there is rewritten."""
    c = col(c)
    return F.when(c.rlike(r"(?U)^\s|\s$"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def blank(c) -> Column:
    """True for null and for white space only."""
    return F.coalesce(~col(c).rlike(r"(?U)\S"), F.lit(True))


def finite(c) -> Column:
    """True for numbers that are not null, NaN or infinite."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def ordered(condition: Column, c) -> Column:
    """An ordered comparison of c that is false, not true or null, for NaN and null."""
    return F.coalesce(condition & ~F.isnan(col(c)), F.lit(False))


def norm_date(c) -> Column:
    """`YYYY-MM-DD` without its dashes; any other text as it is."""
    c = col(c)
    dashed = (F.octet_length(c) == 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-")
    return F.when(dashed, F.replace(c, F.lit("-"), F.lit(""))).otherwise(c)


def norm_date_text(value: str) -> str:
    return value.replace("-", "") if len(value) == 10 and value[4] == "-" and value[7] == "-" else value


def clamp(c, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def lookup(key: Column, table: dict) -> Column:
    """A literal map; null for a missing key."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None)
