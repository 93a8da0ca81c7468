"""Unit conversion within a dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalframe.functions.exprs import col, lookup

#: Unit -> (dimension, scale to the base unit).
UNITS = {
    "g": ("mass", 1.0), "mg": ("mass", 1e-3), "ug": ("mass", 1e-6), "ng": ("mass", 1e-9), "kg": ("mass", 1e3), "lb": ("mass", 453.59237), "oz": ("mass", 28.349523125),
    "m": ("length", 1.0), "mm": ("length", 1e-3), "cm": ("length", 1e-2), "km": ("length", 1e3), "in": ("length", 0.0254), "ft": ("length", 0.3048),
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0),
    "L": ("volume", 1.0), "mL": ("volume", 1e-3), "ml": ("volume", 1e-3), "uL": ("volume", 1e-6), "ul": ("volume", 1e-6), "dL": ("volume", 0.1), "dl": ("volume", 0.1),
    "mol": ("substance", 1.0), "mmol": ("substance", 1e-3), "umol": ("substance", 1e-6),
    "Pa": ("pressure", 1.0), "kPa": ("pressure", 1e3), "mmHg": ("pressure", 133.322),
    "g/L": ("mass per volume", 1.0), "mg/dL": ("mass per volume", 0.01), "mg/mL": ("mass per volume", 1.0), "mg/L": ("mass per volume", 1e-3), "g/dL": ("mass per volume", 10.0),
    "mol/L": ("substance per volume", 1.0), "mmol/L": ("substance per volume", 1e-3), "umol/L": ("substance per volume", 1e-6), "U/L": ("substance per volume", 1.0),
    "g/s": ("mass per time", 1.0), "mg/s": ("mass per time", 1e-3), "g/min": ("mass per time", 1 / 60), "mg/min": ("mass per time", 1e-3 / 60),
    "L/s": ("volume per time", 1.0), "mL/s": ("volume per time", 1e-3), "L/min": ("volume per time", 1 / 60), "mL/min": ("volume per time", 1e-3 / 60),
}


def convert(value, source, target) -> Column:
    """value in `target` units; null for an unknown unit or another dimension."""
    source, target = col(source), col(target)
    dimension, scale = {k: v[0] for k, v in UNITS.items()}, {k: v[1] for k, v in UNITS.items()}
    same = lookup(source, dimension) == lookup(target, dimension)
    return F.when(same, col(value).cast("double") * lookup(source, scale) / lookup(target, scale))
