"""Rounding, parsing and saturation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round by scaling, adding one half and flooring (plain IEEE arithmetic, no decimals)."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def first_int(value: Column) -> Column:
    """First run of digits of a tag value, NULL when there is none."""
    return F.regexp_extract(value, r"(\d+)", 1).try_cast("int")


def saturate(total: Column) -> Column:
    """Map an accumulated intensity onto 0..5."""
    return 5.0 * (1.0 - F.exp(-0.2773 * total))


def bucket(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")
