"""Rounding of doubles without a decimal number for every value."""

from __future__ import annotations


def half_up_sql(value: str, places: int) -> str:
    """SQL of ``round(value, places)``, the same to the last digit.

    Spark rounds a double by way of its decimal text. Only where the shifted value is close to halfway between two whole
    numbers, or too large to tell, does that matter; elsewhere the nearest whole number is certain.
    """
    shift = f"{10 ** places}D"
    certain = f"abs({value} * {shift}) < 1e9D and abs({value} * {shift} - floor({value} * {shift}) - 0.5D) > 1e-3D"
    return f"case when {certain} then floor({value} * {shift} + 0.5D) / {shift} else round({value}, {places}) end"
