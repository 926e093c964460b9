"""Arithmetic helpers with the result semantics the reports need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den in double, NULL when den is 0 or NULL (never an error or inf)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """scale * num / den, evaluated left to right in double; NULL on a zero denominator."""
    return F.try_divide(F.lit(float(scale)) * _c(num).cast("double"), _c(den).cast("double"))


def per_mille(part: Column | str, total: Column | str) -> Column:
    return ratio(part, total, 1000.0)


def round_half_away(col: Column | str, digits: int = 0) -> Column:
    """Round a double to ``digits`` decimals, ties away from zero on the binary value.

    Spark's ``round`` decides ties on the shortest decimal text of the double
    (1.005 -> 1.01), while the reports were defined with scaling then rounding
    (1.005 * 100 = 100.4999.. -> 1.0). Scaling first gives the latter.
    """
    c = _c(col).cast("double")
    if digits == 0:
        return F.round(c)
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m)
