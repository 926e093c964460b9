"""Column-level helpers. All are built-in Spark expressions (codegen, no UDF)."""

from cityrhythm.functions.calendar import day_type, days_in_month, iso_weekday, is_night
from cityrhythm.functions.numeric import per_mille, ratio, round_half_away, safe_div
from cityrhythm.functions.text import blank_to_null, is_blank, normalize_name, trim_spaces

__all__ = [
    "day_type", "days_in_month", "iso_weekday", "is_night",
    "per_mille", "ratio", "round_half_away", "safe_div",
    "blank_to_null", "is_blank", "normalize_name", "trim_spaces",
]
