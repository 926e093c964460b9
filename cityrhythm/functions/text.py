"""Text helpers: Unicode-space trim, blank detection, district name normaliser."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityrhythm import dims

# Space separators (general category Zs) at either end: U+0020, U+00A0, U+1680,
# U+2000..U+200A, U+202F, U+205F, U+3000. Tab, CR, LF, U+200B and U+FEFF are
# not separators and are kept, like the trim the reports were defined with.
# \A / \z anchor at the absolute ends: Java's "$" also matches before a final
# line terminator, which would strip a space in front of a trailing newline.
_EDGE_SPACES = r"\A\p{Zs}+|\p{Zs}+\z"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The space separators themselves, derived from the Unicode database (category Zs).
SPACE_SEPARATORS = [chr(cp) for cp in range(0x3001) if unicodedata.category(chr(cp)) == "Zs"]


def _edge_is_space(c: Column, first: bool) -> Column:
    ch = F.substring(c, 1, 1) if first else F.substring(c, -1, 1)
    return ch.isin(SPACE_SEPARATORS)


def trim_spaces(col: Column | str) -> Column:
    """Strip space separators at both ends. The regex only runs for the rare
    values that start or end with one (a plain first/last-character test)."""
    c = _c(col)
    needs = _edge_is_space(c, True) | _edge_is_space(c, False)
    return F.when(needs, F.regexp_replace(c, _EDGE_SPACES, "")).otherwise(c)


def blank_to_null(col: Column | str) -> Column:
    """NULLIF(TRIM(x), '') with the Unicode-space trim."""
    t = trim_spaces(col)
    return F.when(t == F.lit(""), F.lit(None).cast("string")).otherwise(t)


def is_blank(col: Column | str) -> Column:
    """x IS NULL OR TRIM(x) = '' (never NULL itself): empty, or only space
    separators — checked by the first character before any regex runs."""
    c = _c(col)
    only_spaces = _edge_is_space(c, True) & c.rlike(r"\A\p{Zs}+\z")
    return c.isNull() | (F.length(c) == 0) | only_spaces


def normalize_name(col: Column | str) -> Column:
    """'Kadıköy' -> 'KADIKOY': fold Turkish letters, then upper-case.

    Folding first matters: upper/lower on dotted/dotless i is locale-dependent.
    """
    return F.upper(F.translate(_c(col), dims.TR_FROM, dims.TR_TO))
