"""Transaction-ID and header text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value after trimming.
NULL_TOKENS = ("", "nan", "none", "null")

# The characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_SCIENTIFIC = "^[0-9]+([.][0-9]+)?[eE][+][0-9]{1,3}$"

DISPLAY_SEPARATOR = " | "


def strip(c: Column) -> Column:
    """Trim every kind of leading and trailing whitespace, not just blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_text(t: Column) -> Column:
    """True for null and the null tokens, given text already stripped."""
    # The byte length spares lower-casing ordinary values.
    return t.isNull() | ((F.octet_length(t) <= 4) & F.lower(t).isin(*NULL_TOKENS))


def is_null_token(c: Column) -> Column:
    """True for null, blank, nan, none and null in any case."""
    return is_null_text(strip(c))


def is_scientific_id(c: Column) -> Column:
    """True for digits-only scientific notation such as 5.45E+17."""
    # The plain substring test spares the regex on ordinary IDs.
    return c.contains("+") & c.rlike(_SCIENTIFIC)


def _mantissa(c: Column) -> Column:
    return F.translate(F.substring_index(F.lower(c), "e+", 1), ".", "")


def _whole_length(c: Column) -> Column:
    return F.substring_index(F.lower(c), "e+", -1).try_cast("int") + F.lit(1)


def expand_text(t: Column) -> Column:
    """Write a scientific ID out in full digits, given text already stripped."""
    digits = _mantissa(t)
    width = F.greatest(F.length(digits), _whole_length(t))
    return F.when(is_scientific_id(t), F.rpad(digits, width, F.lit("0"))).otherwise(t)


def expand_id(c: Column) -> Column:
    """Write a scientific ID out in full digits; other IDs are only trimmed."""
    return expand_text(strip(c))


def precision_lost(c: Column) -> Column:
    """True when expansion had to invent zeros, so distinct IDs may have collided."""
    t = strip(c)
    return F.coalesce(
        F.when(is_scientific_id(t), F.length(_mantissa(t)) < _whole_length(t)), F.lit(False)
    )


def normal_text(t: Column) -> Column:
    """The matching key of text already stripped."""
    return F.when(~is_null_text(t), expand_text(t))


def normal_id(c: Column) -> Column:
    """The matching key: expanded ID, or null for a null token."""
    return normal_text(strip(c))


def display_id(original: Column, fixed: Column) -> Column:
    """`original | fixed` when expansion changed the ID, else the fixed ID."""
    return F.when(
        is_scientific_id(original) & (original != fixed),
        F.concat_ws(DISPLAY_SEPARATOR, original, fixed),
    ).otherwise(fixed)


def lower_header(c: Column) -> Column:
    return F.lower(strip(c))


def clean_header(c: Column) -> Column:
    """Header without case, outer whitespace, blanks, underscores and dashes."""
    return F.translate(lower_header(c), " _-", "")
