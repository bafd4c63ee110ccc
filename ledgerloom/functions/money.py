"""Amount parsing and number formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import strip

# Formatting characters dropped from an amount, and the plain-number grammar.
FORMAT_CHARS = ",$€£"
_MAYBE_NUMBER = r"(?U)^[-+0-9.eE,$€£\s]+$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Money:
    """Decimal type used for amounts."""

    precision: int = 20
    scale: int = 4

    @property
    def sql_type(self) -> str:
        return f"decimal({self.precision},{self.scale})"


DEFAULT_MONEY = Money()


def _without_format(c: Column, chars: str = FORMAT_CHARS) -> Column:
    return strip(F.translate(strip(c), chars, ""))


def parse_number(c: Column, chars: str = FORMAT_CHARS) -> Column:
    """Double value of a number in text, or null; nan, inf and `1d` are not numbers."""
    t = _without_format(c, chars)
    cleaned = F.when(t.rlike(NUMBER), t.try_cast("double"))
    # Plain numbers and plain text are settled by one match each; the rest is cleaned first.
    return F.when(c.rlike(NUMBER), c.try_cast("double")).when(c.rlike(_MAYBE_NUMBER), cleaned)


def is_number(c: Column, chars: str = FORMAT_CHARS) -> Column:
    return F.coalesce(_without_format(c, chars).rlike(NUMBER), F.lit(False))


def parse_amount(c: Column, money: Money = DEFAULT_MONEY) -> Column:
    """Amount with separators and currency signs dropped; unparseable text is null.

    A decimal cast accepts exactly the plain-number grammar, so plain numbers, also in
    scientific notation, need nothing else; only what the cast refuses is cleaned.
    """
    cleaned = F.when(~F.lower(c).contains("e"), _without_format(c))
    return F.coalesce(c.try_cast(money.sql_type), cleaned.try_cast(money.sql_type))


def amount_or_zero(c: Column, money: Money = DEFAULT_MONEY) -> Column:
    return F.coalesce(parse_amount(c, money), F.lit(0).cast(money.sql_type))


def strict_amount(c: Column, money: Money = DEFAULT_MONEY) -> Column:
    """Amount only if the text is already a plain number."""
    return strip(c).try_cast(money.sql_type)


def legacy_amount(c: Column, money: Money = DEFAULT_MONEY) -> Column:
    """Amount of text made of digits, dots and dashes only; anything else is 0."""
    zero = F.lit(0).cast(money.sql_type)
    plain = F.translate(c, ".-", "").rlike("^[0-9]+$")
    return F.when(plain, F.coalesce(c.try_cast(money.sql_type), zero)).otherwise(zero)


def number_text(c: Column) -> Column:
    """1,234.50"""
    return F.format_number(c, 2)


def percent_text(c: Column, signed: bool = True) -> Column:
    """+12.3% (signed) or 12.3%"""
    return F.format_string("%+.1f%%" if signed else "%.1f%%", c.cast("double"))


def timestamp_text(c: Column) -> Column:
    """2024-01-01 10:00:00"""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
