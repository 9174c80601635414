"""Text primitives with the whitespace and number rules the data was written under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point counted as white space when stripping.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = "[" + WHITE_SPACE + "]"

_OUTER_SPACE = rf"\A{SPACE_CLASS}|{SPACE_CLASS}\z"

_DIGITS = "[0-9]+(?:_[0-9]+)*"
FLOAT_PATTERN = (
    rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))$"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_cell(c: Column) -> Column:
    """``strip`` for short texts in a plain column: most have nothing to trim and are not copied."""
    return F.when(c.rlike(_OUTER_SPACE), strip(c)).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return strip(F.regexp_replace(c, SPACE_CLASS + "+", " "))


def to_float(c: Column) -> Column:
    """A double where the whole text is a number, else NULL (never an error)."""
    return stripped_to_float(strip(c))


def stripped_to_float(t: Column) -> Column:
    """``to_float`` for a text without outer white space."""
    number = F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(t.rlike(FLOAT_PATTERN), F.coalesce(number, F.lit(float("nan"))))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def is_statement(c: Column, allow_with: bool = True) -> Column:
    """Read-only statement test: starts with ``select`` (or ``with``)."""
    return F.lower(strip(c)).rlike("^(?:select|with)" if allow_with else "^select")


def has_order_by(sql: Column) -> Column:
    return F.contains(F.lower(sql), F.lit("order by"))
