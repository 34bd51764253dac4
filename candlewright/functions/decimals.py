"""Exact decimals from text and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewright.schemas import DECIMAL

# A plain or exponent number with no padding: Spark's own cast would trim.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_numeric_text(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMERIC_TEXT), F.lit(False))


def parse_decimal(text: Column) -> Column:
    """Text to ``DECIMAL(30,18)``; NULL when malformed or too large."""
    return F.when(is_numeric_text(text), text.try_cast(DECIMAL))


def out_of_range(text: Column) -> Column:
    """Well-formed number that does not fit the decimal type."""
    return is_numeric_text(text) & parse_decimal(text).isNull()


def plain_text(value: Column) -> Column:
    """Shortest plain notation of a decimal: no exponent, no trailing zeros."""
    return F.call_function("format_number", value, F.lit("0.##################"))


def fixed_text(value: Column, digits: int = 8) -> Column:
    """Fixed-point text with ``digits`` decimals."""
    return value.cast(f"decimal(38,{digits})").cast("string")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double precision; NULL when the denominator is zero.

    Decimal division would truncate to seven digits at this width.
    """
    return F.when(
        denominator != 0, F.try_divide(numerator.cast("double"), denominator.cast("double")))
