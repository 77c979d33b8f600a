"""The place of a row in a total order as one number.

A minimum over a struct or a string cannot be kept in a hash aggregate's buffer, so
Spark would sort all rows before it folds them.  A decimal of up to 38 digits can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal digits of a type's values once they are shifted to begin at 1, and the shift.
WIDTHS = {"tinyint": (3, 1 << 7), "smallint": (5, 1 << 15), "int": (10, 1 << 31), "bigint": (20, 1 << 63)}
DIGITS = 38


def fits(df: DataFrame, order: tuple[str, ...]) -> bool:
    """Whether all columns are whole numbers that fit into one decimal together."""
    types = dict(df.dtypes)
    return all(types[c] in WIDTHS for c in order) and sum(WIDTHS[types[c]][0] for c in order) <= DIGITS


def packed(df: DataFrame, order: tuple[str, ...]) -> Column:
    """One number that orders as the columns do, null first."""
    types, out = dict(df.dtypes), F.lit(0).cast("decimal(38,0)")
    for c in order:
        digits, shift = WIDTHS[types[c]]
        value = F.col(c).cast("decimal(20,0)") + F.lit(str(shift + 1)).cast("decimal(20,0)")
        out = (out * F.lit("1" + "0" * digits).cast("decimal(21,0)") + F.coalesce(value, F.lit(0))).cast("decimal(38,0)")
    return out


def unpacked(df: DataFrame, order: tuple[str, ...], number: str) -> list[Column]:
    """The columns again, read off the digits of the number."""
    types, out, end = dict(df.dtypes), [], DIGITS
    text = F.lpad(F.col(number).cast("string"), DIGITS, "0")
    for c in reversed(order):
        digits, shift = WIDTHS[types[c]]
        value = F.substring(text, end - digits + 1, digits).cast("decimal(20,0)")
        out.append(F.when(value > 0, value - F.lit(str(shift + 1)).cast("decimal(20,0)")).cast(types[c]).alias(c))
        end -= digits
    return out[::-1]
