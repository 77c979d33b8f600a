"""Check-digit arithmetic as unrolled Column expressions (no UDF)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.functions.binding import let
from colophon.functions.text import as_column, bare_isbn, ColumnLike


def isbn_number(bare: ColumnLike) -> Column:
    """The digits that are weighted, as one integer: nine of an ISBN-10, all of an ISBN-13."""
    bare = as_column(bare)
    digits = F.when(bare.rlike(p.SHAPE_10), F.left(bare, F.lit(9))).when(bare.rlike(p.SHAPE_13), bare)
    return digits.try_cast("bigint")


def _weighted(number: Column, weights: tuple[int, ...]) -> Column:
    last = len(weights) - 1
    digits = (
        F.call_function("div", number, F.lit(10 ** (last - i))) % 10 for i in range(len(weights))
    )
    return reduce(add, (digit * w for digit, w in zip(digits, weights)))


def _isbn10_holds(bare: Column, number: Column) -> Column:
    check = F.when(bare.endswith("X"), F.lit(10)).otherwise(F.right(bare, F.lit(1)).try_cast("int"))
    return (_weighted(number, p.ISBN10_WEIGHTS[:9]) + check) % 11 == 0


def _isbn13_holds(number: Column) -> Column:
    return _weighted(number, p.ISBN13_WEIGHTS) % 10 == 0


def isbn_holds(bare: ColumnLike, number: ColumnLike) -> Column:
    """The check that goes with the length.

    With ``bare`` and ``number`` as columns the check is plain integer
    arithmetic in generated code.
    """
    bare, number = as_column(bare), as_column(number)
    return (
        F.when(number.isNull(), F.lit(False))
        .when(F.length(bare) == 10, _isbn10_holds(bare, number))
        .otherwise(_isbn13_holds(number))
    )


def _validate(isbn: ColumnLike, length: int | None = None) -> Column:
    def holds(bare: Column) -> Column:
        checked = let(isbn_number(bare), lambda number: isbn_holds(bare, number))
        return checked if length is None else (F.length(bare) == length) & checked

    return let(bare_isbn(isbn), holds)


def validate_isbn10(isbn: ColumnLike) -> Column:
    """True when the ten characters satisfy the modulo-11 check (X counts ten)."""
    return _validate(isbn, 10)


def validate_isbn13(isbn: ColumnLike) -> Column:
    """True when the thirteen digits satisfy the modulo-10 check."""
    return _validate(isbn, 13)


def validate_isbn(isbn: ColumnLike) -> Column:
    """Choose the check by cleaned length; any other length fails."""
    return _validate(isbn)


def is_isbn_shaped(isbn: ColumnLike) -> Column:
    """Nine digits and a digit or X, or thirteen digits, once cleaned."""
    return bare_isbn(isbn).rlike(p.SHAPE)


def isbn_format(isbn: ColumnLike) -> Column:
    """``ISBN-10``, ``ISBN-13`` or ``Invalid (n digits)`` by cleaned length."""
    return let(F.length(bare_isbn(isbn)), format_of_length)


def format_of_length(n: Column) -> Column:
    return (
        F.when(n == 10, F.lit(p.FORMAT_10))
        .when(n == 13, F.lit(p.FORMAT_13))
        .otherwise(F.format_string(p.FORMAT_OTHER, n))
    )
