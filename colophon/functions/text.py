"""String functions over article text and ISBN spellings (Column in, Column out)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import patterns as p

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _non_ascii_digits() -> tuple[str, str]:
    """Every decimal digit beyond ASCII and, aligned with it, its ASCII value."""
    digits = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal()]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


DIGITS_FROM, DIGITS_TO = _non_ascii_digits()
WHITE_SPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
SEPARATORS = "-" + WHITE_SPACE


def strip_urls(text: ColumnLike) -> Column:
    """Replace each http(s) URL by one space; the scheme is case-sensitive."""
    text = as_column(text)
    has_url = text.contains("http://") | text.contains("https://")
    return F.when(has_url, F.regexp_replace(text, F.lit(p.URL), F.lit(" "))).otherwise(text)


def strip_separators(isbn: ColumnLike) -> Column:
    """Drop hyphens and white space, keep the case of ``x`` (report uniques)."""
    return F.translate(as_column(isbn), SEPARATORS, "")


def normalize_isbn(isbn: ColumnLike) -> Column:
    """Drop hyphens and white space and upper-case the check character."""
    return F.upper(strip_separators(isbn))


def fold_digits(text: ColumnLike) -> Column:
    """Map decimal digits of any script to 0-9."""
    return F.translate(as_column(text), DIGITS_FROM, DIGITS_TO)


def bare_isbn(isbn: ColumnLike) -> Column:
    """Only ASCII digits and X where there were digits and x; separators dropped."""
    return F.translate(as_column(isbn), DIGITS_FROM + "x" + SEPARATORS, DIGITS_TO + "X")


def trim_space(text: ColumnLike) -> Column:
    """Strip Unicode white space at both ends (``trim`` knows only the blank)."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))
