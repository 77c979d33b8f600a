"""Names, links, rates and readable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.functions.text import as_column, ColumnLike


def dump_language(name: ColumnLike) -> Column:
    """Language of a dump file name; names of another form count as English."""
    code = F.regexp_extract(as_column(name), p.DUMP_LANGUAGE, 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit(p.DEFAULT_LANGUAGE))


def inventory_language(name: ColumnLike) -> Column:
    """Language of an inventoried file, hyphens allowed; NULL when there is none."""
    code = F.regexp_extract(as_column(name), p.INVENTORY_LANGUAGE, 1)
    return F.nullif(code, F.lit(""))


def inventory_date(name: ColumnLike) -> Column:
    date = F.regexp_extract(as_column(name), p.INVENTORY_DATE, 1)
    return F.nullif(date, F.lit(""))


def article_url(language: ColumnLike, title: ColumnLike) -> Column:
    """Link to an article; blanks become underscores, nothing else is encoded."""
    slug = F.replace(as_column(title), F.lit(" "), F.lit("_"))
    return F.concat(
        F.lit("https://"), as_column(language), F.lit(p.ARTICLE_HOST + p.ARTICLE_PATH), slug
    )


def pass_rate(valid: ColumnLike, total: ColumnLike) -> Column:
    """Share of valid ISBNs in per cent, zero when there are none."""
    rate = F.try_divide(as_column(valid), as_column(total)) * 100
    return F.coalesce(rate, F.lit(0.0))


def speed(count: ColumnLike, seconds: ColumnLike) -> Column:
    """Items per second; NULL when no time has passed."""
    return F.try_divide(as_column(count), as_column(seconds))


def language_label(language: ColumnLike) -> Column:
    return F.upper(as_column(language))


def thousands(number: ColumnLike) -> Column:
    return F.format_number(as_column(number), 0)


def fixed(number: ColumnLike, decimals: int) -> Column:
    """Fixed decimals, no grouping, rounded on the exact binary value."""
    return F.replace(F.format_number(as_column(number), decimals), F.lit(","), F.lit(""))


def processing_seconds(
    size_bytes: ColumnLike, articles_per_second: float = p.ARTICLES_PER_SECOND
) -> Column:
    return as_column(size_bytes) / F.lit(p.BYTES_PER_ARTICLE) / F.lit(articles_per_second)


def processing_time(
    size_bytes: ColumnLike, articles_per_second: float = p.ARTICLES_PER_SECOND
) -> Column:
    """Readable time estimate for a dump of this size: ``1h 2m 3s``, ``2m 3s``, ``3s``."""
    total = F.floor(processing_seconds(size_bytes, articles_per_second)).cast("long")
    hours = F.floor(total / 3600).cast("long")
    minutes = F.floor((total % 3600) / 60).cast("long")
    seconds = total % 60
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, seconds))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds))
        .otherwise(F.format_string("%ds", seconds))
    )
