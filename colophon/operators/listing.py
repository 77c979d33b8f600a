"""Which dumps to fetch: language lists, inventories and index pages as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.functions.labels import processing_seconds, processing_time
from colophon.functions.text import as_column, ColumnLike


def host_codes(text: ColumnLike, host: str = p.ARTICLE_HOST) -> Column:
    """Codes in front of ``host`` in a page: ``ARRAY<STRING>``, each once."""
    pattern = rf"([a-z\-]+){re.escape(host)}"
    return F.array_distinct(F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(1)))


def is_language_code(code: ColumnLike) -> Column:
    """False for codes of the sister projects and technical hosts."""
    return ~as_column(code).rlike("|".join(p.NOT_A_LANGUAGE))


def language_codes(pages: DataFrame, text_col: str = "html", host: str = p.ARTICLE_HOST) -> DataFrame:
    """Sorted distinct language codes linked from the pages."""
    codes = pages.select(F.explode(host_codes(text_col, host)).alias("language"))
    return codes.filter(is_language_code("language")).distinct().orderBy("language")


def missing_languages(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Wanted languages without a dump."""
    return wanted.join(inventory.select("language"), "language", "left_anti")


def plan_listing(missing: DataFrame, n: int = p.PLAN_LISTING) -> DataFrame:
    """The first entries of a fetch plan."""
    return missing.orderBy("language").limit(n)


def dump_dates(index_pages: DataFrame, html: str = "html") -> DataFrame:
    """``(language, date)`` for each date folder linked from an index page."""
    dates = F.regexp_extract_all(as_column(html), F.lit(p.DATE_LINK), F.lit(1))
    return index_pages.select("language", F.explode(dates).alias("date"))


def dump_file_name(language: ColumnLike, date: ColumnLike) -> Column:
    return F.concat(as_column(language), F.lit("wiki-"), as_column(date), F.lit(p.DUMP_SUFFIX))


def page_state(date_pages: DataFrame) -> DataFrame:
    """What a page of one date says: ``listed``, the dump file is there; ``busy``, it is being made."""
    html = F.col("html")
    return date_pages.select(
        "language",
        "date",
        html.contains(dump_file_name("language", "date")).alias("listed"),
        F.lower(html).contains(p.IN_PROGRESS).alias("busy"),
    )


def is_usable(listed: ColumnLike, busy: ColumnLike, is_newest: ColumnLike) -> Column:
    """The dump file is listed, and the dump is finished or is not the newest one."""
    return as_column(listed) & (~as_column(busy) | ~as_column(is_newest))


def latest_dump(
    dates: DataFrame, date_pages: DataFrame, dates_tried: int = p.NEWEST_DATES_TRIED
) -> DataFrame:
    """Per language the newest usable dump among its ``dates_tried`` newest dates.

    The rank is limited before the shuffle as well, so a language with very many
    dates sends only its newest ones.  The join then sees at most that many rows
    per language on one side and two flags per page, not the page, on the other.
    """
    newest_first = Window.partitionBy("language").orderBy(F.desc("date"))
    tried = (
        dates.withColumn("rank", F.row_number().over(newest_first))
        .filter(F.col("rank") <= dates_tried)
        # The same date may be linked twice; it takes two places but is one date.
        .groupBy("language", "date")
        .agg(F.min("rank").alias("rank"))
    )
    # The first of the ranked places holds the newest date.
    newest = tried.withColumn("is_newest", F.col("rank") == 1)
    pages = newest.join(page_state(date_pages), ["language", "date"])
    usable = pages.filter(is_usable("listed", "busy", "is_newest"))
    best = usable.groupBy("language").agg(F.max("date").alias("date"))
    name = dump_file_name("language", "date")
    url = F.concat(
        F.lit(p.DUMP_SITE), "language", F.lit("wiki/"), "date", F.lit("/"), name
    )
    return best.select("language", "date", url.alias("url"))


def inventory_sizing(
    inventory: DataFrame, articles_per_second: float = p.ARTICLES_PER_SECOND
) -> DataFrame:
    """Bytes, estimated articles and estimated time per language."""
    sums = inventory.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    return sums.select(
        "language",
        "files",
        "bytes",
        (F.col("bytes") / p.BYTES_PER_ARTICLE).alias("estimated_articles"),
        processing_seconds("bytes", articles_per_second).alias("estimated_seconds"),
        processing_time("bytes", articles_per_second).alias("estimated_time"),
    )
