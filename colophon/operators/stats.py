"""Counts and rates.

All totals come from one *rollup*: a single grouping of the hits by language,
format, validity and spelling.  Its map-side half already folds repeated ISBNs,
its result has one row per distinct ISBN and language, and everything else is a
further grouping of that small table.  No distinct aggregate has to expand rows,
and neither a dominant language nor a dominant ISBN ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from colophon import functions as C
from colophon.functions import patterns as p
from colophon.operators import position as P
from colophon.operators.hits import with_checks

ROLLUP_KEYS = ("language", "format", "is_valid", "unique_form")


def _rollup(rows: DataFrame, *keys: str) -> DataFrame:
    k = F.col("k")
    return rows.groupBy(*keys, *ROLLUP_KEYS).agg(
        F.count(k).alias("hits"),
        # An article is counted at its first hit, or at its only, empty row.
        F.count_if(k.isNull() | (k == 0)).alias("articles"),
        F.count_if(k == 0).alias("articles_with_isbn"),
    )


def rollup_articles(scanned: DataFrame, *keys: str) -> DataFrame:
    """Rollup of scanned articles (``language``, ``found``), hits and articles at once; per ``keys``, if any.

    Articles without a hit stay as a row of their own, so one pass gives the
    number of articles processed as well.
    """
    rows = scanned.select(*keys, "language", F.posexplode_outer("found").alias("k", "hit"))
    hits = with_checks(rows.select(*keys, "language", "k", F.col("hit.isbn").alias("isbn")))
    is_hit = F.col("k").isNotNull()
    return _rollup(
        hits.select(
            *keys,
            "language",
            "k",
            F.when(is_hit, F.col("format")).alias("format"),
            F.when(is_hit, F.col("is_valid")).alias("is_valid"),
            C.strip_separators("isbn").alias("unique_form"),
        ),
        *keys,
    )


def fold_rollups(rollups: DataFrame) -> DataFrame:
    """One rollup of several, such as those of single dumps."""
    return rollups.groupBy(*ROLLUP_KEYS).agg(*[F.sum(c).alias(c) for c in ("hits", "articles", "articles_with_isbn")])


def rollup_hits(hits: DataFrame) -> DataFrame:
    """Rollup of a hits table; articles without a hit are not in it."""
    return _rollup(hits.withColumn("unique_form", C.strip_separators("isbn")))


def _valid(n: str = "hits") -> Column:
    return F.coalesce(F.sum(F.when(F.col("is_valid"), F.col(n))), F.lit(0)).cast("long")


def _invalid(n: str = "hits") -> Column:
    return F.coalesce(F.sum(F.when(~F.col("is_valid"), F.col(n))), F.lit(0)).cast("long")


def _across_languages(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("format", "is_valid", "unique_form").agg(
        F.sum("hits").alias("hits"),
        F.sum("articles").alias("articles"),
        F.sum("articles_with_isbn").alias("articles_with_isbn"),
    )


def totals(rollup: DataFrame) -> DataFrame:
    """One row: articles with and without hits, valid, invalid, rate, uniques, formats."""

    def by_format(name: str, valid: bool) -> Column:
        wanted = (F.col("format") == name) & (F.col("is_valid") == F.lit(valid))
        return F.coalesce(F.sum(F.when(wanted, F.col("hits"))), F.lit(0)).cast("long")

    row = _across_languages(rollup).agg(
        F.coalesce(F.sum("articles"), F.lit(0)).alias("articles_processed"),
        F.coalesce(F.sum("articles_with_isbn"), F.lit(0)).alias("articles_with_isbn"),
        _valid().alias("valid"),
        _invalid().alias("invalid"),
        F.count_if(F.col("is_valid")).alias("unique_valid"),
        F.count_if(~F.col("is_valid")).alias("unique_invalid"),
        by_format(p.FORMAT_10, True).alias("isbn10_valid"),
        by_format(p.FORMAT_10, False).alias("isbn10_invalid"),
        by_format(p.FORMAT_13, True).alias("isbn13_valid"),
        by_format(p.FORMAT_13, False).alias("isbn13_invalid"),
    )
    total = F.col("valid") + F.col("invalid")
    return row.select(
        "articles_processed",
        "articles_with_isbn",
        (F.col("articles_processed") - F.col("articles_with_isbn")).alias("articles_without_isbn"),
        total.alias("total"),
        "valid",
        "invalid",
        C.pass_rate("valid", total).alias("pass_rate"),
        "unique_valid",
        "unique_invalid",
        "isbn10_valid",
        "isbn10_invalid",
        "isbn13_valid",
        "isbn13_invalid",
    )


def unique_isbns(rollup: DataFrame) -> DataFrame:
    """Distinct valid and invalid ISBNs; ``x`` and ``X`` count apart."""
    return totals(rollup).select("unique_valid", "unique_invalid")


def approx_unique_isbns(hits: DataFrame) -> DataFrame:
    """The same from sketches, when an estimate is enough."""
    form = C.strip_separators("isbn")
    return hits.agg(
        F.approx_count_distinct(F.when(F.col("is_valid"), form)).alias("unique_valid"),
        F.approx_count_distinct(F.when(~F.col("is_valid"), form)).alias("unique_invalid"),
    )


def format_breakdown(rollup: DataFrame) -> DataFrame:
    """Valid and invalid counts of both formats; a format without hits shows zeros."""
    rows = [
        F.struct(
            F.lit(name).alias("format"),
            F.col(f"{column}_valid").alias("valid"),
            F.col(f"{column}_invalid").alias("invalid"),
        )
        for name, column in ((p.FORMAT_10, "isbn10"), (p.FORMAT_13, "isbn13"))
    ]
    return totals(rollup).select(F.inline(F.array(*rows)))


def language_breakdown(rollup: DataFrame) -> DataFrame:
    """Per language with a hit, sorted by code."""
    rows = rollup.groupBy("language").agg(
        F.sum("articles").alias("articles_processed"),
        F.sum("articles_with_isbn").alias("articles_with_isbn"),
        _valid().alias("valid"),
        _invalid().alias("invalid"),
        F.count_if(F.col("is_valid")).alias("unique_valid"),
        F.count_if(~F.col("is_valid")).alias("unique_invalid"),
    )
    total = F.col("valid") + F.col("invalid")
    return (
        rows.filter(F.col("articles_with_isbn") > 0)
        .select(
            "language",
            "articles_processed",
            "articles_with_isbn",
            total.alias("total"),
            "valid",
            "invalid",
            C.pass_rate("valid", total).alias("pass_rate"),
            "unique_valid",
            "unique_invalid",
        )
        .orderBy("language")
    )


def articles_processed(articles: DataFrame, *keys: str) -> DataFrame:
    """Articles per ``keys`` (dump or language), those without a hit included."""
    return articles.groupBy(*(keys or ("language",))).agg(
        F.count(F.lit(1)).alias("articles_processed")
    )


def attach_article_counts(breakdown: DataFrame, counts: DataFrame) -> DataFrame:
    """Put separately computed article counts next to a breakdown made from hits alone."""
    return breakdown.drop("articles_processed").join(counts, "language", "left")


def failure_counts(failed: DataFrame) -> DataFrame:
    """Failures in total, by format and by language: ``(dimension, value, failed)``.

    All three are sums over the counted pairs; the branches share their shuffle,
    so the failures are read once.
    """
    pairs = failed.groupBy("format", "language").agg(F.count(F.lit(1)).alias("n"))

    def counted(dimension: str, value: Column, rows: GroupedData | DataFrame) -> DataFrame:
        sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed"))
        return sums.select(F.lit(dimension).alias("dimension"), value.alias("value"), "failed")

    return (
        counted("total", F.lit(None).cast("string"), pairs)
        .unionByName(counted("format", F.col("format"), pairs.groupBy("format")))
        .unionByName(counted("language", F.col("language"), pairs.groupBy("language")))
    )


def top_failing_articles(
    failed: DataFrame, order: tuple[str, ...], n: int = p.TOP_ARTICLES, title: str = "article_title"
) -> DataFrame:
    """Articles with most failures; ties keep the order of first appearance."""
    place = P.packed(failed, order) if P.fits(failed, order) else F.struct(*order)
    counted = failed.groupBy(title).agg(F.count(F.lit(1)).alias("failed"), F.min(place).alias("first_seen"))
    top = counted.orderBy(F.desc("failed"), F.asc("first_seen")).limit(n)
    return top.select(title, "failed")


def run_speed(articles: int, seconds: float, like: DataFrame) -> DataFrame:
    """Articles per second of a finished run; NULL when no time has passed."""
    one = like.sparkSession.range(1)
    return one.select(
        F.lit(articles).cast("long").alias("articles"),
        F.lit(seconds).cast("double").alias("seconds"),
        C.speed(F.lit(articles), F.lit(seconds).cast("double")).alias("articles_per_second"),
    )


# -- fixed values: the readable summary -----------------------------------------
SUMMARY = (
    "\nISBN Validation Summary\n"
    "=======================\n"
    "Total ISBNs found: %s\n"
    "Valid ISBNs: %s (%s%%)\n"
    "Invalid ISBNs: %s (%s%%)\n"
    "\n"
    "Unique ISBNs:\n"
    "- Valid: %s\n"
    "- Invalid: %s\n"
    "\n"
    "Articles processed: %s\n"
)
NOTHING_FOUND = "No ISBNs found"
# -- end of fixed values --------------------------------------------------------


def statistics_summary(rollup: DataFrame) -> DataFrame:
    """One row with the readable summary; it counts the articles that have a hit."""
    rate = F.col("pass_rate")
    text = F.format_string(
        SUMMARY,
        C.thousands("total"),
        C.thousands("valid"),
        C.fixed(rate, 2),
        C.thousands("invalid"),
        C.fixed(F.lit(100.0) - rate, 2),
        C.thousands("unique_valid"),
        C.thousands("unique_invalid"),
        C.thousands("articles_with_isbn"),
    )
    return totals(rollup).select(
        F.when(F.col("total") == 0, F.lit(NOTHING_FOUND)).otherwise(text).alias("summary")
    )
