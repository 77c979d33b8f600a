"""From article text to hits: the core table of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon import functions as C
from colophon.functions import patterns as p
from colophon.operators import position as P
from colophon.operators.once import compute_once

HIT_COLUMNS = (
    "language", "title", "url", "k", "isbn", "normalized", "format", "context", "is_valid",
)


def _without(df: DataFrame, *dropped: str) -> list[str]:
    return [c for c in df.columns if c not in dropped]


def scan_articles(
    articles: DataFrame,
    text_col: str = "text",
    context: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
    offsets: bool = False,
) -> DataFrame:
    """Replace the text by ``found``, the ISBNs in it; keep every article.

    This is the only step that touches text.  Its result is narrow: articles
    without a hit carry NULL or an empty array.
    """
    found = C.find_potential_isbns(text_col, context, proximity, offsets)
    return articles.select(*_without(articles, text_col), found.alias("found"))


def with_checks(hits: DataFrame) -> DataFrame:
    """Add ``format`` and ``is_valid`` to rows with an ``isbn``.

    The steps are columns of their own, so each is computed once, and so is the
    result, on which failures are filtered.
    """
    steps = hits.withColumn("bare", C.bare_isbn("isbn")).withColumn("number", C.isbn_number("bare"))
    return compute_once(
        steps,
        C.format_of_length(F.length("bare")).alias("format"),
        C.isbn_holds("bare", "number").alias("is_valid"),
    ).drop("bare", "number")


def _with_labels(hits: DataFrame, kept: list[str], offsets: bool) -> DataFrame:
    return with_checks(hits).select(
        *kept,
        "k",
        "isbn",
        C.normalize_isbn("isbn").alias("normalized"),
        "format",
        "context",
        *(["start"] if offsets else []),
        "is_valid",
    )


def explode_found(scanned: DataFrame) -> DataFrame:
    """One row per hit, ``k`` counting the hits of an article in text order."""
    kept = _without(scanned, "found")
    rows = scanned.select(*kept, F.posexplode("found").alias("k", "hit"))
    hits = rows.select(*kept, "k", "hit.*")
    return _with_labels(hits, kept, "start" in hits.columns)


def find_isbns(
    articles: DataFrame,
    text_col: str = "text",
    context: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
    offsets: bool = False,
) -> DataFrame:
    """Hits of every article: all other columns plus ``k``, ``isbn``,
    ``normalized``, ``format``, ``context``, ``is_valid`` and, with ``offsets``,
    ``start``.  One stage, no shuffle.
    """
    windows = C.Windows(context, proximity)
    found = C.hit_windows(text_col, windows, offsets)
    kept = _without(articles, text_col)
    # Exploding the expression itself, rather than a column that holds it,
    # keeps the optimizer from repeating it in a size filter below.
    rows = articles.select(*kept, F.posexplode(found).alias("k", "hit"))
    hits = rows.select(*kept, "k", *windows.fields(F.col("hit"), offsets))
    return _with_labels(hits, kept, offsets)


def find_candidates(
    articles: DataFrame, text_col: str = "text", context: int = p.DEFAULT_CONTEXT
) -> DataFrame:
    """Every number of ISBN shape, near the keyword or not, with its offset."""
    windows = C.Windows(context)
    kept = _without(articles, text_col)
    clean = articles.select(*kept, C.strip_urls(text_col).alias("clean"))
    rows = clean.select(*kept, F.posexplode(windows.with_starts(F.col("clean"))).alias("k", "hit"))
    return rows.select(*kept, "k", *windows.fields(F.col("hit"), True))


def article_results(
    articles: DataFrame,
    text_col: str = "text",
    context: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
) -> DataFrame:
    """One row per article with a hit: ``total_found``, ``valid_isbns``, ``invalid_isbns``."""
    found = C.find_potential_isbns(text_col, context, proximity)
    kept = _without(articles, text_col)
    with_hits = F.filter(F.array(found), lambda hits: F.size(hits) > 0)
    rows = articles.select(*kept, F.explode(with_hits).alias("found"))
    return results_of(rows)


def results_of(scanned: DataFrame) -> DataFrame:
    """Per-article results from the ``found`` arrays, in text order, without a shuffle."""
    kept = _without(scanned, "found")
    rows = scanned.filter(F.size("found") > 0).select(
        *kept, "found", F.transform("found", lambda h: C.validate_isbn(h["isbn"])).alias("ok")
    )
    return rows.select(
        *kept,
        F.size("found").alias("total_found"),
        F.filter("found", lambda _, i: F.get("ok", i)).alias("valid_isbns"),
        F.filter("found", lambda _, i: ~F.get("ok", i)).alias("invalid_isbns"),
    )


def failed_isbns(hits: DataFrame, *order: str) -> DataFrame:
    """The failures in the columns of the CSV, plus any ``order`` columns."""
    return hits.filter(~F.col("is_valid")).select(
        F.col("title").alias("article_title"),
        "language",
        "isbn",
        "format",
        "context",
        F.col("url").alias("article_url"),
        *order,
    )


def deduplicate_isbns(isbns: DataFrame, order: tuple[str, ...], isbn_col: str = "isbn") -> DataFrame:
    """First spelling of each normalised ISBN, in the order of first appearance.

    ``order`` must order the rows totally.  The map side keeps one row per spelling, so
    an ISBN that fills a third of the input is one row by the time it moves.  An order
    of whole numbers is folded by hash and then ranked; any other one is sorted first.
    """
    normalized = C.normalize_isbn(isbn_col).alias("normalized")
    spelling = [normalized, F.col(isbn_col).alias("isbn")]
    if P.fits(isbns, order):
        spelled = isbns.groupBy(*spelling).agg(F.min(P.packed(isbns, order)).alias("at"))
        # A spelling is a string, for which a grouping would sort all rows twice; ranks are limited before the shuffle.
        turn = F.row_number().over(Window.partitionBy("normalized").orderBy("at", "isbn"))
        first = spelled.withColumn("turn", turn).filter("turn = 1").orderBy("at")
        return first.select("normalized", "isbn", *P.unpacked(isbns, order, "at"))
    spelled = isbns.groupBy(*spelling).agg(F.min(F.struct(*order)).alias("at"))
    first = spelled.groupBy("normalized").agg(F.min(F.struct("at", "isbn")).alias("first")).orderBy("first.at")
    return first.select("normalized", "first.isbn", "first.at.*")
