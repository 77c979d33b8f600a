"""Which dumps are still to be fetched, from pages and an inventory given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators import listing as L


def fetch_list(
    language_pages: DataFrame | None,
    inventory: DataFrame,
    index_pages: DataFrame,
    date_pages: DataFrame,
    languages: DataFrame | None = None,
) -> DataFrame:
    """``(language, date, url)``: the newest usable dump of each language not yet present.

    ``languages`` (language) names the languages wanted; without it they are read off
    ``language_pages``.  A language without a usable dump stays in the list with NULLs.
    """
    if languages is None:
        if language_pages is None:
            raise ValueError("give language_pages or languages")
        languages = L.language_codes(language_pages)
    missing = L.missing_languages(languages.select("language").distinct(), inventory)
    wanted_pages = index_pages.join(missing, "language", "left_semi")
    newest = L.latest_dump(L.dump_dates(wanted_pages), date_pages)
    return missing.join(newest, "language", "left").select("language", "date", "url").orderBy(
        F.col("language")
    )
