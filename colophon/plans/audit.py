"""The audit from end to end: dumps in, report and failure table out.

The dumps are read once.  That pass writes the *ledger*, a narrow table with one
row per article (its hits, or nothing) and one row per broken or closing record.
Report, CSV and analysis read only the ledger, never the text again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon import functions as C
from colophon.functions import patterns as p
from colophon.operators import hits as H
from colophon.operators import stats as S
from colophon.sources import dumps as D
from colophon.sources.failed_csv import write_failed_csv
from colophon.sources.inventory import dump_names
from colophon.sources.reports import report_lines, write_report
from colophon.sources.dumps import DumpError
from colophon.workspace import store

__all__ = ["AuditRun", "DumpError", "ledger_of", "run_audit"]

LEDGER_ORDER = (*D.POSITION, "k")


@dataclass
class AuditRun:
    """What a run leaves behind; tables are read lazily from the ledger."""

    scanned: DataFrame
    rollup: DataFrame
    failed_dumps: list[str]
    seconds: float
    report_path: str | None = None
    csv_path: str | None = None
    totals: dict = field(default_factory=dict)

    def hits(self) -> DataFrame:
        return H.explode_found(self.scanned)

    def results(self) -> DataFrame:
        return H.results_of(self.scanned)

    def failed(self) -> DataFrame:
        return H.failed_isbns(self.hits(), *LEDGER_ORDER)

    def speed(self) -> DataFrame:
        return S.run_speed(self.totals["articles_processed"], self.seconds, self.rollup)


def ledger_of(
    pages: DataFrame,
    context: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
) -> DataFrame:
    """Ledger rows of parsed pages: articles with what was found, broken and closing records."""
    counts = F.col("kind") != "page"
    rows = pages.filter(counts | D.is_article())
    scanned = H.scan_articles(rows, "text", context, proximity)
    has_hits = F.size("found") > 0
    found = F.explode(F.array("found")).alias("found")

    def if_hit(value: Column, name: str) -> Column:
        return F.when(has_hits, value).alias(name)

    # Places and names are kept only where they will be reported; the many rows
    # of articles without a hit are then alike and compress to almost nothing.
    return scanned.select(*D.POSITION, "language", "kind", "title", found).select(
        "dump_file",
        if_hit(F.col("part"), "part"),
        if_hit(F.col("row_id"), "row_id"),
        "language",
        "kind",
        if_hit(F.col("title"), "title"),
        if_hit(C.article_url("language", "title"), "url"),
        if_hit(F.col("found"), "found"),
    )


def run_audit(
    spark: SparkSession,
    dumps_dir: str,
    output: str | None = None,
    context: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
    on_error: str = "fail",
) -> AuditRun:
    """Audit every dump of a folder.

    ``on_error``: ``fail`` raises at the first malformed dump, ``drop_dump``
    leaves out everything of such a dump, ``skip_page`` only the bad page.
    With ``output``, a report is written below it when anything was found, and
    the failure table when anything failed.
    """
    begun = time.monotonic()
    ledger, _ = D.store_pages(
        spark, dumps_dir, on_error, lambda pages: ledger_of(pages, context, proximity), "ledger"
    )
    files = dump_names(spark, dumps_dir)
    names: list[str] = []
    if on_error != "skip_page":
        failed = store(D.failed_dumps(ledger, files), "failed-dumps")
        if on_error == "fail":
            D.raise_if_any(failed)
        else:
            # What a caller is told; the filter below is a join.
            names = [r[0] for r in failed.orderBy("dump_file").collect()]
            ledger = ledger.join(failed, "dump_file", "left_anti") if names else ledger
    scanned = ledger.filter(F.col("kind") == "page").drop("kind")
    rollup = store(S.rollup_articles(scanned), "rollup")
    sums = store(S.totals(rollup), "totals")
    totals = sums.first().asDict()
    run = AuditRun(scanned, rollup, names, time.monotonic() - begun, totals=totals)
    if output is None or totals["articles_with_isbn"] == 0:
        return run

    stamp = time.strftime("%Y-%m-%d %H:%M:%S")
    languages = store(S.language_breakdown(rollup), "languages")
    lines = report_lines(sums, languages, files, run.seconds, stamp)
    run.report_path = write_report(lines, f"{output}/report")
    if totals["invalid"]:
        run.csv_path = write_failed_csv(
            run.failed(), f"{output}/failed_csv", LEDGER_ORDER, stored=True
        )
    return run

