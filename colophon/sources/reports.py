"""Text reports: writing the lines of one, reading the rates of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.functions.labels import fixed, language_label, speed, thousands
from colophon.functions.text import as_column, ColumnLike


# -- fixed values: the lines of a report, with the metric each one shows ---------
TITLE = ("Wikipedia ISBN Extraction Report", "=" * 60, "")
RUN = (
    ("Run Date: %s", "run_date"),
    ("Processing Time: %s seconds", "seconds"),
    ("Processing Speed: %s articles/second", "speed"),
    ("", None),
    ("Wikis Processed: %s", "dumps"),
    ("Dump Files:", None),
)
DUMP = "  - %s"
TOTALS = (
    ("", None),
    ("Article Statistics:", None),
    ("  Total articles processed: %s", "articles_processed"),
    ("  Articles with ISBNs: %s", "articles_with_isbn"),
    ("  Articles without ISBNs: %s", "articles_without_isbn"),
    ("", None),
    ("ISBN Statistics:", None),
    ("  Total ISBNs found: %s", "total"),
    ("  Valid ISBNs (checksum passed): %s", "valid"),
    ("  Invalid ISBNs (checksum failed): %s", "invalid"),
    ("  Pass rate: %s%%", "pass_rate"),
    ("", None),
    ("Unique ISBN Statistics:", None),
    ("  Unique valid ISBNs: %s", "unique_valid"),
    ("  Unique invalid ISBNs: %s", "unique_invalid"),
    ("", None),
    ("Format Breakdown:", None),
    ("  ISBN-10 (valid): %s", "isbn10_valid"),
    ("  ISBN-10 (invalid): %s", "isbn10_invalid"),
    ("  ISBN-13 (valid): %s", "isbn13_valid"),
    ("  ISBN-13 (invalid): %s", "isbn13_invalid"),
    ("", None),
)
LANGUAGE = (
    ("", None),
    ("  %s:", "label"),
    ("    Total articles processed: %s", "articles_processed"),
    ("    Articles with ISBNs: %s", "articles_with_isbn"),
    ("    Total ISBNs: %s", "total"),
    ("    Valid ISBNs: %s", "valid"),
    ("    Invalid ISBNs: %s", "invalid"),
    ("    Pass rate: %s%%", "pass_rate"),
    ("    Unique valid: %s", "unique_valid"),
    ("    Unique invalid: %s", "unique_invalid"),
)
# -- end of fixed values ------------------------------------------------------------


def _lines(rows: DataFrame, section: int, key: Column, lines: list[Column]) -> DataFrame:
    numbered = rows.select(key.alias("key"), F.posexplode(F.array(*lines)).alias("i", "line"))
    return numbered.select(F.struct(F.lit(section).alias("section"), "key", "i").alias("position"), "line")


def _filled(template: tuple, values: dict[str, Column]) -> list[Column]:
    return [
        F.lit(text) if metric is None else F.format_string(text, values[metric])
        for text, metric in template
    ]


def report_lines(
    totals: DataFrame, languages: DataFrame, dumps: DataFrame, seconds: float, run_date: str
) -> DataFrame:
    """``(position, line)`` of the text report.

    ``totals`` is one row; ``languages`` gets a breakdown when there are several;
    ``dumps`` has the ``file_name`` of every dump, a row each.
    """

    def shown(row: DataFrame) -> dict[str, Column]:
        counts = {c: thousands(c) for c in row.columns if c not in ("language", "pass_rate")}
        return {**counts, "pass_rate": fixed("pass_rate", 2)}

    elapsed = F.lit(float(seconds))
    run = {
        "run_date": F.lit(run_date),
        "seconds": fixed(elapsed, 1),
        "speed": F.coalesce(fixed(speed("articles_processed", elapsed), 1), F.lit("n/a")),
        "dumps": F.lit(str(dumps.count())),
    }
    report = (
        _lines(totals, 0, F.lit(""), [*(F.lit(text) for text in TITLE), *_filled(RUN, run)])
        .unionByName(_lines(dumps, 1, F.col("file_name"), [F.format_string(DUMP, "file_name")]))
        .unionByName(_lines(totals, 2, F.lit(""), _filled(TOTALS, shown(totals))))
    )
    if languages.limit(2).count() < 2:
        return report
    values = {**shown(languages), "label": language_label("language")}
    one_row = totals.sparkSession.range(1)
    return report.unionByName(
        _lines(one_row, 3, F.lit(""), [F.lit(p.REPORT_SECTION)])
    ).unionByName(_lines(languages, 4, F.col("language"), _filled(LANGUAGE, values)))


def write_report(lines: DataFrame, path: str) -> str:
    """Write ``(position, line)`` as one text file.

    A report has a few lines per language, so a single task is enough.
    """
    lines.coalesce(1).sortWithinPartitions("position").select("line").write.text(path)
    return path


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(file, content)``, one row per report."""
    reports = spark.read.text(path, wholetext=True)
    return reports.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")
    )


def pass_rates(reports: DataFrame, content: ColumnLike = "content") -> DataFrame:
    """``(…, wiki, pass_rate)`` of every language block in the given reports."""
    # Line ends of any system, as a file opened as text has them.
    content = F.regexp_replace(as_column(content), r"\r\n?", "\n")
    at = F.instr(content, p.REPORT_SECTION)
    section = F.when(at > 0, F.substr(content, at))
    pairs = F.arrays_zip(
        F.regexp_extract_all(section, F.lit(p.REPORT_LANGUAGE), F.lit(1)).alias("wiki"),
        F.regexp_extract_all(section, F.lit(p.REPORT_LANGUAGE), F.lit(2)).alias("rate"),
    )
    kept = [c for c in reports.columns if c != "content"]
    return reports.select(*kept, F.explode(pairs).alias("pair")).select(
        *kept,
        F.col("pair.wiki").alias("wiki"),
        F.col("pair.rate").try_cast("double").alias("pass_rate"),
    )
