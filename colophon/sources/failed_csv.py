"""The table of failed ISBNs as CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.workspace import store

QUOTING = {"header": "true", "escape": '"'}
KEEP_SPACE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_failed_csv(
    failed: DataFrame,
    path: str,
    order: tuple[str, ...] = (),
    rows_per_file: int = 1_000_000,
    stored: bool = False,
) -> str:
    """Write the six columns with a header; ``order`` keeps the order of the dumps.

    Sorting reads its input twice, to sample it and to move it, so failures that
    are not ``stored`` yet are stored first and the text is searched once.  Quoted line breaks make a CSV file unsplittable for readers, so files are
    kept small enough to be one task each.
    """
    if order:
        failed = (failed if stored else store(failed, "failed")).orderBy(*order)
    (
        failed.select(*p.FAILED_COLUMNS)
        .write.options(**QUOTING, **KEEP_SPACE)
        .option("quoteAll", "true")
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )
    return path


def read_failed_csv(spark: SparkSession, path: str) -> DataFrame:
    """The six columns by name, plus ``file`` and ``row_id``, the order of rows.

    A column that the header lacks is filled with its fallback; a table that
    does not exist has no rows.  Files whose headers differ raise an error: read them
    one by one and union them by name.
    """
    try:
        rows = (
            spark.read.options(**QUOTING, **KEEP_SPACE)
            .option("multiLine", "true")
            .option("emptyValue", "")
            # Columns go by the header of the first file; another order must not pass.
            .option("enforceSchema", "false")
            .csv(path)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        names = ", ".join(f"{c} STRING" for c in (*p.FAILED_COLUMNS, "file"))
        return spark.createDataFrame([], f"{names}, row_id LONG")
    fallback = {
        "article_title": p.UNKNOWN_TITLE,
        "format": p.UNKNOWN_FORMAT,
        "language": p.UNKNOWN_LANGUAGE,
    }
    columns = [
        F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit(fallback.get(c)).cast("string").alias(c)
        for c in p.FAILED_COLUMNS
    ]
    return rows.select(
        *columns,
        F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("row_id"),
    )
