"""Auditing only the dumps that are new since the last run.

The transformations are those of the batch job; the file source remembers in
its checkpoint which dumps it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colophon.functions import patterns as p
from colophon.plans.ledger import GOOD, Ledger
from colophon.operators.hits import find_isbns
from colophon.operators.stats import articles_processed
from colophon.sources import dumps as D


def stream_articles(
    spark: SparkSession, dumps_dir: str, on_error: str = "skip_page", files_per_batch: int | None = None
) -> DataFrame:
    """Articles of arriving dumps.  A stream cannot take back a dump it has begun."""
    if on_error == "drop_dump":
        raise ValueError("a stream cannot drop a dump; use 'fail' or 'skip_page'")
    pages = D.parse_pages(D.read_records(spark, dumps_dir, streaming=True, files_per_batch=files_per_batch), on_error)
    articles = D.keep_articles(pages.filter(F.col("kind") == "page"))
    return articles.select(*D.POSITION, "language", "title", "text", "url")


def append_new_hits(
    spark: SparkSession,
    dumps_dir: str,
    output: str,
    checkpoint: str,
    context: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
    on_error: str = "skip_page",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the hits of all dumps not seen before to the table at ``output``, then stop.

    With ``files_per_batch`` a backlog is worked off in several batches, and a failure
    repeats only the last of them.
    """
    hits = find_isbns(stream_articles(spark, dumps_dir, on_error, files_per_batch), "text", context, proximity)
    return (
        hits.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def update_article_counts(
    spark: SparkSession,
    dumps_dir: str,
    output: str,
    checkpoint: str,
    on_error: str = "skip_page",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Keep the number of articles per language over all runs below ``output``.

    State holds one row per language.  Each batch writes the whole table anew as
    ``batch=<number>``; :func:`read_article_counts` takes the newest, so readers always
    find a full table, and a batch that is repeated writes the same one.
    """
    counts = articles_processed(stream_articles(spark, dumps_dir, on_error, files_per_batch), "language")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return (
        counts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def read_article_counts(spark: SparkSession, output: str) -> DataFrame:
    """``(language, articles_processed)`` after the newest batch that is written to its end."""
    # The files of a batch appear when its job commits, after all of them are written.
    rows = spark.read.parquet(output)
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(newest, "batch", "left_semi").select("language", "articles_processed")


ARRIVALS = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def follow_dumps(spark: SparkSession, dumps_dir: str, ledger: Ledger, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Commit all dumps that have arrived since the last run to ``ledger``, whole dumps only, then stop.

    The stream is one of files, none of which it opens: each batch says which dumps have
    arrived, and the ledger reads and judges them.  A dump without its end, or with parts
    that are still to come, is read again when its files have changed and anything
    arrives.  A batch that is repeated finds its dumps in the manifest.
    """
    reader = spark.readStream.format("binaryFile").schema(ARRIVALS).option("pathGlobFilter", p.DUMP_GLOB)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    inside = F.regexp_extract("path", "/dump=([^/]+)/[^/]*$", 1)
    name = F.when(inside != "", F.url_decode(inside)).otherwise(F.element_at(F.split("path", "/"), -1))
    arrived = reader.load(dumps_dir).select(name.alias("dump_file"))

    def commit(rows: DataFrame, _batch: int) -> None:
        # Names of files only, which the source holds in the driver as well.
        names = {r["dump_file"] for r in rows.distinct().collect()}
        unfinished = ledger.dumps().filter(F.col("state") != GOOD).select("dump_file").collect()
        ledger.add(dumps_dir, names | {r["dump_file"] for r in unfinished})

    return arrived.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
