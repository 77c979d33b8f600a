"""Analysis of a failure table that an audit has written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from colophon.functions import patterns as p
from colophon.operators.stats import failure_counts, top_failing_articles
from colophon.sources.failed_csv import read_failed_csv


@dataclass
class FailureAnalysis:
    counts: DataFrame
    top_articles: DataFrame


def analyze_invalid_isbns(spark: SparkSession, path: str, n: int = p.TOP_ARTICLES) -> FailureAnalysis:
    """Failures in total, by format and by language, and the articles with most of them."""
    failed = read_failed_csv(spark, path)
    return FailureAnalysis(
        counts=failure_counts(failed),
        top_articles=top_failing_articles(failed, ("file", "row_id"), n),
    )
