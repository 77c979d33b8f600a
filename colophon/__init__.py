"""Spark-native extraction and audit of ISBNs in large text collections."""

from colophon.operators.hits import (
    article_results,
    deduplicate_isbns,
    failed_isbns,
    find_candidates,
    find_isbns,
    scan_articles,
)
from colophon.operators.stats import (
    format_breakdown,
    language_breakdown,
    rollup_articles,
    rollup_hits,
    totals,
    unique_isbns,
)
from colophon.plans.audit import AuditRun, DumpError, run_audit
from colophon.plans.failures import analyze_invalid_isbns
from colophon.sources.dumps import read_articles

__all__ = [
    "AuditRun", "DumpError", "analyze_invalid_isbns", "article_results",
    "deduplicate_isbns", "failed_isbns", "find_candidates", "find_isbns",
    "format_breakdown", "language_breakdown", "read_articles", "rollup_articles",
    "rollup_hits", "run_audit", "scan_articles", "totals", "unique_isbns",
]
