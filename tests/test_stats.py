import csv
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colophon import analyze_invalid_isbns
from colophon.operators import hits as H
from colophon.operators import stats as S
from colophon.sources.failed_csv import read_failed_csv, write_failed_csv
from colophon.sources.reports import pass_rates, read_reports
from tests import plain

TEXTS = [
    ("en", "One", "ISBN 0306406152 and ISBN 0306406153"),
    ("en", "Two", "ISBN 080442957x, ISBN 080442957X"),
    ("en", "None", "nothing here"),
    ("de", "Drei", "ISBN 0-306-40615-3; ISBN 978-0-306-40615-7; ISBN 978-0-306-40615-8"),
    ("fr", "Rien", "isbn"),
]


@pytest.fixture
def articles(spark):
    return spark.createDataFrame(TEXTS, "language STRING, title STRING, text STRING").withColumn("url", F.col("title"))


def test_rollup_serves_all_statistics(articles):
    rollup = S.rollup_articles(H.scan_articles(articles)).cache()
    assert S.totals(rollup).first().asDict() == {
        "articles_processed": 5, "articles_with_isbn": 3, "articles_without_isbn": 2, "total": 7, "valid": 4,
        "invalid": 3, "pass_rate": 4 / 7 * 100, "unique_valid": 4, "unique_invalid": 2,
        "isbn10_valid": 3, "isbn10_invalid": 2, "isbn13_valid": 1, "isbn13_invalid": 1,
    }
    assert [tuple(r) for r in S.language_breakdown(rollup).collect()] == [
        ("de", 1, 1, 3, 1, 2, 1 / 3 * 100, 1, 2),
        ("en", 3, 2, 4, 3, 1, 75.0, 3, 1),
    ]
    assert [tuple(r) for r in S.format_breakdown(rollup).collect()] == [("ISBN-10", 3, 2), ("ISBN-13", 1, 1)]
    assert tuple(S.unique_isbns(rollup).first()) == (4, 2)
    text = S.statistics_summary(rollup).first()[0]
    assert "Valid ISBNs: 4 (57.14%)\nInvalid ISBNs: 3 (42.86%)" in text and text.endswith("Articles processed: 3\n")


def test_rollup_of_hits_and_joined_counts(articles):
    hits = H.find_isbns(articles)
    breakdown = S.language_breakdown(S.rollup_hits(hits))
    both = S.attach_article_counts(breakdown, S.articles_processed(articles)).collect()
    assert {(r["language"], r["articles_processed"], r["total"]) for r in both} == {("de", 1, 3), ("en", 3, 4)}
    assert tuple(S.approx_unique_isbns(hits).first()) == (4, 2)


def test_nothing_found(spark):
    empty = spark.createDataFrame([("en", "x")], "language STRING, text STRING")
    rollup = S.rollup_articles(H.scan_articles(empty))
    assert S.statistics_summary(rollup).first()[0] == "No ISBNs found"
    assert [tuple(r) for r in S.format_breakdown(rollup).collect()] == [("ISBN-10", 0, 0), ("ISBN-13", 0, 0)]
    assert S.language_breakdown(rollup).count() == 0
    none = S.totals(S.rollup_articles(H.scan_articles(empty.limit(0)))).first()
    assert (none["articles_processed"], none["total"], none["pass_rate"]) == (0, 0, 0.0)


def test_run_speed(spark):
    like = spark.range(1)
    assert S.run_speed(10, 4.0, like).first()["articles_per_second"] == 2.5
    assert S.run_speed(10, 0.0, like).first()["articles_per_second"] is None


NASTY = [
    ("A, b", "en", "1", "ISBN-10", ' "quoted", comma\nand line \r\n end  ', "u"),
    ("B", "de", "2", "ISBN-13", "  back\\slash \\\" \t", "u,v"),
    ("Ü😀", "de", "3", "ISBN-10", "a\rb", "'"),
    ("B", "de", "4", "ISBN-10", "#x", "u"),
]


def test_csv_round_trip(spark, tmp_path):
    columns = "article_title STRING, language STRING, isbn STRING, format STRING, context STRING, article_url STRING"
    path = write_failed_csv(spark.createDataFrame(NASTY, columns).coalesce(1), str(tmp_path / "csv"), ("isbn",))
    rows = read_failed_csv(spark, path).orderBy("file", "row_id").drop("file", "row_id").collect()
    assert [tuple(r) for r in rows] == NASTY
    read = []
    for part in sorted((tmp_path / "csv").glob("part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            read += [tuple(r.values()) for r in csv.DictReader(f)]
    assert read == NASTY


def test_csv_of_other_writers(spark, tmp_path):
    with open(tmp_path / "other.csv", "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(["isbn", "context", "article_title"])
        writer.writerows([("1", ' a "b"\nc ', "T"), ("2", "", "T"), ("3", "x", "S")])
    rows = read_failed_csv(spark, str(tmp_path / "other.csv")).orderBy("row_id").collect()
    assert [(r["isbn"], r["context"], r["article_title"], r["format"], r["language"]) for r in rows] == [
        ("1", ' a "b"\nc ', "T", "Unknown", "unknown"), ("2", "", "T", "Unknown", "unknown"),
        ("3", "x", "S", "Unknown", "unknown"),
    ]
    analysis = analyze_invalid_isbns(spark, str(tmp_path / "other.csv"))
    assert {tuple(r) for r in analysis.counts.collect()} == {
        ("total", None, 3), ("format", "Unknown", 3), ("language", "unknown", 3)}
    assert [tuple(r) for r in analysis.top_articles.collect()] == [("T", 2), ("S", 1)]


def test_missing_csv_counts_nothing(spark, tmp_path):
    analysis = analyze_invalid_isbns(spark, str(tmp_path / "absent"))
    assert {tuple(r) for r in analysis.counts.collect()} == {("total", None, 0)}
    assert analysis.top_articles.count() == 0


def test_top_articles_ties_keep_first_seen(spark):
    rows = [(i, t) for i, t in enumerate("b a c b d e f g h i j k l a m c c".split())]
    failed = spark.createDataFrame(rows, "i INT, article_title STRING").repartition(4)
    got = [tuple(r) for r in S.top_failing_articles(failed, ("i",)).collect()]
    assert got == Counter(t for _, t in rows).most_common(10)


def test_report_reading(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        "  ZZ:\n Pass rate: 1.0%\nLanguage Breakdown:\n\n  EN:\n    x\n    Pass rate: 96.50%\n\n  ZH-YUE:\n    Pass rate: 5%\n  bad:\n")
    (tmp_path / "b.txt").write_text("no section\n  EN:\n Pass rate: 1%\n")
    rows = pass_rates(read_reports(spark, str(tmp_path))).collect()
    assert [(r["wiki"], r["pass_rate"]) for r in rows] == [("EN", 96.5), ("ZH-YUE", 5.0)]
    assert all(r["file"].endswith("a.txt") for r in rows)


def test_brute_force_counts(spark):
    texts = [("en" if i % 3 else "de", f"ISBN {i % 7:09d}{i % 10}, ISBN 97803064061{i % 100:02d}") for i in range(300)]
    df = spark.createDataFrame(texts, "language STRING, text STRING")
    rows = {r["language"]: r for r in S.language_breakdown(S.rollup_articles(H.scan_articles(df))).collect()}
    for language in ("en", "de"):
        found = [i for lang, t in texts if lang == language for i, _, _ in plain.find(t)]
        good = [i for i in found if plain.valid(i)]
        bad = [i for i in found if not plain.valid(i)]
        r = rows[language]
        assert (r["valid"], r["invalid"], r["unique_valid"], r["unique_invalid"]) == (
            len(good), len(bad), len(set(good)), len(set(bad)))


def test_spread_does_as_told(spark):
    from colophon.workspace import spread

    for rows in (3, 30_000):
        assert spread(spark.range(rows), 5, "id").rdd.getNumPartitions() == 5
