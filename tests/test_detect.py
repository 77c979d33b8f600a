import random

import pytest
from pyspark.sql import functions as F

from colophon import functions as C
from colophon.operators import hits as H
from tests import plain

GOLDEN = [
    ("ISBN 0-306-40615-2", [("0306406152", True)]),
    ("ISBN 978-0-306-40615-7", [("9780306406157", True)]),
    ("ISBN 978-0-306-40615-8", [("9780306406158", False)]),
    ("ISBN 080442957X", [("080442957X", True)]),
    ("ISBN 080442957x", [("080442957X", True)]),
    ("ISBN 1-4028-9462-7", [("1402894627", True)]),
    ("ISBN-13: 978-0-306-40615-7", [("9780306406157", True)]),
    ("ISBN-10: 0306406152", [("0306406152", True)]),
    ("ISBN-13 978-0-306-40615-7", []),
    ("ISBN-10 0-306-40615-2", []),
    ("ISBN 0306406152 1999", []),
    ("ISBN 0306406152 199", [("0306406152199", False)]),
    ("ISBN 978-0-306-40615-7 2005", [("9780306406157", True)]),
    ("ISBN 0306406152 and 9780306406157", [("0306406152", True)]),
    ("isbn      0306406152", [("0306406152", True)]),
    ("isbn       0306406152", []),
    ("OCLC 0306406152", []),
    ("https://x.org/isbn/0306406152", []),
    ("ISBN https://x.org/a 0306406152", [("0306406152", True)]),
    ("HTTP://x.org/isbn/0306406152", [("0306406152", True)]),
    ("ISBN 03064\n06152", [("0306406152", True)]),
    ("ISBN 0306406152_", []),
    ("ISBN 0306406152é", []),
    ("ISBN 030640615X2", []),
    ("ISBN 10306406152", []),
    ("ISBN ٠٣٠٦٤٠٦١٥٢", [("٠٣٠٦٤٠٦١٥٢", True)]),
    ("ISBN 0306406152, ISBN 0306406152", [("0306406152", True), ("0306406152", True)]),
    ("| isbn = 0306406152", [("0306406152", True)]),
    ("ISBN{{nbsp}}0306406152", []),
    ("ISBN 0–306–40615–2", []),
    ("ISBN 0000000000", [("0000000000", True)]),
    ("ISBN 0306406152²", []),
    ("ISBN 0306406152́", [("0306406152", True)]),
    ("isbnİ 0306406152", [("0306406152", True)]),
    ("isbnİİİ 0306406152", []),
    ("", []),
    ("no number", []),
]


def found(spark, texts, **options):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    out = {i: [] for i, _ in rows}
    for r in H.find_isbns(df, **options).orderBy("id", "k").collect():
        out[r["id"]].append(r)
    return [out[i] for i, _ in rows]


def test_golden_cases(spark):
    got = found(spark, [t for t, _ in GOLDEN])
    for (text, expected), rows in zip(GOLDEN, got):
        assert [(r["normalized"], r["is_valid"]) for r in rows] == expected, text


def random_texts(n, seed):
    rng = random.Random(seed)
    pieces = [
        "ISBN", "isbn", "eISBN", "ISBN-13:", " ", "  ", "\n", "\t", " ", " ", "\x1c", "-", "–", ":", ".",
        "0306406152", "9780306406157", "978-0-306-40615-7", "080442957X", "x", "X", "7", "12", "1999", "٣", "٤٥",
        "²", "é", "İ", "́", "😀", "𝟗", "_", "word", "http://a.b/isbn/0306406152", "https://é.x/1 ", "HTTP://", "\x85",
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("context,proximity", [(50, 6), (0, 0), (3, 30), (120, 10)])
def test_equals_brute_force_on_random_texts(spark, context, proximity):
    texts = random_texts(2500, seed=context * 100 + proximity)
    got = found(spark, texts, context=context, proximity=proximity, offsets=True)
    hits = 0
    for text, rows in zip(texts, got):
        expected = plain.find(text, context, proximity)
        assert [(r["isbn"], r["context"], r["start"]) for r in rows] == expected, repr(text)
        assert [r["is_valid"] for r in rows] == [plain.valid(i) for i, _, _ in expected], repr(text)
        hits += len(expected)
    assert hits > 100


def test_offsets_do_not_change_the_hits(spark):
    texts = random_texts(500, seed=5)
    with_offsets = found(spark, texts, offsets=True)
    without = found(spark, texts)
    strip = lambda rows: [(r["k"], r["isbn"], r["context"], r["is_valid"]) for r in rows]
    assert list(map(strip, with_offsets)) == list(map(strip, without))


def test_one_article_with_very_many_hits(spark):
    n = 30_000
    text = "".join(f"ISBN {i:09d}X; " for i in range(n))
    rows = found(spark, [text], offsets=True)[0]
    assert len(rows) == n
    assert [r["k"] for r in rows] == list(range(n))
    assert [r["start"] for r in rows] == [5 + 17 * i for i in range(n)]
    assert rows[-1]["context"].endswith(f"ISBN {n - 1:09d}X;")


def test_article_results_agree_with_hits(spark):
    texts = random_texts(800, seed=9) + [t for t, _ in GOLDEN]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    results = {r["id"]: r for r in H.article_results(df).collect()}
    for i, text in enumerate(texts):
        expected = plain.find(text)
        if not expected:
            assert i not in results
            continue
        pairs = [(isbn, context) for isbn, context, _ in expected]
        row = results[i]
        assert row["total_found"] == len(pairs)
        assert [tuple(h) for h in row["valid_isbns"]] == [h for h in pairs if plain.valid(h[0])]
        assert [tuple(h) for h in row["invalid_isbns"]] == [h for h in pairs if not plain.valid(h[0])]


def test_the_expensive_pattern_is_in_the_plan_once(spark):
    df = spark.createDataFrame([("t", "x")], "title STRING, text STRING")
    for plan in (H.article_results(df), H.find_isbns(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("regexp_extract_all") == 1


def test_candidates_need_no_keyword(spark):
    df = spark.createDataFrame([("OCLC 0306406152, ISBN 978-0-306-40615-7",)], "text STRING")
    rows = H.find_candidates(df).orderBy("k").collect()
    assert [(r["isbn"], r["start"]) for r in rows] == [("0306406152", 5), ("978-0-306-40615-7", 22)]


def test_every_single_digit_change_is_noticed(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        nine = "".join(rng.choice("0123456789") for _ in range(9))
        ten = next(nine + c for c in "0123456789X" if plain.valid(nine + c))
        twelve = "978" + nine
        thirteen = next(twelve + c for c in "0123456789" if plain.valid(twelve + c))
        for isbn in (ten, thirteen):
            rows.append((isbn, True))
            for i, old in enumerate(isbn):
                for new in "0123456789":
                    if new != old:
                        rows.append((isbn[:i] + new + isbn[i + 1 :], False))
    df = spark.createDataFrame(rows, "isbn STRING, expected BOOLEAN")
    assert df.filter(C.validate_isbn("isbn") != F.col("expected")).count() == 0


def test_direct_validation(spark):
    cases = [
        ("0-306-40615-2", True, False), ("080442957x", True, False), ("978 0 306 40615 7", False, True),
        ("٠٣٠٦٤٠٦١٥٢", True, False), ("030640615²", False, False), ("", False, False), ("123", False, False),
        ("97803064061X7", False, False), ("X306406152", False, False), (" 0306406152\n", True, False),
    ]
    df = spark.createDataFrame(cases, "isbn STRING, ten BOOLEAN, thirteen BOOLEAN")
    rows = df.select("*", C.validate_isbn10("isbn").alias("a"), C.validate_isbn13("isbn").alias("b")).collect()
    for r in rows:
        assert (r["a"], r["b"]) == (r["ten"], r["thirteen"]), r["isbn"]


def test_format_label_and_normal_forms(spark):
    df = spark.createDataFrame([("0-8044-2957-x",), ("978 0306406157",), ("12-3",)], "isbn STRING")
    rows = df.select(C.isbn_format("isbn"), C.normalize_isbn("isbn"), C.strip_separators("isbn")).collect()
    assert [tuple(r) for r in rows] == [
        ("ISBN-10", "080442957X", "080442957x"),
        ("ISBN-13", "9780306406157", "9780306406157"),
        ("Invalid (3 digits)", "123", "123"),
    ]


def test_deduplicate_keeps_first_spelling_in_order(spark):
    rows = [(0, "0-306-40615-2"), (1, "080442957x"), (2, "0306406152"), (3, "080442957X"), (4, "978-0306406157")]
    df = spark.createDataFrame(rows, "i INT, isbn STRING").repartition(3)
    got = [r["isbn"] for r in H.deduplicate_isbns(df, ("i",)).collect()]
    assert got == ["0-306-40615-2", "080442957x", "978-0306406157"]


def test_places_as_numbers(spark):
    """Order and values survive, extremes and nulls too."""
    from colophon.operators import position as P

    order = ("a", "b")
    rows = [(x, y) for x in (None, -(2**63), -1, 0, 7, 2**63 - 1) for y in (None, -(2**31), 0, 2**31 - 1)]
    df = spark.createDataFrame(rows, "a LONG, b INT").repartition(3)
    assert P.fits(df, order) and not P.fits(df.withColumn("c", F.col("a")), ("a", "b", "c"))
    numbers = df.withColumn("n", P.packed(df, order)).orderBy("n")
    assert [tuple(r) for r in numbers.select(*order).collect()] == rows
    assert [tuple(r) for r in numbers.select(*P.unpacked(df, order, "n")).collect()] == rows


def test_first_places_are_folded_by_hash(spark):
    from colophon.operators import stats as S

    df = spark.createDataFrame([(1, 2, "0306406152", "t")], "page_id LONG, k INT, isbn STRING, article_title STRING")
    for out in (H.deduplicate_isbns(df, ("page_id", "k")), S.top_failing_articles(df, ("page_id", "k"))):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    for order in (("i",), ("i", "j"), ("s", "i")):
        rows = [(k % 5, k, str(k), ("0-306-40615-2", "0306406152", "080442957x")[k % 3]) for k in range(40)]
        few = spark.createDataFrame(rows, "j INT, i LONG, s STRING, isbn STRING").repartition(4)
        got = [tuple(r) for r in H.deduplicate_isbns(few, order).select("isbn", *order).collect()]
        key = lambda r: tuple({"i": r[1], "j": r[0], "s": r[2]}[c] for c in order)
        best = {}
        for r in sorted(rows, key=key):
            best.setdefault(r[3].replace("-", "").upper(), (r[3], *key(r)))
        assert got == sorted(best.values(), key=lambda x: x[1:])


def test_urls_and_trim(spark):
    cases = ["a http://x.y/z?q=1 b", "HTTP://x", "see https://a.b/[c]", " \x1c a b\t\n ", "https://é.ü/ö z"]
    df = spark.createDataFrame([(c,) for c in cases], "t STRING")
    rows = df.select("t", C.strip_urls("t").alias("u"), C.trim_space("t").alias("s")).collect()
    for r in rows:
        assert r["u"] == plain.URL.sub(" ", r["t"])
        assert r["s"] == r["t"].strip()


def test_names_and_times(spark):
    names = [
        ("enwiki-20250101-pages-articles-multistream.xml.bz2", "en", "en", "20250101"),
        ("zh-yuewiki-20250101-pages-articles.xml.bz2", "en", "zh-yue", "20250101"),
        ("zh_yuewiki-20250101-pages.xml.bz2", "en", None, "20250101"),
        ("notes.bz2", "en", None, None),
    ]
    df = spark.createDataFrame(names, "n STRING, a STRING, b STRING, c STRING")
    for r in df.select("*", C.dump_language("n").alias("x"), C.inventory_language("n").alias("y"), C.inventory_date("n").alias("z")).collect():
        assert (r["x"], r["y"], r["z"]) == (r["a"], r["b"], r["c"])
    sizes = [(0, "0s"), (59_999_999, "59s"), (60_000_000, "1m 0s"), (3_725_000_000, "1h 2m 5s")]
    df = spark.createDataFrame(sizes, "n LONG, t STRING")
    assert df.filter(C.processing_time("n") != F.col("t")).count() == 0
    r = spark.range(1).select(
        C.fixed(F.lit(2.675), 2), C.fixed(F.lit(1234.5), 1), C.thousands(F.lit(1234567)),
        C.pass_rate(F.lit(1), F.lit(0)), C.pass_rate(F.lit(1), F.lit(3)), C.speed(F.lit(5), F.lit(0.0)),
    ).first()
    assert tuple(r) == ("2.67", "1234.5", "1,234,567", 0.0, 1 / 3 * 100, None)
