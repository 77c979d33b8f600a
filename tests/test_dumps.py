import bz2
import random

import pytest
from pyspark.sql import functions as F

from colophon import DumpError, run_audit
from colophon.operators import structure as X
from colophon.operators.listing import inventory_sizing
from colophon.operators.stats import articles_processed
from colophon.sources import dumps as D
from colophon.sources.failed_csv import read_failed_csv
from colophon.sources.inventory import read_heads, read_inventory
from colophon.sources.reports import pass_rates, read_reports
from tests import plain, tiny

EN = "enwiki-20250101-pages-articles-multistream.xml.bz2"
DE = "dewiki-20210101-pages-articles-multistream.xml.bz2"
YUE = "zh-yuewiki-20250101-pages-articles-multistream.xml.bz2"
GOOD, BAD = "ISBN 0306406152", "ISBN 0306406153"


@pytest.fixture
def folder(tmp_path):
    tiny.write(
        tmp_path / EN,
        [
            tiny.page("Plain page", f"  {GOOD} and\n ISBN 9780306406158 é😀"),
            tiny.page("Talk", GOOD, ns="1"),
            tiny.page("Ten", GOOD, ns="10"),
            tiny.page("Moved", GOOD, redirect=True),
            tiny.page("Empty", raw_text="<text />"),
            tiny.page("Empty too", raw_text='<text xml:space="preserve"></text>'),
            tiny.page("Blank", "   \n "),
            tiny.page("Two", f"first {GOOD}", revisions=(f"second {BAD}",)),
            tiny.page("Markup & <b>", "<ref>x &amp; y</ref> {{cite|isbn=0306406152}}"),
            tiny.page("No text", raw_text=""),
            tiny.page(""),
        ],
        "0.11",
    )
    tiny.write(tmp_path / DE, [tiny.page("Seite Eins", f"{BAD}, {BAD} und {GOOD}"), tiny.page("Ohne", "nichts")], "0.10")
    tiny.write(tmp_path / YUE, [tiny.page("粵", "冇")], namespace=False)
    (tmp_path / "notes.txt").write_text("<page>no dump</page>")
    return tmp_path


def test_articles_of_tiny_dumps(spark, folder):
    for mode in D.ON_ERROR:
        rows = D.read_articles(spark, str(folder), mode).orderBy(*D.POSITION).collect()
        assert [(r["dump_file"], r["language"], r["title"]) for r in rows] == [
            (DE, "de", "Seite Eins"), (DE, "de", "Ohne"),
            (EN, "en", "Plain page"), (EN, "en", "Blank"), (EN, "en", "Two"), (EN, "en", "Markup & <b>"),
            (YUE, "en", "粵"),
        ]
        texts = {r["title"]: r["text"] for r in rows}
        assert texts["Plain page"] == f"  {GOOD} and\n ISBN 9780306406158 é😀"
        assert texts["Blank"] == "   \n "
        assert texts["Two"] == f"first {GOOD}"
        assert texts["Markup & <b>"] == "<ref>x &amp; y</ref> {{cite|isbn=0306406152}}"
        assert rows[0]["url"] == "https://de.wikipedia.org/wiki/Seite_Eins"


def test_one_file_is_shared_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    n = 3000
    texts = [f"{GOOD} é😀 " + "".join(rng.choice("abc </page é") for _ in range(rng.randint(0, 900))) for _ in range(n)]
    path = tmp_path / EN
    tiny.write(path, [tiny.page(f"P{i}", t) for i, t in enumerate(texts)], per_stream=50, level=1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        assert D.read_records(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        articles = D.read_articles(spark, str(tmp_path))
        rows = articles.orderBy(*D.POSITION).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["title"] for r in rows] == [f"P{i}" for i in range(n)]
    assert [r["text"] for r in rows] == texts


def broken_folder(tmp_path):
    tiny.write(tmp_path / EN, [tiny.page("Fine", GOOD)])
    tiny.write(tmp_path / DE, [tiny.page("Gut", GOOD), tiny.page("Kaputt", "x").replace("</revision>", ""), tiny.page("Auch gut", BAD)])
    return str(tmp_path)


def test_malformed_page(spark, tmp_path):
    path = broken_folder(tmp_path)
    with pytest.raises(Exception, match="(?i)malformed"):
        D.read_articles(spark, path, "fail").collect()
    titles = lambda mode: {r["title"] for r in D.read_articles(spark, path, mode).collect()}
    assert titles("skip_page") == {"Fine", "Gut", "Auch gut"}
    assert titles("drop_dump") == {"Fine"}
    run = run_audit(spark, path, on_error="drop_dump")
    assert run.failed_dumps == [DE]
    assert run.totals["articles_processed"] == 1 and run.totals["total"] == 1
    run = run_audit(spark, path, on_error="skip_page")
    assert run.totals["articles_processed"] == 3 and run.totals["total"] == 3
    with pytest.raises(ValueError):
        D.read_articles(spark, path, "other")


def test_dump_without_end(spark, tmp_path):
    tiny.write(tmp_path / EN, [tiny.page("Fine", GOOD)])
    tiny.write(tmp_path / DE, [tiny.page("Gut", GOOD)], closed=False)
    with pytest.raises(DumpError, match="dewiki"):
        run_audit(spark, str(tmp_path))
    assert run_audit(spark, str(tmp_path), on_error="drop_dump").failed_dumps == [DE]


def test_truncated_file(spark, tmp_path):
    tiny.write(tmp_path / EN, [tiny.page("Fine", GOOD)])
    path = tiny.write(tmp_path / DE, [tiny.page(f"Gut {i}", GOOD * i) for i in range(40)])
    path.write_bytes(path.read_bytes()[:-200])
    run = run_audit(spark, str(tmp_path), on_error="drop_dump")
    assert run.failed_dumps == [DE]
    assert run.totals["articles_processed"] == 1


def damage(path, at: float = 0.5):
    """Change some bytes in the middle of a file."""
    data = bytearray(path.read_bytes())
    middle = int(len(data) * at)
    data[middle : middle + 400] = bytes(255 - x for x in data[middle : middle + 400])
    path.write_bytes(bytes(data))


def test_damage_inside_a_file_of_many_splits(spark, tmp_path):
    """Splits after the damage are fine and hold the end; the dump is dropped whole all the same."""
    rng = random.Random(4)
    texts = [GOOD + " " + "".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(600)]
    tiny.write(tmp_path / EN, [tiny.page("Fine", GOOD)])
    damage(tiny.write(tmp_path / DE, [tiny.page(f"P{i}", t) for i, t in enumerate(texts)], per_stream=20, level=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        run = run_audit(spark, str(tmp_path), on_error="drop_dump")
        assert run.failed_dumps == [DE] and run.totals["articles_processed"] == 1
        assert [r["title"] for r in D.read_articles(spark, str(tmp_path), "drop_dump").collect()] == ["Fine"]
        for mode in ("fail", "skip_page"):
            with pytest.raises(Exception, match="FAILED_READ_FILE"):
                D.read_articles(spark, str(tmp_path), mode).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("content", [b"", b"no bzip2 at all" * 50, bz2.compress(b"<mediawiki><siteinfo></siteinfo>"), bz2.compress(b"")])
def test_dumps_without_records(spark, tmp_path, content):
    tiny.write(tmp_path / EN, [tiny.page("Fine", GOOD)])
    (tmp_path / DE).write_bytes(content)
    run = run_audit(spark, str(tmp_path), on_error="drop_dump")
    assert run.failed_dumps == [DE] and run.totals["articles_processed"] == 1
    with pytest.raises(Exception, match="dewiki"):
        run_audit(spark, str(tmp_path))
    with pytest.raises(Exception, match="dewiki"):
        D.read_articles(spark, str(tmp_path))


def test_shares_give_the_same(spark, folder):
    narrow = lambda pages: pages.select("dump_file", "kind", "title")
    one, _ = D.store_pages(spark, str(folder), "drop_dump", narrow, "one")
    many, lost = D.store_pages(spark, str(folder), "drop_dump", narrow, "many", share_bytes=300)
    assert lost == [] and sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)


def test_folders_below_are_not_read(spark, folder, tmp_path):
    (folder / "old").mkdir()
    tiny.write(folder / "old" / "frwiki-20250101-pages-articles-multistream.xml.bz2", [tiny.page("A", GOOD)])
    run = run_audit(spark, str(folder), str(tmp_path / "report-of-it"))
    report = "".join(r["content"] for r in read_reports(spark, run.report_path).collect())
    assert "Wikis Processed: 3" in report and "frwiki" not in report and run.totals["articles_processed"] == 7


def test_report_with_line_ends_of_another_system(spark, folder, tmp_path):
    run = run_audit(spark, str(folder), str(tmp_path / "report-of-it"))
    text = "".join(r["content"] for r in read_reports(spark, run.report_path).collect())
    (tmp_path / "crlf.txt").write_bytes(text.replace("\n", "\r\n").encode())
    rates = pass_rates(read_reports(spark, str(tmp_path / "crlf.txt"))).collect()
    assert sorted((r["wiki"], r["pass_rate"]) for r in rates) == [("DE", 33.33), ("EN", 75.0)]


def test_first_revision_alone_says_what_is_blank(spark, tmp_path):
    page = tiny.page("Two", raw_text="<text></text>").replace("</revision>", "</revision><revision><text xml:space=\"preserve\">  </text></revision>")
    tiny.write(tmp_path / EN, [page, tiny.page("Fine", GOOD)])
    assert [r["title"] for r in D.read_articles(spark, str(tmp_path)).collect()] == ["Fine"]


def test_heads_of_an_index_and_of_a_dump_in_parts(spark, tmp_path):
    index = tmp_path / "enwiki-20250101-pages-articles-multistream-index.txt.bz2"
    index.write_bytes(bz2.compress(b"616:1:A\n" * 500_000))
    parts = tmp_path / f"dump={DE}"
    parts.mkdir()
    (parts / "part-00000.bz2").write_bytes(bz2.compress(b"<mediawiki xmlns=\"http://x/\"><page></page>"))
    (parts / "part-00001.bz2").write_bytes(b"not opened")
    heads = {r["file_name"]: r["head"] for r in read_heads(spark, str(tmp_path)).collect() if r["file_name"]}
    assert heads[DE].startswith("<mediawiki")


def test_head_reader_is_shipped_by_value():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from colophon.sources.inventory import head_reader

    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); print(list(f(iter([]))), 'colophon' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(head_reader(5)), capture_output=True, cwd="/")
    assert out.stdout.split() == [b"[]", b"False"], out.stderr


def test_unclosed_page_before_another(spark, tmp_path):
    pages = [tiny.page("Open", GOOD).replace("  </page>\n", ""), tiny.page("Fine", GOOD)]
    tiny.write(tmp_path / EN, pages)
    assert run_audit(spark, str(tmp_path), on_error="drop_dump").failed_dumps == [EN]


def test_audit_outputs(spark, folder, tmp_path):
    out = tmp_path / "out"
    run = run_audit(spark, str(folder), str(out))
    assert run.failed_dumps == []
    assert run.totals["articles_processed"] == 7
    assert run.totals["articles_with_isbn"] == 4
    assert (run.totals["valid"], run.totals["invalid"]) == (4, 3)
    assert (run.totals["unique_valid"], run.totals["unique_invalid"]) == (1, 2)

    report = "\n".join(p.read_text() for p in (out / "report").glob("part-*"))
    lines = report.splitlines()
    assert lines[0] == "Wikipedia ISBN Extraction Report"
    assert lines[1] == "=" * 60
    assert "Wikis Processed: 3" in lines
    assert [x for x in lines if x.startswith("  - ")] == [f"  - {n}" for n in (DE, EN, YUE)]
    assert "  Total ISBNs found: 7" in lines
    assert "  Pass rate: 57.14%" in lines
    at = lines.index("Language Breakdown:")
    assert lines[at + 1 : at + 11] == [
        "", "  DE:", "    Total articles processed: 2", "    Articles with ISBNs: 1", "    Total ISBNs: 3",
        "    Valid ISBNs: 1", "    Invalid ISBNs: 2", "    Pass rate: 33.33%", "    Unique valid: 1", "    Unique invalid: 1",
    ]
    rates = pass_rates(read_reports(spark, run.report_path)).collect()
    assert sorted((r["wiki"], r["pass_rate"]) for r in rates) == [("DE", 33.33), ("EN", 75.0)]

    failed = read_failed_csv(spark, run.csv_path).orderBy("file", "row_id").collect()
    assert [(r["article_title"], r["language"], r["isbn"], r["format"]) for r in failed] == [
        ("Seite Eins", "de", "0306406153", "ISBN-10"), ("Seite Eins", "de", "0306406153", "ISBN-10"),
        ("Plain page", "en", "9780306406158", "ISBN-13"),
    ]
    assert failed[2]["context"] == plain.find(f"  {GOOD} and\n ISBN 9780306406158 é😀")[1][1]
    assert run.hits().count() == 7 and run.results().count() == 4


def test_nothing_found_writes_nothing(spark, tmp_path):
    tiny.write(tmp_path / EN, [tiny.page("A", "no number"), tiny.page("B", "isbn")])
    out = tmp_path / "out"
    run = run_audit(spark, str(tmp_path), str(out))
    assert run.totals["articles_processed"] == 2 and run.totals["pass_rate"] == 0.0
    assert run.report_path is None and run.csv_path is None and not out.exists()


def test_no_failures_no_csv_and_one_language_no_breakdown(spark, tmp_path):
    tiny.write(tmp_path / EN, [tiny.page("A", GOOD)])
    run = run_audit(spark, str(tmp_path), str(tmp_path / "out"))
    assert run.csv_path is None
    assert pass_rates(read_reports(spark, run.report_path)).count() == 0


def test_counts_per_dump(spark, folder):
    counts = articles_processed(D.read_articles(spark, str(folder)), "dump_file", "language")
    assert {(r["dump_file"], r["articles_processed"]) for r in counts.collect()} == {(DE, 2), (EN, 4), (YUE, 1)}


def test_namespaces(spark, folder, tmp_path):
    quoted = tmp_path / "frwiki-20250101-pages-articles.xml.bz2"
    quoted.write_bytes(bz2.compress(b"<mediawiki xmlns='http://x/'><page></page></mediawiki>"))
    rows = X.dump_namespaces(read_heads(spark, str(folder))).collect()
    assert {r["file_name"]: r["namespace"] for r in rows} == {
        EN: "http://www.mediawiki.org/xml/export-0.11/",
        DE: "http://www.mediawiki.org/xml/export-0.10/",
        YUE: None,
        quoted.name: None,
    }


def test_namespaces_of_two_dumps(spark, folder):
    heads = read_heads(spark, str(folder))
    of = lambda name: heads.filter(F.col("file_name") == name)
    assert X.compare_namespaces(of(EN), of(DE)).first()["same"] is False
    assert tuple(X.compare_namespaces(of(YUE), of(YUE)).first()) == (None, None, True)


def test_namespace_behind_a_long_start_tag(spark):
    head = "<?xml version='1.0'?>\n<mediawiki " + "a='b' " * 2000 + 'xmlns="http://x/" >' + '<p xmlns="http://y/">'
    assert spark.createDataFrame([(head,)], "head string").select(X.xml_namespace("head")).first()[0] == "http://x/"


def test_csv_files_of_differing_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"article_title","language","isbn","format"\n"S","de","2","ISBN-13"\n')
    (tmp_path / "b.csv").write_text('"isbn","article_title","format","language"\n"2","S","ISBN-13","de"\n')
    with pytest.raises(Exception, match="(?i)header"):
        read_failed_csv(spark, str(tmp_path)).collect()
    assert read_failed_csv(spark, str(tmp_path / "b.csv")).first()["article_title"] == "S"


def test_structures_of_heads_and_of_whole_dumps(spark, tmp_path):
    tiny.write(tmp_path / EN, [tiny.page(f"P{i}") for i in range(5)] + [tiny.page("late", redirect=True)], per_stream=3)
    tiny.write(tmp_path / DE, [tiny.page("P", extra="<discussion />")])

    def sides(rows):
        return {r["element"]: r["side"] for r in rows.collect()}

    heads = read_heads(spark, str(tmp_path))
    one, two = heads.filter(F.col("file_name") == EN), heads.filter(F.col("file_name") == DE)
    few = sides(X.compare_dump_structures(one, two))
    assert few["discussion"] == "only_in_second" and "redirect" not in few
    assert all(few[e] == "common" for e in ("mediawiki", "siteinfo", "namespace", "page", "title", "text", "contributor"))
    records = D.read_records(spark, str(tmp_path))
    whole = sides(X.compare_dump_structures(
        records.filter(F.col("dump_file") == EN), records.filter(F.col("dump_file") == DE), "value"))
    assert whole == {**few, "redirect": "only_in_first"}


def test_inventory(spark, folder):
    rows = read_inventory(spark, str(folder))
    assert {(r["language"], r["dump_date"]) for r in rows.collect()} == {
        ("en", "20250101"), ("de", "20210101"), ("zh-yue", "20250101")}
    sizes = {r["language"]: r["bytes"] for r in inventory_sizing(rows).collect()}
    assert sizes["en"] == (folder / EN).stat().st_size
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_each_page_is_parsed_and_searched_once(spark, folder):
    from colophon.plans.audit import ledger_of

    for mode in D.ON_ERROR:
        pages = D.parse_pages(D.read_records(spark, str(folder)), mode)
        for df in (pages, D.keep_articles(pages), ledger_of(pages)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("from_xml(") == 1, plan
        assert plan.count("regexp_extract_all") == 1
        assert "Exchange" not in plan


def test_written_dumps_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """Few long pages behind many short ones are shared out among the parts; NULL and repeated keys stay."""
    from workload import fixtures

    monkeypatch.setattr(fixtures, "LEAST_PART", 1 << 20, raising=False)
    short = "SELECT nullif(id, 7) AS page_id, 'short' AS text FROM range(1, 2001) UNION ALL SELECT 9, 'again'"
    long = "SELECT 100000 + id, concat_ws(' ', transform(sequence(1, 12000), i -> hex(i * (id + 31)))) FROM range(60)"
    pages = spark.sql(f"SELECT language, page_id, coalesce(page_id, 0) AS title, text FROM ({short} UNION ALL {long}) CROSS JOIN VALUES ('de'), ('en') l(language)")
    fixtures.write_dumps(pages, str(tmp_path / "out"))
    parts: dict[str, list[str]] = {}
    for file in sorted((tmp_path / "out").glob("dump=*/*.bz2"), key=lambda f: (f.parent, f.name)):
        parts.setdefault(file.parent.name, []).append(bz2.decompress(file.read_bytes()).decode())
    assert len(parts) == 2
    sizes = [len(part) for dump in parts.values() for part in dump]
    assert max(sizes) < 0.3 * sum(sizes)
    for dump in parts.values():
        whole = "".join(dump)
        assert whole.count("<page>") == 2061 and whole.startswith("<mediawiki") and whole.endswith("</mediawiki>\n")
        assert dump[0].count("<page>") >= 5 and whole.index("<title>9<") < whole.index("<title>10<") < whole.index("<title>100000<")
