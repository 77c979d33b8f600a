from colophon.operators import listing as L
from colophon.plans.fetch_list import fetch_list


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_language_codes(spark):
    html = (
        "//en.wikipedia.org de.wikipedia.org en.wikipedia.org zh-min-nan.wikipedia.org www.wikipedia.org "
        "meta.wikipedia.org species.wikipedia.org wikidata.wikipedia.org EN.wikipedia.org simple.wikipedia.org xwikipediaxorg"
    )
    codes = L.language_codes(frame(spark, "html STRING", (html,), ("fr.wikipedia.org",)))
    assert [r[0] for r in codes.collect()] == ["de", "en", "fr", "simple", "zh-min-nan"]


def test_missing_and_listing(spark):
    wanted = frame(spark, "language STRING", *[(f"l{i:02d}",) for i in range(30)])
    present = frame(spark, "language STRING", ("l00",), ("l05",), ("other",))
    missing = L.missing_languages(wanted, present)
    assert missing.count() == 28
    assert [r[0] for r in L.plan_listing(missing).collect()] == [f"l{i:02d}" for i in range(30) if i not in (0, 5)][:20]


def file_of(lang, date):
    return f"{lang}wiki-{date}-pages-articles-multistream.xml.bz2"


def latest(spark, dates, pages):
    index = frame(spark, "language STRING, html STRING", ("en", " ".join(f'<a href="{d}/">' for d in dates)))
    rows = [("en", d, h) for d, h in pages.items()]
    return [(r["date"], r["url"]) for r in L.latest_dump(L.dump_dates(index), frame(spark, "language STRING, date STRING, html STRING", *rows)).collect()]


def test_newest_usable_dump(spark):
    dates = ["20250101", "20250301", "20250201", "latest"]
    done = {d: file_of("en", d) for d in dates[:3]}
    url = "https://dumps.wikimedia.org/enwiki/20250301/" + file_of("en", "20250301")
    assert latest(spark, dates, done) == [("20250301", url)]
    # The newest is skipped while it is written, an older one is not.
    busy = {d: h + " In-Progress" for d, h in done.items()}
    assert [d for d, _ in latest(spark, dates, busy)] == ["20250201"]
    # A page that lists another file does not count, nor does an absent page.
    other = {**done, "20250301": file_of("de", "20250301")}
    assert [d for d, _ in latest(spark, dates, other)] == ["20250201"]
    assert [d for d, _ in latest(spark, dates, {"20250101": done["20250101"]})] == ["20250101"]
    assert latest(spark, ["x"], done) == []


def test_only_the_five_newest_links_are_tried(spark):
    dates = [f"2025010{i}" for i in range(1, 8)]
    assert latest(spark, dates, {"20250102": file_of("en", "20250102")}) == []
    assert [d for d, _ in latest(spark, dates, {"20250103": file_of("en", "20250103")})] == ["20250103"]
    # A date linked twice takes two of the five places.
    assert latest(spark, [*dates, "20250107"], {"20250103": file_of("en", "20250103")}) == []


def test_fetch_list(spark):
    languages = frame(spark, "html STRING", ("en.wikipedia.org de.wikipedia.org fr.wikipedia.org",))
    inventory = frame(spark, "language STRING, path STRING", ("de", "x"))
    index = frame(spark, "language STRING, html STRING", ("en", 'href="20250101/"'), ("de", 'href="20250101/"'))
    pages = frame(spark, "language STRING, date STRING, html STRING", ("en", "20250101", file_of("en", "20250101")))
    rows = fetch_list(languages, inventory, index, pages).collect()
    assert [(r["language"], r["date"]) for r in rows] == [("en", "20250101"), ("fr", None)]
