import pytest

from colophon.operators.hits import find_isbns
from colophon.sources import dumps as D
from colophon.streaming.incremental import append_new_hits, read_article_counts, stream_articles, update_article_counts
from tests import tiny


def names(lang, date="20250101"):
    return f"{lang}wiki-{date}-pages-articles-multistream.xml.bz2"


def test_each_dump_is_processed_once(spark, tmp_path):
    dumps, out, state = (tmp_path / n for n in ("dumps", "out", "state"))
    counts, count_state = tmp_path / "counts", tmp_path / "count_state"
    dumps.mkdir()

    def run():
        append_new_hits(spark, str(dumps), str(out), str(state), files_per_batch=1).awaitTermination()
        update_article_counts(spark, str(dumps), str(counts), str(count_state), files_per_batch=1).awaitTermination()
        hits = spark.read.parquet(str(out)).select("language", "title", "k", "isbn", "context", "is_valid")
        sums = {r["language"]: r["articles_processed"] for r in read_article_counts(spark, str(counts)).collect()}
        return sorted(map(tuple, hits.collect())), sums

    def batch():
        rows = find_isbns(D.read_articles(spark, str(dumps)))
        return sorted(map(tuple, rows.select("language", "title", "k", "isbn", "context", "is_valid").collect()))

    tiny.write(dumps / names("en"), [tiny.page("A", "ISBN 0306406152, ISBN 0306406153"), tiny.page("B", "x")])
    hits, sums = run()
    assert hits == batch() and len(hits) == 2 and sums == {"en": 2}

    assert run() == (hits, sums)

    tiny.write(dumps / names("de"), [tiny.page("C", "ISBN 0306406152")])
    tiny.write(dumps / names("en", "20250201"), [tiny.page("D", "ISBN 0306406152")])
    hits, sums = run()
    assert hits == batch() and len(hits) == 4 and sums == {"en": 3, "de": 1}


def test_a_stream_cannot_drop_dumps(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_articles(spark, str(tmp_path), "drop_dump")
