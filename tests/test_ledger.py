"""The growing ledger: whole dumps, resumed runs, totals from partial counts."""

import bz2
import shutil

import pytest
from pyspark.sql import functions as F

from colophon.operators import structure as X
from colophon.plans import ledger as L
from colophon.plans.audit import run_audit
from colophon.streaming.incremental import follow_dumps
from tests import tiny


def name(lang, date="20250101"):
    return f"{lang}wiki-{date}-pages-articles-multistream.xml.bz2"


def pages(*isbns):
    return [tiny.page(f"T{k}", f"see ISBN {isbn} here") for k, isbn in enumerate(isbns)] + [tiny.page("empty of numbers", "nothing")]


@pytest.fixture
def folder(tmp_path):
    dumps = tmp_path / "dumps"
    dumps.mkdir()
    tiny.write(dumps / name("en"), pages("0306406152", "0306406153", "0306406152"))
    tiny.write(dumps / name("de"), pages("0306406152", "9780306406157"))
    return dumps


@pytest.fixture
def store(spark, tmp_path):
    return L.Ledger(spark, str(tmp_path / "ledger"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


HIT = ("language", "title", "k", "isbn", "context", "is_valid")


def same_as_batch(spark, store, folder):
    run = run_audit(spark, str(folder), on_error="drop_dump")
    assert store.totals().first().asDict() == run.totals
    assert rows(store.hits(), *HIT) == rows(run.hits(), *HIT)
    assert sorted(r["dump_file"] for r in store.failed_dumps().collect()) == run.failed_dumps


def test_nothing_committed(spark, store):
    assert store.manifest().count() == 0 and store.scanned().count() == 0
    assert store.totals().first()["articles_processed"] == 0


def test_a_rerun_reads_only_what_is_not_in_the_manifest(spark, store, folder):
    assert store.add(str(folder)) == [name("de"), name("en")]
    same_as_batch(spark, store, folder)
    assert store.add(str(folder)) == []

    before = rows(store.hits(), *HIT)
    shutil.move(folder / name("en"), folder.parent / "gone")  # cannot be read again
    tiny.write(folder / name("fr"), pages("0306406153"))
    assert store.add(str(folder)) == [name("fr")]
    assert rows(store.hits("en", "de"), *HIT) == before
    assert [r[0] for r in store.manifest().groupBy("dump_file").count().select("count").collect()] == [1, 1, 1]
    shutil.move(folder.parent / "gone", folder / name("en"))
    same_as_batch(spark, store, folder)


@pytest.mark.parametrize("step", ["rows", "rollup", "manifest"])
def test_a_run_that_dies_leaves_nothing(spark, store, folder, monkeypatch, step):
    store.add(str(folder), [name("de")])
    seen = rows(store.hits(), *HIT)

    def dies(*_args, **_kwargs):
        raise RuntimeError("lost")

    where = {"rows": (L.Ledger, "_fold"), "rollup": (L.S, "fold_rollups"), "manifest": (L.labels, "dump_language")}[step]
    with monkeypatch.context() as patch:
        if step == "manifest":
            folded = L.Ledger._fold
            patch.setattr(L.Ledger, "_fold", lambda *a: (folded(*a), dies()))
        elif step == "rollup":
            patch.setattr(L.F, "hll_sketch_agg", dies)
        else:
            patch.setattr(*where, dies)
        with pytest.raises(RuntimeError):
            store.add(str(folder))
    assert rows(store.hits(), *HIT) == seen and store.manifest().count() == 1
    again = L.Ledger(spark, store.path)
    assert again.add(str(folder)) == [name("en")]
    same_as_batch(spark, again, folder)


def test_bad_dumps_cost_themselves(spark, store, folder):
    tiny.write(folder / name("fr"), [tiny.page("A", "ISBN 0306406152", extra="</oops>"), tiny.page("B", "ISBN 0306406152")])
    tiny.write(folder / name("it"), pages("0306406152"), closed=False)
    whole = tiny.write(folder / name("es"), pages("0306406152") * 30).read_bytes()
    (folder / name("es")).write_bytes(whole[: len(whole) // 2])
    (folder / name("pt")).write_bytes(b"")
    (folder / name("sv")).write_bytes(bz2.compress(b"no dump at all"))
    assert len(store.add(str(folder))) == 7
    states = {r["dump_file"][:2]: r["state"] for r in store.dumps().collect()}
    assert states == {"en": "good", "de": "good", "fr": "broken", "it": "open", "es": "unreadable", "pt": "open", "sv": "open"}
    same_as_batch(spark, store, folder)

    # A dump that is complete at last counts from then on.
    tiny.write(folder / name("it"), pages("0306406152"))
    assert store.add(str(folder)) == [name("it")]
    same_as_batch(spark, store, folder)


def test_a_dump_that_turns_bad_no_longer_counts(spark, store, folder):
    store.add(str(folder))
    tiny.write(folder / name("en"), pages("0306406152"), closed=False)
    store.add(str(folder))
    assert [r["state"] for r in store.failed_dumps().collect()] == ["open"]
    same_as_batch(spark, store, folder)


def test_commits_are_of_bounded_size(spark, store, folder):
    store.add(str(folder), share_bytes=1)
    assert store.manifest().select("batch").distinct().count() == 2
    same_as_batch(spark, store, folder)


def test_articles_are_counted_in_the_same_pass(spark, store, folder):
    store.add(str(folder), share_bytes=1)
    got = {r["dump_file"][:2]: r["articles"] for r in store.dumps().collect()}
    assert got == {"en": 4, "de": 3}
    speed = store.speed().collect()
    assert sorted(r["articles"] for r in speed) == [3, 4]
    assert all(abs(r["articles_per_second"] - r["articles"] / r["seconds"]) < 1e-6 for r in speed)


def test_sketches_are_united(spark, store, folder):
    tiny.write(folder / name("fr"), [tiny.page(f"T{k}", f"ISBN {k:09d}X") for k in range(600)])
    store.add(str(folder), share_bytes=1)
    exact = store.totals().first()
    found = store.approx_uniques().first()
    assert abs(found["unique_valid"] - exact["unique_valid"]) <= 1 + 0.05 * exact["unique_valid"]
    assert abs(found["unique_invalid"] - exact["unique_invalid"]) <= 1 + 0.05 * exact["unique_invalid"]
    by_language = {r["language"]: r["unique_valid"] for r in store.approx_uniques("language").collect()}
    assert by_language["en"] == 1 and by_language["de"] == 2


def test_a_language_is_read_from_its_folder(spark, store, folder):
    store.add(str(folder))
    kept = store.hits("de")
    assert {r["language"] for r in kept.collect()} == {"de"}
    plan = kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in plan.splitlines() if line.startswith("PartitionFilters")]
    assert any("language" in line and "de" in line for line in filters)


def test_another_context_is_refused(spark, store, folder):
    store.add(str(folder))
    with pytest.raises(ValueError):
        L.Ledger(spark, store.path, context=7).add(str(folder))


def test_a_stream_takes_whole_dumps_only(spark, store, folder, tmp_path):
    def run():
        follow_dumps(spark, str(folder), store, str(tmp_path / "state"), files_per_batch=1).awaitTermination()

    run()
    same_as_batch(spark, store, folder)
    assert store.manifest().select("batch").distinct().count() == 2

    tiny.write(folder / name("fr"), pages("0306406153"), closed=False)
    tiny.write(folder / name("it"), pages("0306406153"))
    run()
    same_as_batch(spark, store, folder)
    assert [r["state"] for r in store.failed_dumps().collect()] == ["open"]

    # The end of an open dump is seen when anything arrives.
    tiny.write(folder / name("fr"), pages("0306406153"))
    tiny.write(folder / name("sv"), pages("0306406153"))
    run()
    same_as_batch(spark, store, folder)
    assert store.failed_dumps().isEmpty()


def test_a_dump_in_parts_counts_when_all_parts_are_there(spark, store, folder, tmp_path):
    dumps = tmp_path / "parted"
    own = dumps / f"dump={name('en')}"
    own.mkdir(parents=True)
    whole = bz2.decompress((folder / name("en")).read_bytes())
    cut = whole.index(b"</page>") + 7
    (own / "part-0.bz2").write_bytes(bz2.compress(whole[:cut]))
    follow_dumps(spark, str(dumps), store, str(tmp_path / "state")).awaitTermination()
    assert store.scanned().count() == 0
    (own / "part-1.bz2").write_bytes(bz2.compress(whole[cut:]))
    follow_dumps(spark, str(dumps), store, str(tmp_path / "state")).awaitTermination()
    assert store.scanned().count() == 4
    assert store.scanned().agg(F.countDistinct("dump_file")).first()[0] == 1


def test_elements_of_many_dumps(spark):
    """More dumps than bits of a word."""
    rows = [(f"d{k:03d}", f"<a><{'b' if k % 2 else 'c'}/><x{k // 50}/></a>") for k in range(140)]
    matrix = X.structure_matrix(spark.createDataFrame([*rows, *rows], "dump string, xml string"), "xml", "dump")
    got = {r["element"]: r["dumps"] for r in X.dumps_of(matrix).collect()}
    want = {"a": [d for d, _ in rows]}
    for d, xml in rows:
        for name in ("b", "c", "x0", "x1", "x2"):
            if f"<{name}/>" in xml:
                want.setdefault(name, []).append(d)
    assert got == want
    sides = {r["element"]: r["side"] for r in X.compare_by_matrix(matrix, "d001", "d130").collect()}
    assert sides == {"a": "common", "b": "only_in_first", "x0": "only_in_first", "c": "only_in_second", "x2": "only_in_second"}
    assert X.compare_by_matrix(matrix, "d001", "gone").where("side <> 'only_in_first'").isEmpty()


def test_a_prolog_of_many_declarations(spark):
    head = "<!a>" * 50_000 + '<mediawiki xmlns="http://n/">'
    df = spark.createDataFrame([("one", head), ("two", "<!a>" * 50_000)], "file_name string, head string")
    assert {r["file_name"]: r["namespace"] for r in X.dump_namespaces(df).collect()} == {"one": "http://n/", "two": None}
