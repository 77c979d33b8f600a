"""A ledger of audited dumps that grows, for folders to which dumps are added.

Every dump is committed once, whole or not at all.  A commit takes some dumps, reads
them in one pass, and writes below its number

* ``rows``, the narrow ledger, in folders by language,
* ``rollup``, what all counts are made from, per dump, and
* ``sketches``, of the distinct ISBNs of each dump and language,

and then the ``manifest``: one small file with a row per dump, which says how large the
dump was, what state it is in and how many articles the pass saw.  Only what the manifest
names is read, so a run that dies leaves nothing behind but files that the next run
overwrites; the next run reads only dumps that are not in the manifest.

States: ``good``; ``broken``, with a malformed page; ``open``, without its end, as when it
is still being written; ``unreadable``, damaged.  Only good dumps count.  A dump whose
size or number of files has changed is read again, and its newest commit counts.

Counts, uniques and rates follow new dumps without a look at old ones: a rollup holds a
row per distinct ISBN of a dump, and folding the rollups of all good dumps gives the
rollup of the whole.  One process at a time may write to a ledger.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from colophon.functions import labels
from colophon.functions import patterns as p
from colophon.operators import hits as H
from colophon.operators import stats as S
from colophon.plans.audit import ledger_of
from colophon.sources import dumps as D
from colophon.sources.inventory import dump_names, list_files

MANIFEST = (
    "batch INT, dump_file STRING, language STRING, length LONG, files LONG, state STRING, "
    "articles LONG, seconds DOUBLE, context INT, proximity INT"
)
GOOD, BROKEN, OPEN, UNREADABLE = "good", "broken", "open", "unreadable"
#: Bytes and number of dumps of a commit; a larger dump is a commit of its own.
SHARE_BYTES = 64 << 30
MOST_DUMPS = 64
#: Size of the sketches: 2**12 registers, a standard error of 1.6 %.
SKETCH_BITS = 12


@dataclass
class Ledger:
    """The ledger in the folder ``path``; all commits must be made with the same context and proximity."""

    spark: SparkSession
    path: str
    context: int = p.DEFAULT_CONTEXT
    proximity: int = p.DEFAULT_PROXIMITY

    # -- what has been committed ---------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """All commits, a row per dump."""
        return self._table("manifest", MANIFEST)

    def dumps(self) -> DataFrame:
        """The newest commit of each dump."""
        newest = self.manifest().groupBy("dump_file").agg(F.max_by(F.struct("*"), "batch").alias("row"))
        return newest.select("row.*")

    def failed_dumps(self) -> DataFrame:
        """``(dump_file, state)`` of dumps that do not count."""
        return self.dumps().filter(F.col("state") != GOOD).select("dump_file", "state")

    def pending(self, dumps_dir: str) -> DataFrame:
        """``(dump_file, length, files)`` of the dumps of a folder that are new or have changed."""
        listed = list_files(self.spark, dumps_dir).groupBy(F.col("file_name").alias("dump_file"))
        listed = listed.agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("files"))
        # A scan shows no empty files, but they are dumps without an end.
        listed = dump_names(self.spark, dumps_dir).withColumnRenamed("file_name", "dump_file").join(listed, "dump_file", "left")
        return listed.fillna(0, ["length", "files"]).join(self.dumps().select("dump_file", "length", "files"), ["dump_file", "length", "files"], "left_anti")

    def _good(self, df: DataFrame) -> DataFrame:
        good = self.dumps().filter(F.col("state") == GOOD).select("batch", "dump_file")
        return df.join(good, ["batch", "dump_file"], "left_semi")

    def scanned(self, *languages: str) -> DataFrame:
        """Articles of good dumps with what was found in them; of some languages, only their folders are read."""
        rows = self._table("rows", f"{self._row_schema()}, batch INT")
        if languages:
            rows = rows.filter(F.col("language").isin(*languages))
        return self._good(rows.filter(F.col("kind") == "page")).drop("batch", "kind")

    def hits(self, *languages: str) -> DataFrame:
        return H.explode_found(self.scanned(*languages))

    def rollup(self) -> DataFrame:
        """The rollup of all good dumps, from those of the single dumps."""
        kept = self._good(self._table("rollup", f"dump_file STRING, {self._rollup_schema()}, batch INT"))
        return S.fold_rollups(kept)

    def totals(self) -> DataFrame:
        return S.totals(self.rollup())

    def approx_uniques(self, *keys: str) -> DataFrame:
        """Estimates of the distinct valid and invalid ISBNs of each of ``keys`` (dump_file, language), or of all.

        Sketches are united, so an ISBN of several dumps counts once.
        """
        sketches = self._good(self._table("sketches", "dump_file STRING, language STRING, valid BINARY, invalid BINARY, batch INT"))
        united = sketches.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in ("valid", "invalid")])
        return united.select(*keys, *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(f"unique_{c}") for c in ("valid", "invalid")])

    def speed(self) -> DataFrame:
        """Articles, seconds and articles per second of each commit, as the pass itself counted them."""
        sums = self.manifest().groupBy("batch").agg(F.sum("articles").alias("articles"), F.max("seconds").alias("seconds"))
        return sums.withColumn("articles_per_second", labels.speed("articles", "seconds"))

    # -- committing ----------------------------------------------------------------

    def add(self, dumps_dir: str, names: Iterable[str] | None = None, share_bytes: int = SHARE_BYTES) -> list[str]:
        """Audit the pending dumps of a folder, or those of them in ``names``; returns the names read."""
        known = self.manifest().select("context", "proximity").distinct().limit(2).collect()
        if any((r["context"], r["proximity"]) != (self.context, self.proximity) for r in known):
            raise ValueError("this ledger was made with another context or proximity")
        waiting = sorted(self.pending(dumps_dir).collect(), key=lambda r: r["dump_file"])
        if names is not None:
            chosen = set(names)
            waiting = [r for r in waiting if r["dump_file"] in chosen]
        for share in _shares(waiting, share_bytes):
            self._commit(dumps_dir, share)
        return [r["dump_file"] for r in waiting]

    def _commit(self, dumps_dir: str, share: list[Row]) -> None:
        begun = time.monotonic()
        number = (self.manifest().agg(F.max("batch")).first()[0] or 0) + 1
        rows_path = f"{self.path}/rows/batch={number}"
        names = [r["dump_file"] for r in share]
        lost: list[str] = []
        articles: dict[str, int] = {}
        while len(lost) < len(names):
            left = [n for n in names if n not in lost]
            pages = D.parse_pages(D.read_records(self.spark, dumps_dir, only=tuple(left)), "drop_dump")
            counted, seen = _observed(ledger_of(pages, self.context, self.proximity), left)
            try:
                counted.write.mode("overwrite").partitionBy("language").parquet(rows_path)
                articles = seen()
                break
            except (PySparkException, Py4JJavaError) as error:
                # The dump is left out and the others of this commit are read again.
                name = D.unreadable_dump(error)
                if name is None or name not in left:
                    raise
                lost.append(name)
        states = {n: UNREADABLE for n in lost}
        if len(lost) < len(names):
            rows = self.spark.read.schema(self._row_schema()).parquet(rows_path)
            for r in D.dump_states(rows).collect():
                states[r["dump_file"]] = BROKEN if r["broken"] else GOOD if r["ended"] else OPEN
            self._fold(rows, number)
        seconds = time.monotonic() - begun
        lines = [
            (number, r["dump_file"], None, r["length"], r["files"], states.get(r["dump_file"], OPEN), articles.get(r["dump_file"], 0), seconds, self.context, self.proximity)
            for r in share
        ]
        manifest = self.spark.createDataFrame(lines, MANIFEST).withColumn("language", labels.dump_language("dump_file"))
        # One file: it is there or it is not.
        manifest.drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")

    def _fold(self, rows: DataFrame, number: int) -> None:
        folded = f"{self.path}/rollup/batch={number}"
        S.rollup_articles(rows.filter(F.col("kind") == "page"), "dump_file").write.mode("overwrite").parquet(folded)
        rollup = self.spark.read.schema(f"dump_file STRING, {self._rollup_schema()}").parquet(folded)
        form = F.col("unique_form")
        sketches = rollup.groupBy("dump_file", "language").agg(
            F.hll_sketch_agg(F.when(F.col("is_valid"), form), F.lit(SKETCH_BITS)).alias("valid"),
            F.hll_sketch_agg(F.when(~F.col("is_valid"), form), F.lit(SKETCH_BITS)).alias("invalid"),
        )
        sketches.write.mode("overwrite").parquet(f"{self.path}/sketches/batch={number}")

    def _row_schema(self) -> str:
        nothing = self.spark.createDataFrame([], "dump_file STRING, part STRING, row_id LONG, value STRING")
        return _ddl(ledger_of(D.parse_pages(nothing, "drop_dump"), self.context, self.proximity))

    def _rollup_schema(self) -> str:
        return "language STRING, format STRING, is_valid BOOLEAN, unique_form STRING, hits LONG, articles LONG, articles_with_isbn LONG"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _shares(waiting: list[Row], share_bytes: int) -> Iterator[list[Row]]:
    share: list[Row] = []
    size = 0
    for row in waiting:
        if share and (size + row["length"] > share_bytes or len(share) == MOST_DUMPS):
            yield share
            share, size = [], 0
        share.append(row)
        size += row["length"]
    if share:
        yield share


def _observed(ledger: DataFrame, names: list[str]):  # noqa: ANN202
    """``ledger`` that counts the articles of each dump as it is written, and a function for the counts."""
    metrics = Observation()
    article = F.col("kind") == "page"
    counts = [F.count_if(article & (F.col("dump_file") == n)).alias(f"n{k}") for k, n in enumerate(names)]
    return ledger.observe(metrics, *counts), lambda: {n: metrics.get[f"n{k}"] for k, n in enumerate(names)}
