"""Articles with ISBNs, derived from the given tables.

The tables hold no ISBN text, so it is put in by one SQL statement that Spark
and DuckDB run alike.  Every row of ``orders`` becomes a short article and every
row of ``documents`` a long one that keeps its whole text, with an ISBN at the
end of each of its sentences.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.workspace import new_folder, spread, store

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SHORT_ARTICLES = """
select o_orderkey as page_id, concat('Order ', cast(o_orderkey as varchar(20))) as title,
 case o_orderkey % 3 when 0 then 'en' when 1 then 'de' else 'fr' end as language,
 case o_orderkey % 8
  when 0 then concat('Ref ISBN ', substr(b,1,1), '-', substr(b,2,3), '-', substr(b,5,5), '-', c, ' end')
  when 1 then concat('See ISBN: 978-', substr(b,1,1), '-', substr(b,2,3), '-', substr(b,5,5), '-', cast(o_custkey % 10 as varchar(20)), '.')
  when 2 then concat('at https://x.org/isbn/', b, c, ' only')
  when 3 then concat('OCLC ', b, c, ' x')
  when 4 then concat('ISBN ', b, c, ' 1999')
  when 5 then concat('A ISBN ', b, c, ', B ISBN 978', b, cast(o_custkey % 10 as varchar(20)), ' z')
  when 6 then concat('isbn       ', b, c)
  else concat('ISBN ', b, 'x https://y.org/q eISBN=', b, c, '-')
 end as text
from (select o_orderkey, o_custkey,
             lpad(cast((o_orderkey * 7919 + o_custkey) % 1000000000 as varchar(20)), 9, '0') as b,
             case when o_custkey % 11 = 10 then 'X' else cast(o_custkey % 11 as varchar(20)) end as c
      from orders) q
"""

LONG_ARTICLES = """
select 1000000000 + doc_id as page_id, concat('Doc ', source, ' ', cast(doc_id as varchar(20))) as title,
 lang as language,
 concat('{{cite book |isbn=', b, c, '}} ',
        replace(text, '. ', concat('. ISBN 978-', substr(b,1,1), '-', substr(b,2,3), '-', substr(b,5,5), '-', d,
                                   ' p. 12 or http://books.example/isbn/', b, c, ' OCLC ', b, c, ' ')),
        ' eISBN: ', b, 'X') as text
from (select doc_id, text, lang, source,
             lpad(cast((doc_id * 104729 + n_chars) % 1000000000 as varchar(20)), 9, '0') as b,
             case when n_chars % 11 = 10 then 'X' else cast(n_chars % 11 as varchar(20)) end as c,
             cast(n_chars % 10 as varchar(20)) as d
      from documents) q
"""

ARTICLES = f"{SHORT_ARTICLES} union all {LONG_ARTICLES}"

NAMESPACE = "http://www.mediawiki.org/xml/export-0.11/"
DUMP_DATE = "20250101"


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Temporary views over the given parquet tables."""
    for name in tables or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, statement: str, *tables: str) -> DataFrame:
    register(spark, sf_dir, *tables)
    return spark.sql(statement)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, title, language, text)``."""
    return spread(sql(spark, sf_dir, ARTICLES, "orders", "documents"), parts(spark), "page_id")


def parts(spark: SparkSession) -> int:
    """Tasks for the articles, the same at every size of the tables: three for each core."""
    return 3 * spark.sparkContext.defaultParallelism


def _escaped(column: str) -> F.Column:
    value = F.col(column)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


#: Bytes that are worth a part of a dump, and the most that one part should hold.
LEAST_PART, MOST_PART = 4 << 20, 1 << 30
#: Bytes of a page besides its text, bytes per tick, and ticks that tell a part's borders.
PAGE_BYTES, TICK_BYTES, TICKS = 200, 1 << 14, 100


def _ticks(bytes_: F.Column, step: float, seed: int) -> F.Column:
    """``bytes_`` over ``step``, rounded at random by language and key, so that sums hold."""
    chance = F.pmod(F.xxhash64("language", "key", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    return F.floor(bytes_ / step + chance).alias("ticks")


def cut_pieces(rows: DataFrame, most: int) -> DataFrame:
    """``(language, start, stop, piece)``: some ``most`` ranges of keys that hold about the same bytes of text.

    Long articles follow many short ones, so equal numbers of rows would leave almost all
    bytes to a few tasks.  Only the borders are estimated: every key is in one range of its
    language, whose first range has no start and whose last one has no stop.  Ranges are
    numbered in the order of language and key, and none but the last of a language has fewer pages
    than the head of a dump.
    """
    spark = rows.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + PAGE_BYTES
    ticks = store(rows.select("language", "key", _ticks(size, TICK_BYTES, 1)).filter("ticks > 0"), "ticks")
    total = ticks.agg(F.sum("ticks")).first()[0] or 0
    n = max(1, min(max(most, total * TICK_BYTES // MOST_PART), total * TICK_BYTES // LEAST_PART))
    step = max(1.0, total / (TICKS * n))
    thin = ticks.select("language", "key", _ticks(F.col("ticks"), step, 2)).filter("ticks > 0 AND key IS NOT NULL")
    seen = thin.groupBy("language", "key").agg(F.sum("ticks").alias("ticks")).orderBy("language", "key").collect()
    share = total / step / n
    starts: dict[str | None, list[int | None]] = {r[0]: [None] for r in rows.select("language").distinct().orderBy("language").collect()}
    language, passed, pages = None, 0, 0
    for r in seen:
        if r["language"] != language:
            language, passed, pages = r["language"], 0, 0
        if passed >= share and pages >= p.ELEMENT_PAGES:
            starts[language].append(r["key"])
            passed, pages = 0, 0
        passed, pages = passed + r["ticks"], pages + 1
    ranges = [(code, start, stop) for code, keys in starts.items() for start, stop in zip(keys, [*keys[1:], None])]
    listed = json.dumps([dict(zip(("language", "start", "stop", "piece"), (*r, k))) for k, r in enumerate(ranges)])
    kind = "array<struct<language:string,start:bigint,stop:bigint,piece:int>>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(listed), kind)))


def write_dumps(pages: DataFrame, path: str, order: str = "page_id") -> str:
    """Write pages as compressed XML dumps, one folder of bz2 parts per language.

    ``pages`` gives ``language``, ``title``, ``text`` and the key ``order``;
    optional columns: ``ns`` (default 0), ``redirect`` (boolean), and ``damaged``
    (boolean, leaves an element open).  The parts of a dump, in name order,
    are a well-formed document: the first piece begins with its head and the last
    one closes it, however many there are.
    """
    have = set(pages.columns)
    ns = F.col("ns").cast("string") if "ns" in have else F.lit("0")
    redirect = F.when(F.col("redirect"), '<redirect title="x" />').otherwise("") if "redirect" in have else F.lit("")
    close = F.when(F.col("damaged"), "").otherwise("</revision>") if "damaged" in have else F.lit("</revision>")
    # Not indented: blanks between elements would be a fifth of a short article's page.
    page = F.concat(
        F.lit("<page><title>"), _escaped("title"), F.lit("</title><ns>"), ns, F.lit("</ns>"), redirect,
        F.lit('<revision><text xml:space="preserve">'), _escaped("text"), F.lit("</text>"), close, F.lit("</page>"),
    )
    body = pages.select("language", F.lit(1).alias("at"), F.col(order).cast("long").alias("key"), page.alias("xml"))
    pieces = cut_pieces(pages.select("language", F.col(order).cast("long").alias("key"), "text"), parts(pages.sparkSession))
    head = F.lit(
        f'<mediawiki xmlns="{NAMESPACE}" version="0.11">\n  <siteinfo>\n    '
        "<sitename>Test</sitename>\n  </siteinfo>"
    )
    zero = F.lit(0).cast("long").alias("key")
    frame = pieces.filter("start IS NULL").select("language", F.lit(0).alias("at"), zero, head.alias("xml"), "piece")
    end = pieces.filter("stop IS NULL").select("language", F.lit(2).alias("at"), zero, F.lit("</mediawiki>").alias("xml"), "piece")
    # Keys that are NULL come first, as in the order of the rows.
    key, start, stop = F.col("b.key"), F.col("p.start"), F.col("p.stop")
    inside = (start.isNull() | F.coalesce(key >= start, F.lit(False))) & (stop.isNull() | key.isNull() | (key < stop))
    same = F.col("b.language").eqNullSafe(F.col("p.language"))
    placed = body.alias("b").join(F.broadcast(pieces).alias("p"), same & inside).select("b.*", "p.piece")
    name = F.concat("language", F.lit(f"wiki-{DUMP_DATE}-pages-articles-multistream.xml.bz2"))
    (
        placed.unionByName(frame).unionByName(end)
        .withColumn("dump", name)
        .repartitionById(max(1, pieces.count()), "piece")
        .sortWithinPartitions("dump", "at", "key")
        .select("dump", "xml")
        .write.partitionBy("dump")
        .option("compression", "bzip2")
        .text(path)
    )
    return path


PAGE_KINDS = f"""
select page_id, language,
 case when page_id % 19 = 0 then '' else title end as title,
 case page_id % 7 when 0 then '1' when 1 then '10' else '0' end as ns,
 page_id % 11 = 0 as redirect,
 case when page_id % 13 = 0 then '' else text end as text
from ({ARTICLES}) a
"""

DUMP_PAGES = f"""
select page_id, language, title, text,
 case page_id % 7 when 0 then '1' else '0' end as ns, page_id % 11 = 0 as redirect
from ({ARTICLES}) a
"""

# What a reader must return of the dumps written from DUMP_PAGES.
DUMP_ARTICLES = f"""
select page_id, language, title, text from ({ARTICLES}) a
where page_id % 7 <> 0 and page_id % 11 <> 0
"""

_written: dict[tuple[str, str, str], str] = {}


def dumps(spark: SparkSession, sf_dir: str, damaged: str = "") -> str:
    """Dumps made from the articles, written once per session and kind.

    ``damaged`` is an SQL condition for pages to be written malformed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, damaged)
    if key not in _written:
        pages = sql(spark, sf_dir, DUMP_PAGES, "orders", "documents")
        if damaged:
            pages = pages.withColumn("damaged", F.expr(damaged))
        _written[key] = write_dumps(pages, new_folder(spark, "dumps"))
    return _written[key]
