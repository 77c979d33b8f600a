"""Compressed XML dumps as DataFrames.

A dump is read as text with ``</page>`` as the record separator: one row per
page, and one bz2 file is shared out among many tasks by byte range.  A single
huge dump therefore does not hold up the job, which a reader with one task per
file would.

Dumps are either files named ``<lang>wiki-<date>-….bz2`` or, when Spark wrote
them, folders ``dump=<that name>`` of bz2 parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import labels
from colophon.functions import patterns as p
from colophon.sources.inventory import dump_names, list_files
from colophon.workspace import store

PAGE_SCHEMA = (
    "title STRING, ns STRING, "
    "revision ARRAY<STRUCT<text: STRUCT<_VALUE: STRING, _bytes: STRING>>>, "
    "_corrupt_record STRING"
)
PAGE_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    # Text is data here: leading and trailing blanks count.
    "ignoreSurroundingSpaces": "false",
}
ON_ERROR = ("fail", "drop_dump", "skip_page")
#: Bytes of dump files that are read again if one of them turns out to be damaged.
SHARE_BYTES = 1 << 40
#: Failed dumps that an error message names.
NAMED = 20

# Where a page stands: dump, byte range of the dump, place within the range.
POSITION = ("dump_file", "part", "row_id")


def read_records(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    without: tuple[str, ...] = (),
    only: tuple[str, ...] | None = None,
    share: tuple[int, int] = (0, 1),
    files_per_batch: int | None = None,
) -> DataFrame:
    """Raw records ``(dump_file, part, row_id, value)`` of every dump below ``path``.

    ``part`` and ``row_id`` together give the order of records in a dump; a stream
    cannot number its rows, so there ``row_id`` is NULL.  Dumps ``without`` are not
    opened, nor any but ``only`` those that are given, and of ``share`` (k, n) only those that fall in the k-th of n shares.
    A file that cannot be decompressed to its end fails the job that reads it.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = (
        reader.option("lineSep", "</page>")
        .option("pathGlobFilter", p.DUMP_GLOB)
        .option("ignoreCorruptFiles", "false")
        .option("ignoreMissingFiles", "false")
        .text(path)
    )
    meta = F.col("_metadata")
    in_folder = "dump" in rows.columns
    name = F.col("dump").cast("string") if in_folder else meta["file_name"]
    if without:
        rows = rows.filter(~name.isin(*without))
    if only is not None:
        rows = rows.filter(name.isin(*only))
    if share[1] > 1:
        rows = rows.filter(F.pmod(F.xxhash64(name), F.lit(share[1])) == share[0])
    # Parts of a folder are ordered by name, byte ranges of a file by position.
    part = F.concat(
        meta["file_name"] if in_folder else F.lit(""),
        F.lit("@"),
        F.lpad(meta["file_block_start"].cast("string"), 20, "0"),
    )
    return rows.select(
        name.alias("dump_file"),
        part.alias("part"),
        (F.lit(None).cast("long") if streaming else F.monotonically_increasing_id()).alias("row_id"),
        "value",
    )


def _space_only(xml: Column, element: str) -> Column:
    """Value of an element that holds nothing but white space.

    The XML reader gives NULL for it, yet such a text is a text.
    """
    first = F.substring_index(xml, "</revision>", 1)
    found = F.regexp_extract(first, rf"<{element}(?:\s[^>]*[^/>]|)>(\s+)</{element}>", 1)
    return F.nullif(found, F.lit(""))


def _surely_no_article(value: Column) -> Column:
    other_namespace = value.contains("<ns>") & ~value.contains("<ns>0</ns>")
    return value.contains("<redirect") | other_namespace


def parse_pages(records: DataFrame, on_error: str = "fail") -> DataFrame:
    """Page columns of raw records.

    Gives the position columns, ``language``, ``kind`` and the page's ``title``,
    ``ns``, ``redirect`` and ``text``.  ``kind`` is ``page``, ``broken`` for
    malformed XML, or ``end`` for the record that closes the dump.

    * ``fail`` stops at the first malformed page,
    * ``drop_dump`` reports it, for :func:`failed_dumps`,
    * ``skip_page`` leaves it out; only then may pages that are certainly no
      articles be dropped before they are parsed.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    value = F.col("value")
    has_page = value.contains("<page>")
    ends = value.contains("</mediawiki>")
    wanted = has_page if on_error == "skip_page" else has_page | ends
    rows = records.filter(wanted)
    if on_error == "skip_page":
        rows = rows.filter(~_surely_no_article(value))

    # A first `<page>` that never closes is inside the XML, where it will not parse.
    begin = F.instr(value, "<page>")
    xml = F.concat(F.substr(value, begin), F.lit("</page>"))
    options = dict(PAGE_OPTIONS)
    schema = PAGE_SCHEMA
    if on_error == "fail":
        options["mode"] = "FAILFAST"
        schema = schema.replace(", _corrupt_record STRING", "")
    page = F.when(has_page, F.from_xml(xml, schema, options))
    # The one-row generator keeps the optimizer from copying the parse into
    # every later filter.
    parsed = rows.select(
        *POSITION,
        has_page.alias("is_page"),
        (has_page & value.contains("<redirect") & value.rlike(r"<redirect[\s/>]")).alias("redirect"),
        F.when(has_page, _space_only(value, "text")).alias("blank_text"),
        F.when(has_page, _space_only(value, "title")).alias("blank_title"),
        F.explode(F.array(page)).alias("page"),
    )
    broken = (
        F.lit(False)
        if on_error == "fail"
        else F.coalesce(F.col("page._corrupt_record").isNotNull() | F.col("page").isNull(), F.lit(True))
    )
    kind = (
        F.when(~F.col("is_page"), F.lit("end")).when(broken, F.lit("broken")).otherwise(F.lit("page"))
    )
    # The first revision counts, and the first of each element.
    text = F.coalesce(F.get("page.revision", F.lit(0))["text"]["_VALUE"], "blank_text", F.lit(""))
    pages = parsed.select(
        *POSITION,
        labels.dump_language("dump_file").alias("language"),
        kind.alias("kind"),
        F.coalesce("page.title", "blank_title").alias("title"),
        F.col("page.ns").alias("ns"),
        "redirect",
        text.alias("text"),
    )
    return pages.filter(F.col("kind") == "page") if on_error == "skip_page" else pages


def is_article() -> Column:
    """Main namespace, no redirect, title and text not empty."""
    return (
        (F.col("ns") == "0")
        & ~F.col("redirect")
        & (F.coalesce(F.col("title"), F.lit("")) != "")
        & (F.coalesce(F.col("text"), F.lit("")) != "")
    )


def keep_articles(pages: DataFrame) -> DataFrame:
    """Articles among page rows, with their link."""
    kept = pages.filter(is_article())
    return kept.withColumn("url", labels.article_url("language", "title"))


class DumpError(RuntimeError):
    """A dump could not be read to its end."""


_UNREADABLE = re.compile(r"FAILED_READ_FILE[^\]]*\] Encountered error while reading file (\S+)")


def unreadable_dump(error: Exception) -> str | None:
    """The dump that a failed job could not read, if that is why it failed."""
    found = _UNREADABLE.search(str(error))
    if not found:
        return None
    path = unquote(found[1].rstrip("."))
    in_folder = re.search(r"/dump=([^/]+)/", path)
    return in_folder[1] if in_folder else path.rsplit("/", 1)[-1]


def store_pages(
    spark: SparkSession,
    path: str,
    on_error: str,
    narrow: Callable[[DataFrame], DataFrame],
    label: str,
    share_bytes: int = SHARE_BYTES,
) -> tuple[DataFrame, list[str]]:
    """``narrow`` of all parsed pages as a stored table, and the dumps that could not be decompressed.

    The dumps are written in shares of some ``share_bytes``.  With ``drop_dump`` a share
    in which a dump cannot be read is written again without it; otherwise the read error
    is raised.  So only the share of a damaged dump is read twice.
    """
    total = list_files(spark, path).agg(F.sum("length")).first()[0] or 0
    shares = 1 + total // share_bytes if on_error == "drop_dump" else 1
    lost: list[str] = []
    parts: list[DataFrame] = []
    for share in range(shares):
        while True:
            pages = parse_pages(read_records(spark, path, without=tuple(lost), share=(share, shares)), on_error)
            try:
                parts.append(store(narrow(pages), label))
                break
            except (PySparkException, Py4JJavaError) as error:
                name = unreadable_dump(error)
                if on_error != "drop_dump" or name is None or name in lost:
                    raise
                lost.append(name)
    return reduce(DataFrame.unionByName, parts), lost


def dump_states(pages: DataFrame) -> DataFrame:
    """``(dump_file, broken, ended)`` of the dumps that have a malformed page or an end."""
    return pages.filter(F.col("kind") != "page").groupBy("dump_file").agg(
        F.bool_or(F.col("kind") == "broken").alias("broken"),
        F.bool_or(F.col("kind") == "end").alias("ended"),
    )


def failed_dumps(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Dumps with a malformed page or without a proper end.

    ``files`` (file_name) names the dumps that should be there; one of which no record
    was read is a failed one.
    """
    state = dump_states(pages)
    expected = pages.select("dump_file").distinct() if files is None else files.select(F.col("file_name").alias("dump_file")).distinct()
    fine = state.filter(~F.col("broken") & F.col("ended")).select("dump_file")
    return expected.join(fine, "dump_file", "left_anti")


def raise_if_any(failed: DataFrame) -> None:
    """Raise :class:`DumpError` that names the failed dumps, the first ones if there are many."""
    names = [r[0] for r in failed.orderBy("dump_file").limit(NAMED + 1).collect()]
    if names:
        more = " and more" if len(names) > NAMED else ""
        raise DumpError(f"no proper end in {', '.join(names[:NAMED])}{more}")


def read_articles(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """``(dump_file, part, row_id, language, title, text, url)`` of all dumps below ``path``.

    ``skip_page`` is read lazily.  The other two judge whole dumps, so the pages are
    stored, in one pass, before any article is given out: ``fail`` raises if a listed
    dump is damaged, empty or without its end, ``drop_dump`` leaves it out.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    if on_error == "skip_page":
        articles = keep_articles(parse_pages(read_records(spark, path), on_error))
    else:
        pages, _ = store_pages(spark, path, on_error, lambda rows: rows.filter((F.col("kind") != "page") | is_article()), "pages")
        failed = failed_dumps(pages, dump_names(spark, path))
        if on_error == "fail":
            raise_if_any(failed)
        articles = keep_articles(pages.filter(F.col("kind") == "page"))
        if on_error == "drop_dump":
            articles = articles.join(failed, "dump_file", "left_anti")
    return articles.select(*POSITION, "language", "title", "text", "url")
