"""What dump files are present, without opening them, and how they begin."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import labels
from colophon.functions import patterns as p

PAGE_END = b"</page>"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file_name, length, modificationTime)`` of the bz2 files of a folder; none is opened.

    Parts in a folder ``dump=<name>`` go by the name of the dump.  Other folders below
    are not looked into.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", p.DUMP_GLOB).load(path)
    own = F.element_at(F.split("path", "/"), -1)
    name = F.col("dump").cast("string") if "dump" in files.columns else own
    return files.select("path", "length", "modificationTime", name.alias("file_name"))


def dump_names(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name)`` of every dump of a folder, empty files included, which no scan shows.

    Taken from the listing that the driver holds to plan any read of the folder.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", p.DUMP_GLOB).load(path).inputFiles()
    names = {unquote(m[1] if (m := re.search("/dump=([^/]+)/", f)) else f.rsplit("/", 1)[-1]) for f in found}
    # Made without Python workers, which would cost each batch of a stream more than its files.
    return spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(names))), "array<string>")).alias("file_name"))


def with_codes(files: DataFrame) -> DataFrame:
    """Language and date of inventoried file names; names without a code are dropped."""
    return (
        files.withColumn("language", labels.inventory_language("file_name"))
        .withColumn("dump_date", labels.inventory_date("file_name"))
        .filter(F.col("language").isNotNull())
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory ``(path, file_name, language, dump_date, length)`` of a dump folder."""
    files = with_codes(list_files(spark, path).filter(F.col("file_name").rlike(p.INVENTORY_NAME)))
    return files.select("path", "file_name", "language", "dump_date", "length")


#: Schemes that Spark is given, by the name other readers know them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "dbfs": None, "wasbs": None}


def head_reader(pages: int, page_end: bytes = PAGE_END, schemes: dict = SCHEMES) -> Callable:
    """A function for tasks that reads the beginning of listed dumps.

    A function in a function that refers to nothing of this module is shipped whole, so
    it runs on executors on which this package is not installed.  A block is looked at once, and a file that does not
    begin like XML is given up at its first block.
    """

    def first_pages(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for path in batch["path"]:
                scheme, colon, rest = path.partition(":/")
                if colon and scheme in schemes:
                    if schemes[scheme] is None:
                        raise ValueError(f"heads cannot be read over {scheme}:; give a path of another scheme")
                    scheme = schemes[scheme]
                # Spark writes file:/x where other tools want file:///x.
                uri = f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme}{colon}{rest}"
                source, inner = fs.FileSystem.from_uri(uri)
                blocks, seen, tail = [], 0, b""
                with source.open_input_stream(inner, compression="bz2") as stream:
                    while seen < pages and (block := stream.read(1 << 16)):
                        if not blocks and not block.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"<"):
                            break
                        blocks.append(block)
                        # An end may lie across two blocks.
                        seen += (tail + block).count(page_end)
                        tail = block[-(len(page_end) - 1) :]
                cut = b"".join(blocks).split(page_end)
                if len(cut) > pages:
                    cut = [*cut[:pages], b""]
                heads.append(page_end.join(cut).decode("utf-8", "replace"))
            yield batch.assign(head=heads)

    return first_pages


def read_heads(spark: SparkSession, path: str, pages: int = p.ELEMENT_PAGES) -> DataFrame:
    """``(path, file_name, head)``: each dump up to the end of its first pages.

    One small task per few files; a dump of any size costs a few blocks, and of a dump
    in parts the first one is opened.
    """
    files = list_files(spark, path).groupBy("file_name").agg(F.min("path").alias("path"))
    return files.select("path", "file_name").mapInPandas(head_reader(pages), "path STRING, file_name STRING, head STRING")
