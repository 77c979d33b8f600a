"""How dumps are built: XML namespace and element names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.functions.text import as_column, ColumnLike
from colophon.workspace import store


def xml_namespace(head: ColumnLike) -> Column:
    """Namespace declared at the very beginning of a dump, NULL when there is none."""
    # Up to the end of the first start tag, however long it is.
    start = F.regexp_extract(as_column(head), r"\A[^<]*(?:<[?!][^>]*+>[^<]*+)*+<[^>]*>", 0)
    return F.nullif(F.regexp_extract(start, p.XML_NAMESPACE, 1), F.lit(""))


def dump_namespaces(heads: DataFrame, *keys: str) -> DataFrame:
    """Namespace per dump; of the parts of a dump only the first declares it."""
    keys = keys or ("file_name",)
    return heads.groupBy(*keys).agg(F.max(xml_namespace("head")).alias("namespace"))


def element_names(markup: ColumnLike) -> Column:
    """Names of the elements opened in a piece of markup, each once."""
    return F.array_distinct(
        F.regexp_extract_all(as_column(markup), F.lit(p.XML_ELEMENT), F.lit(1))
    )


def compare_elements(rows: DataFrame, markup: str, in_first: Column) -> DataFrame:
    """``(element, side)`` with side ``common``, ``only_in_first`` or ``only_in_second``.

    Both sides are told apart in one grouping: each element moves at most once
    per task and side, and no join is needed.
    """
    names = rows.select(in_first.alias("first"), F.explode(element_names(markup)).alias("element"))
    sides = names.groupBy("element").agg(
        F.bool_or("first").alias("one"), F.bool_or(~F.col("first")).alias("two")
    )
    side = (
        F.when(F.col("one") & F.col("two"), "common")
        .when(F.col("one"), "only_in_first")
        .otherwise("only_in_second")
    )
    return sides.select("element", side.alias("side"))


def compare_dump_structures(first: DataFrame, second: DataFrame, markup: str = "head") -> DataFrame:
    """Compare two sets of dump heads, or of whole records, by their element names."""
    both = first.select(F.lit(True).alias("is_first"), markup).unionByName(
        second.select(F.lit(False).alias("is_first"), markup)
    )
    return compare_elements(both, markup, F.col("is_first"))


def compare_namespaces(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(first, second, same)``: the namespaces of two sets of heads of one dump each."""
    both = first.select(F.lit(True).alias("is_first"), "head").unionByName(second.select(F.lit(False).alias("is_first"), "head"))
    names = both.select("is_first", xml_namespace("head").alias("namespace")).agg(
        F.max(F.when(F.col("is_first"), F.col("namespace"))).alias("first"),
        F.max(F.when(~F.col("is_first"), F.col("namespace"))).alias("second"),
    )
    return names.select("first", "second", F.col("first").eqNullSafe(F.col("second")).alias("same"))


#: Dumps per word of a bitmap; a word is a number without a sign.
WORD_BITS = 63


@dataclass
class StructureMatrix:
    """Which of many dumps have which elements, read in one pass.

    ``numbers`` is ``(dump, number)``, dense from 0 in order of names, and ``bits`` is
    ``(element, word, bits)``: bit b of word w stands for the dump of number
    w * WORD_BITS + b.  Any two dumps are compared by their bits, so N dumps are read N
    times at most, not once per pair.
    """

    numbers: DataFrame
    bits: DataFrame


def structure_matrix(rows: DataFrame, markup: str, dump: str) -> StructureMatrix:
    """The matrix of markup in ``rows``; the dumps' names must be few enough to be numbered in one task."""
    pairs = store(rows.select(F.col(dump).alias("dump"), F.explode(element_names(markup)).alias("element")).distinct(), "structure")
    numbers = pairs.select("dump").distinct().withColumn("number", F.row_number().over(Window.orderBy("dump")) - 1)
    numbers = store(numbers, "structure-dumps")
    bit = F.expr(f"shiftleft(1L, CAST(number % {WORD_BITS} AS INT))")
    placed = pairs.join(numbers, "dump").select("element", F.floor(F.col("number") / WORD_BITS).cast("int").alias("word"), bit.alias("bit"))
    return StructureMatrix(numbers, placed.groupBy("element", "word").agg(F.bit_or("bit").alias("bits")))


def dumps_of(matrix: StructureMatrix) -> DataFrame:
    """``(element, dumps, n_dumps)``: the names of the dumps that have each element, in order."""
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.getbit(F.col("bits"), b) == 1)
    each = matrix.bits.select("element", F.explode(F.transform(held, lambda b: F.col("word") * WORD_BITS + b)).alias("number"))
    named = each.join(matrix.numbers, "number").groupBy("element").agg(F.array_sort(F.collect_list("dump")).alias("dumps"))
    return named.select("element", "dumps", F.size("dumps").alias("n_dumps"))


def compare_by_matrix(matrix: StructureMatrix, first: str, second: str) -> DataFrame:
    """``(element, side)`` of two dumps, as :func:`compare_elements` gives them."""

    def has(name: str) -> Column:
        return F.bool_or((F.col("dump") == name) & (F.getbit(F.col("bits"), F.col("number") % WORD_BITS) == 1))

    asked = matrix.numbers.filter(F.col("dump").isin(first, second))
    words = matrix.bits.join(asked, F.col("word") == F.floor(F.col("number") / WORD_BITS))
    sides = words.groupBy("element").agg(has(first).alias("one"), has(second).alias("two")).filter("one OR two")
    side = F.when(F.col("one") & F.col("two"), "common").when(F.col("one"), "only_in_first").otherwise("only_in_second")
    return sides.select("element", side.alias("side"))
