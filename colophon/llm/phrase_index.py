"""Benchmark decontamination by a positional inverted index.

The postings of the corpus (term, document, position) are a stored table.  It has the
terms that occur in the benchmark, as no other can be asked for, and one entry per
document for its length.  Every window of benchmark words is looked up from its rarest
term: its postings, less the term's offset, say where the benchmark text would begin
in a document.  These alignments are intersected with the postings of the next rarest
terms, and what is left is compared word by word.  Only DataFrame functions.

Definitions
* ``A-Z`` are lower-cased; a word is a run of digits, ``a-z`` and characters beyond ASCII.
* A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one
  window, one of none has none.  Document words inside an occurrence are hit.
* Null or empty texts have no words.  A null item id counts as the empty id; rows that
  repeat an item id add their windows to it.
* Documents are told apart by id and text; repeated rows each get the same result.
* Proximity: an item is near a document if, for one of its windows, the
  ``NEAR_TERMS`` rarest terms occur within ``NEAR_WORDS`` words of the rarest, in any order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.rows import keyed
from colophon.workspace import store

WINDOW = 10
NEAR_TERMS = 4
NEAR_WORDS = 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The entry of a document that has its length as position.
LENGTH = ""


def words(text: Column) -> Column:
    """The words of a text in order; none of null."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(cut, "")


def benchmark_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, item, terms): each row of the benchmark that has words."""
    found = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("terms"))
    found = found.where(F.size("terms") > 0).distinct()
    return found.select(F.xxhash64("item", F.array_join("terms", " ")).alias("row"), "item", "terms")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, body, pos) of all documents for ``terms``, and one of term LENGTH for each document.

    ``docs`` has id, body and text.  Nothing is shuffled if Spark finds the terms small.
    """
    found = docs.select("id", "body", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(LENGTH)))).alias("pos", "term"))
    asked = terms.union(terms.sparkSession.range(1).select(F.lit(LENGTH)))
    return found.join(asked, "term", "left_semi").select("term", "id", "body", "pos")


def window_ranks(bench: DataFrame, frequency: DataFrame, size: int) -> DataFrame:
    """(row, window, at, term, place): the words of each window, rarest first; windows with an unknown word are out."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("terms") - size, F.lit(0)))
    cut = bench.select("row", "terms", F.explode(starts).alias("window"))
    cut = cut.select("row", "window", F.posexplode(F.slice("terms", F.col("window") + 1, size)).alias("k", "term"))
    found = cut.join(frequency, "term", "left").selectExpr(
        "row", "window", "window + k AS at", "term", "min(coalesce(n, 0)) OVER (PARTITION BY row, window) AS least",
        "row_number() OVER (PARTITION BY row, window ORDER BY n, term, k) AS place",
    )
    return found.where("least > 0").select("row", "window", "at", "term", "place")


def alignments(index: DataFrame, ranks: DataFrame) -> DataFrame:
    """(row, id, body, shift): item word p may stand at document word p + shift, by the two rarest words of a window."""
    lead = ranks.where("place = 1").select("row", "window", F.col("at").alias("first"), "term")
    anchors = lead.select("row", "first", "term").distinct()
    begun = index.join(anchors, "term").select("row", "first", "id", "body", (F.col("pos") - F.col("first")).alias("shift"))
    following = ranks.where("place = 2").select("row", "window", F.col("at").alias("second"), F.col("term").alias("next"))
    steps = lead.join(following, ["row", "window"], "left").select("row", "first", "second", "next").distinct()
    begun = store(begun.join(steps, ["row", "first"]), "phrase-begun")
    alone = begun.where("next IS NULL").select("row", "id", "body", "shift")
    more = begun.where("next IS NOT NULL").select("row", "id", "body", "shift", F.col("next").alias("term"), (F.col("shift") + F.col("second")).alias("pos"))
    lists = index.join(following.select(F.col("next").alias("term")).distinct(), "term", "left_semi")
    met = more.join(lists, ["term", "id", "body", "pos"], "left_semi")
    return alone.union(met.select("row", "id", "body", "shift")).distinct()


def matches(docs: DataFrame, aligned: DataFrame, bench: DataFrame, size: int) -> DataFrame:
    """(id, body, item, runs): the document words [from, to) that windows of an item cover."""
    wanted = aligned.select("id", "body").distinct()
    texts = docs.join(wanted, ["id", "body"], "left_semi").dropDuplicates(["id", "body"]).select("id", "body", words(F.col("text")).alias("words"))
    texts = store(texts, "phrase-texts")
    both = texts.join(aligned.join(bench, "row"), ["id", "body"]).withColumn("n", F.least(F.lit(size), F.size("terms")))
    # Words of the document beside those of the item; positions outside the document match nothing.
    agrees = F.transform("terms", lambda t, p: F.coalesce(F.try_element_at("words", F.when(p + F.col("shift") >= 0, p + F.col("shift") + 1).otherwise(F.size("words") + 1)) == t, F.lit(False)))
    both = both.select("id", "body", "item", "shift", "n", agrees.alias("agrees"))
    # Runs of agreeing words, each long enough to hold a window: (from, length so far) as the fold goes on.
    empty = F.array().cast("array<struct<a:int,z:int>>")
    state = F.aggregate(
        F.concat("agrees", F.array(F.lit(False))),
        F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), empty.alias("runs")),
        lambda s, x: F.struct(
            (s["p"] + 1).alias("p"),
            F.when(x, s["n"] + 1).otherwise(0).alias("n"),
            F.when(~x & (s["n"] >= F.col("n")), F.array_append(s["runs"], F.struct((s["p"] - s["n"] + F.col("shift")).alias("a"), (s["p"] + F.col("shift")).alias("z"))))
            .otherwise(s["runs"]).alias("runs"),
        ),
    )
    return both.select("id", "body", "item", state["runs"].alias("runs")).where(F.size("runs") > 0)


def covered(runs: Column) -> Column:
    """Words in the union of [a, z) runs."""
    state = F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["z"] - F.greatest(r["a"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], r["z"]).alias("end")),
    )
    return state["n"]


def near_items(index: DataFrame, ranks: DataFrame, bench: DataFrame, terms: int = NEAR_TERMS, reach: int = NEAR_WORDS) -> DataFrame:
    """(id, body, item) whose rarest window terms stand close together in the document."""
    need = ranks.where(F.col("place") <= terms)
    # A window asks for its rarest word and that many others of it; one place of the rarest is enough.
    need = need.groupBy("row", "window").agg(F.min(F.when(F.col("place") == 1, F.col("term"))).alias("first"), F.array_sort(F.collect_set("term")).alias("asked"))
    need = need.select("row", "first", "asked", F.size("asked").alias("n")).distinct()
    begun = index.join(need.withColumnRenamed("first", "term"), "term")
    begun = begun.select("row", "asked", "n", "id", "body", F.col("pos").alias("centre"), F.explode("asked").alias("term"))
    close = begun.join(index, ["term", "id", "body"]).where(F.abs(F.col("pos") - F.col("centre")) <= reach)
    full = close.groupBy("row", "asked", "n", "id", "body", "centre").agg(F.count_distinct("term").alias("found")).where("found = n")
    return full.join(bench, "row").select("id", "body", "item").distinct()


class Contamination(NamedTuple):
    """Tables of one benchmark over one corpus."""

    #: (id, body, n_words) of every document, id and body as ``rows.keyed`` has them
    lengths: DataFrame
    #: (id, body, n_hit, items) of documents with occurrences; items are sorted ids
    hits: DataFrame
    #: (term, id, body, pos)
    index: DataFrame
    #: (row, window, at, term, place)
    ranks: DataFrame
    #: (row, item, terms)
    bench: DataFrame

    def near(self, terms: int = NEAR_TERMS, reach: int = NEAR_WORDS) -> DataFrame:
        return near_items(self.index, self.ranks, self.bench, terms, reach)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
) -> Contamination:
    """Index ``docs`` for the words of ``items`` and find the exact occurrences of their windows."""
    rows, key, body = keyed(docs, id_col, text_col)
    rows = rows.select(F.col(key).alias("id"), F.col(body).alias("body"), F.col(text_col).alias("text"))
    bench = store(benchmark_words(items, item_id, item_text), "phrase-items")
    terms = store(bench.select(F.explode("terms").alias("term")).distinct(), "phrase-terms")
    index = store(postings(rows, terms), "phrase-postings")
    frequency = index.where(F.col("term") != LENGTH).groupBy("term").agg(F.count("*").alias("n"))
    ranks = store(window_ranks(bench, frequency, size), "phrase-ranks")
    aligned = store(alignments(index, ranks), "phrase-alignments")
    found = matches(rows, aligned, bench, size)
    found = found.groupBy("id", "body").agg(
        covered(F.flatten(F.collect_list("runs"))).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )
    lengths = index.where(F.col("term") == LENGTH).select("id", "body", F.col("pos").cast("long").alias("n_words")).distinct()
    return Contamination(lengths, store(found, "phrase-hits"), index, ranks, bench)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with the columns of ``docs``."""
    hits = contamination(docs, items, id_col, text_col, **names).hits
    rows, key, body = keyed(docs, id_col, text_col)
    hit = hits.select(F.col("id").alias(key), F.col("body").alias(body))
    return rows.join(hit, [key, body], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
