"""Exact removal of long byte strings that occur twice, by ranks of growing strings.

A suffix array by prefix doubling ranks every position of the corpus at lengths 1, 2, 4
and so on, dropping positions whose rank is unique.  Here the ranked positions are
chosen by content, so that a few per thousand bytes are enough, and the strings grow to
both sides of them.

* Every window of ``length`` bytes has an anchor: the place in it of the least hash of
  ``GRAM`` bytes, the first of equal ones.  Equal windows have equal anchors at equal
  distance, so windows need only be compared with those of the same gram and distance.
  Neighbouring windows of one anchor are a run.
* Round 1 ranks grams (one per run).  A gram found once ends its run.
* Round 2 ranks all bytes of a run.  If they occur twice, so do all its windows.
* Round 3 cuts the other runs in cells of ``CELL`` distances and ranks the bytes that all
  windows of a cell share; unique, they end the cell.  It also ranks the bytes of the
  whole cell; twice, they settle it.
* Round 4 ranks the single windows of cells that are still open.

A rank is a name: the gram's hash with a hash of the string, 128 bits together.  Spark
groups names with their counts and joins the ones found twice; a name of any number of
places is one counted row, and hot names are joined by splitting the places.

Definitions
* Texts are UTF-8 bytes; null is empty.  Strings lie in one text.  A byte is removed if a
  string of ``length`` bytes over it also starts at any other place of the input.
* Repeated rows are documents of their own, so their bytes repeat.  Rows that agree in id
  and text get the same result.
* Texts shorter than ``length`` lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import tokens as T
from colophon.workspace import store

LENGTH = 400
GRAM = 32
CELL = 17
#: Bytes of text whose windows are looked at at once, whole documents only; the arrays take some hundred bytes for each.
PIECE = 1 << 18
#: Documents are filtered by a broadcast of their names up to so many (32 MB); beyond, they are shuffled.
MOST_BROADCAST = 1_000_000
_PLACE = np.uint64((1 << 28) - 1)
_MISS = np.uint64(0xFFFFFFFFFFFFFFFF)


class Hashes:
    """Hashes of any strings of one run of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(T.BYTE_CODE[data] * T.powers(T._BASE, n), out=self.sums[1:])
        self.back = T.powers(T._BASE_INVERSE, n + 1)

    def __call__(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return T.mix((self.sums[z] - self.sums[a]) * self.back[a])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for every i, from block-wise minima of both directions."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, _MISS, dtype=np.uint64)
    blocks[: len(x)] = x
    ahead = np.minimum.accumulate(blocks.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(blocks.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, gram, whole) of every run; places within the document."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes(at, at + GRAM)
    # High bits of the hash, then the place: the least is the first place of the least hash.
    least = sliding_min((grams & ~_PLACE) | at.astype(np.uint64), length - GRAM + 1)
    anchors = (least & _PLACE).astype(np.int64)
    starts = np.arange(len(anchors))
    document = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + length <= offsets[document + 1]
    new = np.empty(len(starts), dtype=bool)
    new[:1] = True
    new[1:] = (anchors[1:] != anchors[:-1]) | (valid[1:] != valid[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    kept = valid[first]
    first, last = first[kept], last[kept]
    anchor, document = anchors[first], document[first]
    base = offsets[document]
    return document, anchor - base, first - base, last - base, grams[anchor], hashes(first, last + length)


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(d1, d2, q, s0, s1, gram, whole) of all documents (d1, d2, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(k).to_numpy() for k in (0, 1)]
            for begin, _, data, offsets in T.pieces(batch.column(2), PIECE):
                document, q, s0, s1, gram, whole = window_runs(data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[begin + document]) for x in names), *(pa.array(x.astype(np.int32)) for x in (q, s0, s1)), pa.array(T.spark_int64(gram)), pa.array(T.spark_int64(whole))],
                    ["d1", "d2", "q", "s0", "s1", "gram", "whole"],
                )
        T.give_back()

    schema = "d1 long, d2 long, q int, s0 int, s1 int, gram long, whole long"
    return docs.where(F.octet_length("text") >= length).select("d1", "d2", "text").mapInArrow(cut, schema)


def twice(rows: DataFrame, *names: str) -> DataFrame:
    """The names found more than once."""
    return rows.groupBy(*names).agg(F.count("*").alias("times")).where("times > 1").drop("times")


def marked(rows: DataFrame, found: DataFrame, names: list[str], mark: str) -> DataFrame:
    """``rows`` with a truth value: are their names in ``found``?"""
    return rows.join(found.withColumn(mark, F.lit(True)), names, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def with_texts(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """``lists`` (d1, d2, ...) beside the texts of their documents, each document once."""
    names = store(lists.select("d1", "d2"), "bytes-names")
    some = docs.join(F.broadcast(names) if names.count() <= MOST_BROADCAST else names, ["d1", "d2"], "left_semi")
    return some.dropDuplicates(["d1", "d2"]).join(lists, ["d1", "d2"])


def cells(open_runs: DataFrame, docs: DataFrame, length: int, cell: int) -> DataFrame:
    """(d1, d2, q, c, lo, hi, gram, core, full, ask) for cells of distances lo..hi of (d1, d2, q, s0, s1, gram, ask)."""
    lists = open_runs.groupBy("d1", "d2").agg(F.collect_list(F.struct("q", "s0", "s1", "gram", "ask")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, _ = T.text_bytes(batch.column(2).slice(k, 1))
                hashes = Hashes(data)
                found = batch.column(3)[k].values
                q, s0, s1 = (found.field(n).to_numpy().astype(np.int64) for n in ("q", "s0", "s1"))
                first, last = (q - s1) // cell, (q - s0) // cell
                row = np.repeat(np.arange(len(q)), last - first + 1)
                c = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
                lo, hi = np.maximum(c * cell, (q - s1)[row]), np.minimum(c * cell + cell - 1, (q - s0)[row])
                anchor = q[row]
                core = hashes(anchor - c * cell, np.minimum(anchor - c * cell - cell + 1 + length, len(data)))
                full = hashes(anchor - hi, anchor - lo + length)
                size = len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(size, batch.column(n)[k].as_py(), dtype=np.int64)) for n in (0, 1)),
                        *(pa.array(x.astype(np.int32)) for x in (anchor, c, lo, hi)),
                        pa.array(found.field("gram").to_numpy()[row]), pa.array(T.spark_int64(core)), pa.array(T.spark_int64(full)),
                        pa.array(found.field("ask").to_numpy(zero_copy_only=False)[row]),
                    ],
                    ["d1", "d2", "q", "c", "lo", "hi", "gram", "core", "full", "ask"],
                )
        T.give_back()

    schema = "d1 long, d2 long, q int, c int, lo int, hi int, gram long, core long, full long, ask boolean"
    return with_texts(lists, docs).select("d1", "d2", "text", "runs").mapInArrow(cut, schema)


def windows(open_cells: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(d1, d2, s, gram, far, name, ask): the single windows of (d1, d2, q, lo, hi, gram, ask)."""
    lists = open_cells.groupBy("d1", "d2").agg(F.collect_list(F.struct("q", "lo", "hi", "gram", "ask")).alias("cells"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, _ = T.text_bytes(batch.column(2).slice(k, 1))
                found = batch.column(3)[k].values
                q, lo, hi = (found.field(n).to_numpy().astype(np.int64) for n in ("q", "lo", "hi"))
                row = np.repeat(np.arange(len(q)), hi - lo + 1)
                far = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[row]
                start = q[row] - far
                size = len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(size, batch.column(n)[k].as_py(), dtype=np.int64)) for n in (0, 1)),
                        pa.array(start.astype(np.int32)), pa.array(found.field("gram").to_numpy()[row]), pa.array(far.astype(np.int32)),
                        pa.array(T.spark_int64(Hashes(data)(start, start + length))), pa.array(found.field("ask").to_numpy(zero_copy_only=False)[row]),
                    ],
                    ["d1", "d2", "s", "gram", "far", "name", "ask"],
                )
        T.give_back()

    schema = "d1 long, d2 long, s int, gram long, far int, name long, ask boolean"
    return with_texts(lists, docs).select("d1", "d2", "text", "cells").mapInArrow(cut, schema)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, text): d1 and d2 name a document, 128 bits of its id and text."""
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("key", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "key").alias("d2"), "text")


def covered(docs: DataFrame, length: int = LENGTH, cell: int = CELL) -> DataFrame:
    """(d1, d2, spans): the bytes [a, z) of each document (d1, d2, text) under strings that occur twice; spans may overlap."""
    every = store(runs(docs, length), "bytes-runs")
    # Round 1: grams.
    some = store(every.join(twice(every, "gram"), "gram", "left_semi"), "bytes-grams")
    # Round 2: whole runs.
    shape = some.withColumns({"far": F.col("q") - F.col("s0"), "wide": F.col("s1") - F.col("s0")})
    whole = ["gram", "far", "wide", "whole"]
    some = store(marked(shape, twice(shape, *whole), whole, "sure"), "bytes-whole")
    sure = some.where("sure").select("d1", "d2", F.col("s0").alias("a"), (F.col("s1") + length).alias("z"))
    # Round 3: cells of the others, beside one place of each settled run that they may share windows with.
    unsure = some.where("NOT sure")
    place = ["d1", "d2", "q", "s0", "s1"]
    one = some.where("sure").join(unsure.select("gram").distinct(), "gram", "left_semi")
    one = one.groupBy(*whole).agg(F.min(F.struct(*place)).alias("p")).select("p.*", "gram", F.lit(False).alias("ask"))
    asked = store(unsure.select(*place, "gram", F.lit(True).alias("ask")).unionByName(one), "bytes-unsure")
    cut = store(cells(asked, docs, length, cell), "bytes-cells")
    core, full = ["gram", "c", "core"], ["gram", "c", "lo", "hi", "full"]
    alive = store(cut.join(twice(cut, *core), core, "left_semi"), "bytes-cores")
    alive = store(marked(alive, twice(alive, *full), full, "settled"), "bytes-full")
    settled = alive.where("settled AND ask").select("d1", "d2", (F.col("q") - F.col("hi")).alias("a"), (F.col("q") - F.col("lo") + length).alias("z"))
    # Round 4: the windows of open cells, beside all of the cells that they may share windows with.
    still = alive.where("ask AND NOT settled").select(*core).distinct()
    last = alive.join(still, core, "left_semi").select("d1", "d2", "q", "lo", "hi", "gram", (F.col("ask") & ~F.col("settled")).alias("ask"))
    single = store(windows(store(last, "bytes-open"), docs, length), "bytes-windows")
    names = ["gram", "far", "name"]
    single = single.where("ask").join(twice(single, *names), names, "left_semi").select("d1", "d2", F.col("s").alias("a"), (F.col("s") + length).alias("z"))
    spans = sure.unionByName(settled).unionByName(single)
    return spans.groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "z")).alias("spans"))


def merged(a: np.ndarray, z: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint [a, z) in order; touching ones are one."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(z[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    return list(zip(a[new].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: removed bytes [a, z), maximal runs in order, and the bytes left."""
    rows = named(docs, id_col, text_col)
    found = covered(rows.select("d1", "d2", "text"), length)
    # Text that loses nothing need not move beside its spans.
    found = store(found, "bytes-spans")
    small = found.count() <= MOST_BROADCAST
    names = found.select("d1", "d2")
    names = F.broadcast(names) if small else names
    hit = rows.join(names, ["d1", "d2"], "left_semi").join(found, ["d1", "d2"])
    rest = rows.join(names, ["d1", "d2"], "left_anti")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, _ = T.text_bytes(batch.column(1).slice(k, 1))
                spans = batch.column(2)[k].values
                gone = merged(*(spans.field(n).to_numpy().astype(np.int64) for n in ("a", "z")))
                edges = np.array(gone, dtype=np.int64).reshape(-1, 2)
                left = b"".join(data[a:z].tobytes() for a, z in zip([0, *edges[:, 1]], [*edges[:, 0], len(data)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([len(data)]), pa.array([[{"a": a, "z": z} for a, z in gone]], SPANS), pa.array([left], pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )
        T.give_back()

    kind = dict(rows.dtypes)["id"]
    changed = hit.select("id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<a:long,z:long>>, kept binary")
    same = rest.select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.expr("array()").cast("array<struct<a:bigint,z:bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept")
    )
    return changed.unionByName(same)


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
