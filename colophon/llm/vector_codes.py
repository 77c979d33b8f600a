"""Vector codes: product quantisation in whole numbers, entries found by a GNAT.

A vector is cut into parts, and each part is coded by the nearest of the entries of its
codebook.  The entries of a codebook stand in a geometric near-neighbour access tree:
split points far from each other, every other entry with its nearest one, and for every
split point and child the range of distances between the split point and the child's
entries.  A search knows its distances to the split points and the least distance found
so far; by the triangle inequality a child whose range lies wholly beyond that cannot
hold a nearer or equally near entry, and its subtree is left out.  Ranges and distances
are rounded to the safe side, only strictly farther subtrees are left out, and squared
distances, which decide, are whole numbers; of equal ones the entry of least index wins.

Every round is one pass over the vectors.  Tasks give sums per entry, so what reaches the
driver is the codebooks' size at any size of table.

Definitions
* Rows whose vector is null or has null or non-finite components are dropped.
* A component x becomes floor(1024 * x).  Codebooks start with the parts of the vectors of
  the least ids; of equal ids, of the least vectors; null ids come last.
* A vector of another length than the first one of the codebooks, or with components whose
  squared distances could pass 64 bits (about 2**18 or more at 64 components), has null
  code and error and takes no part.  Parts of lengths that are no multiple of their number
  differ by one.
* Repeated rows count as often as they occur.  Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.workspace import store

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Split points of a node, and entries that are searched without one.
SPLITS, LEAF = 16, 24
#: Relative room for the rounding of square roots and sums.
ROOM = 1e-12
#: Rows searched at once.
ROWS = 8192
#: Labels whose sums are broadcast; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Pieces of a label's rows, where both sides are shuffled.
SALTS = 32


def squares(q: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two tables of whole numbers."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if q.shape[1] * (2 * top) ** 2 < 1 << 52:  # all intermediate values are whole numbers that a double holds
        a, b = q.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(q), len(entries)), dtype=np.int64)
    for k in range(q.shape[1]):
        out += (q[:, k, None] - entries[None, :, k]) ** 2
    return out


@dataclass
class Node:
    """Split points with their indexes; children and, per split point and child, a range of distances.  A leaf has no children."""

    index: np.ndarray
    entries: np.ndarray
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


def tree(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """The tree over the rows of ``entries``."""
    index = np.arange(len(entries)) if index is None else index
    none = np.zeros((0, 0))
    if len(entries) <= LEAF:
        return Node(index, entries, [], none, none)
    picked, far = [0], None
    while len(picked) < SPLITS:  # each the farthest from those before it
        d = squares(entries, entries[picked[-1:]])[:, 0]
        far = d if far is None else np.minimum(far, d)
        far[picked] = -1
        picked.append(int(far.argmax()))
    between = squares(entries, entries[picked])
    home = between.argmin(axis=1)
    home[picked] = np.arange(SPLITS)
    distance = np.sqrt(between.astype(np.float64))
    low, high = np.empty((SPLITS, SPLITS)), np.empty((SPLITS, SPLITS))
    children: list[Node | None] = []
    rest = np.ones(len(entries), dtype=bool)
    rest[picked] = False
    for j in range(SPLITS):
        members = np.flatnonzero((home == j) & rest)
        children.append(tree(entries[members], index[members]) if len(members) else None)
        of = distance[members] if len(members) else np.full((1, SPLITS), np.nan)
        low[:, j], high[:, j] = of.min(axis=0) * (1 - ROOM), of.max(axis=0) * (1 + ROOM)
    return Node(index[picked], entries[picked], children, low, high)


def _seek(node: Node, q: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> int:
    d = squares(q[rows], node.entries)
    seen = d.size
    least = d.min(axis=1)
    which = np.where(d == least[:, None], node.index[None, :], np.iinfo(np.int64).max).min(axis=1)
    better = (least < best[rows]) | ((least == best[rows]) & (which < found[rows]))
    best[rows[better]], found[rows[better]] = least[better], which[better]
    if not node.children:
        return seen
    roots = np.sqrt(d.astype(np.float64))
    near, far = roots * (1 - ROOM), roots * (1 + ROOM)
    home = d.argmin(axis=1)
    for own in (True, False):  # the nearest child first: it makes the radius small
        for j, child in enumerate(node.children):
            asked = np.flatnonzero((home == j) == own)
            if child is None or not len(asked):
                continue
            reach = np.sqrt(best[rows[asked]].astype(np.float64))[:, None] * (1 + ROOM)
            beyond = (near[asked] - reach > node.high[None, :, j]) | (far[asked] + reach < node.low[None, :, j])
            asked = asked[~beyond.any(axis=1)]
            if len(asked):
                seen += _seek(child, q, rows[asked], best, found)
    return seen


def nearest(node: Node, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance) of each row, and how many distances were computed."""
    found, best, seen = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), np.iinfo(np.int64).max), 0
    for at in range(0, len(q), ROWS):
        seen += _seek(node, q, np.arange(at, min(len(q), at + ROWS)), best, found)
    return found, best, seen


def cuts(length: int, parts: int) -> list[int]:
    """Where each part begins, and the end."""
    return [k * length // parts for k in range(parts + 1)]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))


def whole(vectors: DataFrame, vector_col: str) -> DataFrame:
    """``vectors`` without unusable rows, its vectors as whole numbers."""
    kept = vectors.where(usable(F.col(vector_col)))
    return kept.withColumn(vector_col, F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def fits(vector: Column, length: int) -> Column:
    """Whether it has ``length`` components, none so large that a squared distance could pass 64 bits."""
    most = isqrt((1 << 62) // max(1, length)) // 2
    return (F.size(vector) == length) & F.forall(vector, lambda x: (x >= -most) & (x <= most))


def _rows(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length) if length else np.zeros((len(column), 0), dtype=np.int64)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The codebooks, one per part, trained on all usable vectors."""
    rows = whole(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    order = (F.asc_nulls_last("id"), F.asc("v"))
    head = rows.orderBy(*order).limit(1).collect()
    length = len(head[0]["v"]) if head else 0
    rows = rows.where(fits(F.col("v"), length))
    smallest = [r["v"] for r in rows.orderBy(*order).limit(entries).collect()]
    first = np.array(smallest, dtype=np.int64).reshape(len(smallest), length)
    at = cuts(length, parts)
    books = [first[:, a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    if not len(first) or not length:
        return books
    widest = max(b - a for a, b in zip(at, at[1:], strict=False))
    for _ in range(rounds):
        trees = [tree(np.array(book, dtype=np.int64).reshape(len(book), -1)) for book in books]

        def sums(batches: Iterator[pa.RecordBatch], trees: list[Node] = trees) -> Iterator[pa.RecordBatch]:
            count = np.zeros((parts, len(first)), dtype=np.int64)
            total = np.zeros((parts, len(first), widest), dtype=np.int64)
            for batch in batches:
                x = _rows(batch.column(0), length)
                for p in range(parts):
                    q = x[:, at[p] : at[p + 1]]
                    found = nearest(trees[p], q)[0]
                    order = np.argsort(found, kind="stable")
                    used, begin = np.unique(found[order], return_index=True)
                    if len(used):
                        count[p] += np.bincount(found, minlength=len(first))
                        total[p, used, : q.shape[1]] += np.add.reduceat(q[order], begin, axis=0)
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        given = rows.select("v").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        added = given.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(widest)])
        for row in added.collect():  # one row per entry in use
            p = row["part"]
            books[p][row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(at[p + 1] - at[p])]
    return books


def digest(books: list[list[list[int]]]) -> str:
    """Of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[list[list[int]]], vector_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors``, their vector replaced by ``code`` (two hex digits per part) and ``error``."""
    widths = [len(book[0]) if book else 0 for book in books]
    length, at = sum(widths), np.cumsum([0, *widths]).tolist()
    known = bool(books and books[0])
    rows = whole(vectors, vector_col)
    others = [c for c in rows.columns if c != vector_col]
    if not known:
        return rows.select(*others, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    trees = [tree(np.array(book, dtype=np.int64).reshape(len(book), -1)) for book in books]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(len(others)), length)
            found = [nearest(trees[p], x[:, at[p] : at[p + 1]]) for p in range(len(trees))]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(trees)), dtype=np.uint8)
            error = np.sum([f[1] for f in found], axis=0).astype(np.int64) if len(x) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], [*batch.schema.names[:-1], "code", "error"])

    names = rows.select(*others)
    schema = names.schema.add("code", "string").add("error", "long")
    good = rows.where(fits(F.col(vector_col), length)).select(*others, vector_col).mapInArrow(code, schema)
    odd = rows.where(~fits(F.col(vector_col), length)).select(*others, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return good.unionByName(odd)


def decode(code: str, books: list[list[list[int]]]) -> list[float]:
    """The vector that a code stands for."""
    return [(x + 0.5) / SCALE for book, entry in zip(books, bytes.fromhex(code), strict=True) for x in book[entry]]


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    books = fit(rows, "vec_id", "vector")
    found = store(encode(rows, books, "vector"), "vector-codes")
    sums = store(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "vector-labels")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= MOST_BROADCAST:
        out = found.join(F.broadcast(sums), same)
    else:  # a label of any share is split
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = found.withColumn("turn", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("turn") == F.col("salt")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
