"""Embedding near-dedup by an exact metric range join.

Vectors of one label are scaled to length one, where a cosine is a distance: similar
vectors lie within a radius.  Pivots, a bounded sample per label, cut a label into
cells of the nearest pivot.  A vector also goes as a guest to every cell that may hold
a neighbour: by the triangle inequality one that is farther from the cell's pivot than
the cell's widest member plus the radius has none there, and by its generalised
hyperplane neither has one whose margin to the border exceeds the radius.  Cells join
independently.  Members and guests of a cell are dealt in blocks of bounded size, and
a task compares one block of members with one of members or guests, so a cell of any
size is many tasks.  A block gives counts and, of its own connected components, a star
of links each; never all pairs.

Definitions
* A link: equal labels, not null, and cosine >= ``COSINE`` in double precision.
* A vector that is null, zero, or has null or non-finite parts links with nothing, nor do
  two of different lengths.
* Rows of equal vectors and label are one class with its members; each counts the others.
* Rows that repeat a vec_id and vector count as vectors of their own.
* A null vec_id is never a component; its row counts links and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.graph import components
from colophon.workspace import store

COSINE = 0.93
#: Pivots per label and length: a bounded sample, those of least hash.
PIVOTS = 16
#: Rows of a block; a task holds two blocks and a truth value per pair of them.
BLOCK = 1024
#: Distances are compared with this much to spare; links are decided by cosine alone.
SLACK = 1e-9


def unit(vectors: list) -> list[np.ndarray | None]:
    """Vectors of length one, or None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or any(y is None for y in v) else np.asarray(v, dtype=np.float64)
        if x is not None and x.size and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            x = x / top
            out.append(x / np.sqrt((x * x).sum()))
        else:
            out.append(None)
    return out


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, group, same, unit) of every row; group and same are null if it links with nothing."""

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units = unit(frame["v"].tolist())
            units = [None if label is None else u for u, label in zip(units, frame["label"], strict=True)]
            yield pd.DataFrame(
                {
                    "row": frame["row"],
                    "group": [None if u is None else f"{len(u)} {label}" for u, label in zip(units, frame["label"], strict=True)],
                    "same": [None if u is None else blake2b(np.asarray(v, dtype=np.float64).tobytes(), digest_size=16).hexdigest() for u, v in zip(units, frame["v"], strict=True)],
                    "unit": [None if u is None else u.tobytes() for u in units],
                }
            )

    rows = vectors.select(F.col(id_col).cast("string").alias("row"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    found = rows.mapInPandas(scale, "row string, group string, same string, unit binary")
    return found.select(F.col("row").cast("long").alias("id"), "group", "same", "unit")


def cells(points: DataFrame) -> DataFrame:
    """(group, cell, rep, times, unit, guest): every class in its own cell, and as a guest where neighbours may be."""
    order = Window.partitionBy("group").orderBy(F.xxhash64("same"), "rep")
    picked = points.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select("group", F.col("place").alias("cell"), F.col("unit").alias("pivot"))
    picked = store(picked.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("cell", "pivot"))).alias("pivots")), "metric-pivots")
    reach = np.sqrt(max(0.0, 2 - 2 * COSINE)) + SLACK

    def distances(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        for _, part in frame.groupby("group", sort=False):
            pivots = np.array([np.frombuffer(p["pivot"]) for p in part["pivots"].iloc[0]])
            x = np.array([np.frombuffer(u) for u in part["unit"]])
            yield part, np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T)), pivots

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, d, _ in distances(frame):
                yield pd.DataFrame({"group": part["group"], "cell": d.argmin(axis=1), "far": d.min(axis=1)})

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, d, pivots in distances(frame):
                home = d.argmin(axis=1)
                wide = np.full(len(pivots), -np.inf)
                for r in part["widths"].iloc[0]:
                    wide[r["cell"]] = r["far"]
                apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
                own = d[np.arange(len(d)), home]
                # Margin of a vector to the border of another pivot's cell, on the straight line through both pivots.
                margin = (d**2 - own[:, None] ** 2) / np.maximum(2 * apart[home], 1e-12)
                goes = (d <= wide + reach) & (margin <= reach + 1e-6)
                goes[np.arange(len(d)), home] = True
                at, cell = np.nonzero(goes)
                yield pd.DataFrame(
                    {
                        "group": part["group"].to_numpy()[at], "cell": cell, "rep": part["rep"].to_numpy()[at], "times": part["times"].to_numpy()[at],
                        "unit": part["unit"].to_numpy()[at], "guest": cell != home[at],
                    }
                )

    known = points.join(picked, "group")
    widths = known.select("group", "pivots", "unit").mapInPandas(homes, "group string, cell int, far double").groupBy("group", "cell").agg(F.max("far").alias("far"))
    widths = store(widths.groupBy("group").agg(F.collect_list(F.struct("cell", "far")).alias("widths")), "metric-widths")
    return known.join(widths, "group").mapInPandas(places, "group string, cell int, rep string, times long, unit binary, guest boolean")


def block_links(placed: DataFrame) -> DataFrame:
    """(rep, head, links): per block pair, the rows linked, the least of their component there, and vectors linked."""
    sizes = placed.groupBy("group", "cell", "guest").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("group", "cell").agg(
        F.max(F.when(~F.col("guest"), F.ceil(F.col("n") / BLOCK)).otherwise(0)).alias("home_blocks"),
        F.max(F.when(F.col("guest"), F.ceil(F.col("n") / BLOCK)).otherwise(0)).alias("guest_blocks"),
    )
    dealt = placed.join(sizes, ["group", "cell"])
    at = F.when(F.col("guest"), F.pmod(F.xxhash64("rep"), F.greatest("guest_blocks", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("home_blocks", F.lit(1))))
    dealt = dealt.withColumn("block", at.cast("int"))
    # As member: with every member and guest block of the cell. As other: with every member block.
    asked = F.concat(
        F.transform(F.when(F.col("home_blocks") > 0, F.sequence(F.lit(0), F.col("home_blocks").cast("int") - 1)), lambda k: F.struct(k.alias("other"), F.lit(False).alias("with_guests"))),
        F.coalesce(F.transform(F.when(F.col("guest_blocks") > 0, F.sequence(F.lit(0), F.col("guest_blocks").cast("int") - 1)), lambda k: F.struct(k.alias("other"), F.lit(True).alias("with_guests"))), F.array().cast("array<struct<other:int,with_guests:boolean>>")),
    )
    members = dealt.where(~F.col("guest")).select("group", "cell", F.col("block").alias("one"), F.explode(asked).alias("to"), "rep", "times", "unit", F.lit(True).alias("first"))
    members = members.select("group", "cell", "one", "to.other", "to.with_guests", "rep", "times", "unit", "first")
    heads = F.when(F.col("home_blocks") > 0, F.sequence(F.lit(0), F.col("home_blocks").cast("int") - 1))
    others = dealt.select("group", "cell", F.explode(heads).alias("one"), F.col("block").alias("other"), F.col("guest").alias("with_guests"), "rep", "times", "unit", F.lit(False).alias("first"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = frame[frame["first"]], frame[~frame["first"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"rep": pd.Series(dtype=object), "head": pd.Series(dtype=object), "links": pd.Series(dtype="int64")})
        a, b = (np.array([np.frombuffer(u) for u in x["unit"]]) for x in (one, two))
        near = a @ b.T >= COSINE
        ours, theirs = one["rep"].to_numpy(), two["rep"].to_numpy()
        near &= ours[:, None] != theirs[None, :]
        count = near @ two["times"].to_numpy(dtype=np.float64)
        # Components of this block pair: least place handed along links until nothing changes.
        names, place = np.unique(np.concatenate([ours, theirs]), return_inverse=True)
        label = np.arange(len(names))
        row, col = np.nonzero(near)
        u, v = place[row], place[len(ours) + col]
        while len(u):
            least = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, least)
            np.minimum.at(new, v, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        linked = np.flatnonzero(near.any(axis=1))
        out = pd.DataFrame({"rep": ours[linked], "head": names[label[place[linked]]], "links": count[linked].astype(np.int64)})
        far = np.setdiff1d(v, place[linked])
        return pd.concat([out, pd.DataFrame({"rep": names[far], "head": names[label[far]], "links": 0})])

    both = members.union(others)
    return both.groupBy("group", "cell", "one", "other", "with_guests").applyInPandas(compare, "rep string, head string, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    rows = store(classes(vectors, id_col, vector_col, label_col), "metric-rows")
    rep = F.concat_ws("/", "group", "same")
    usable = rows.where(F.col("same").isNotNull())
    points = usable.groupBy("group", "same").agg(F.count("*").alias("times"), F.min("id").alias("least"), F.first("unit").alias("unit")).withColumn("rep", rep)
    points = store(points, "metric-points")
    found = store(block_links(cells(points.select("group", "same", "rep", "times", "unit"))), "metric-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = points.select("rep", "least").where("least IS NOT NULL")
    edges = found.select("rep", "head").where("rep <> head").distinct()
    edges = edges.join(named, "rep").select(F.col("least").alias("u"), "head").join(named.withColumnRenamed("rep", "head"), "head").select("u", F.col("least").alias("v"))
    # One id may stand in several classes; it links them.
    within = usable.where(F.col("id").isNotNull()).select("id", rep.alias("rep")).join(named, "rep").select(F.col("id").alias("u"), F.col("least").alias("v")).where("u <> v")
    groups = components(edges.union(within))
    out = rows.select("id", rep.alias("rep"), F.col("same").isNotNull().alias("usable"))
    out = out.join(points.select("rep", "times"), "rep", "left").join(counts, "rep", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    links = F.when(F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("times") - 1).otherwise(0)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
