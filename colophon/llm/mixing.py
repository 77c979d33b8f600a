"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source gets a target number of words from its weight.  The words to take are
dealt out in blocks of equal length: by highest quotients first to the sources, then
in each source to its shards.  A shard takes whole passes over its documents, and for
the rest of its quota blocks spread over it evenly from a seeded start.

Definitions
* A word is a run without ASCII white space; a null or empty text has none and is
  taken zero times.
* Sources are ranked by code point, null last; their weights repeat in that order.
  All targets together are as many words as all documents have.  No target exceeds
  ``most`` times the words of its source; what is above is shared by weight among the
  others until none is above.
* A shard is a part of a source by hash of the id and text, of some ``shard_blocks``
  blocks.  Its documents follow one another by hash of the seed, id and text.
* Rows that agree in id and text lie side by side in unspecified order, each counts.
* A text is taken ``most`` times at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.workspace import store

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_BLOCKS = 256
MOST_SHARDS = 1 << 16


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; of null, none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_of(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """All words shared by weight; what exceeds ``most`` times a size is shared anew."""
    limits, target = sizes * float(most), np.zeros(len(sizes))
    free = sizes > 0
    left = float(sizes.sum())
    while free.any():
        share = np.where(free, left * weights / weights[free].sum(), 0.0)
        above = free & (share > limits)
        if not above.any():
            target[free] = share[free]
            break
        target[above] = limits[above]
        left -= limits[above].sum()
        free &= ~above
    return target


def highest_quotients(votes: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: one seat after the other to the highest votes / (2 * seats so far + 1).

    Found from the divisor that gives nearly all seats; the quotients next to it
    decide the last ones, equal quotients in the order of ``votes``.
    """
    votes = np.asarray(votes, dtype=float)
    given = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or not (votes > 0).any():
        return given
    low, high = 0.0, 2.0 * votes.max() + 1.0  # at a divisor of `high` nobody has a seat
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if np.floor(votes / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    given = np.floor(votes / high + 0.5).astype(np.int64)
    while (left := seats - int(given.sum())) > 0:
        order = np.argsort(-(votes / (2 * given + 1)), kind="stable")[:left]
        given[order[votes[order] > 0]] += 1
    return given


def source_plan(sizes: DataFrame, weights: tuple[float, ...], most: float, block_words: int) -> DataFrame:
    """(source, source_size, target, blocks) from (source, source_size).

    One row per source, in one small task: ranks and the sharing need all of them.
    """

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("source", na_position="last", key=lambda s: s.map(lambda x: x if x is None else x.encode())).reset_index(drop=True)
        size = frame["source_size"].to_numpy(dtype=np.int64)
        frame["target"] = targets_of(size, np.resize(np.array(weights, dtype=float), len(size)), most)
        frame["blocks"] = highest_quotients(frame["target"].to_numpy(), round(float(frame["target"].sum()) / block_words))
        return frame

    return sizes.groupBy().applyInPandas(plan, "source string, source_size long, target double, blocks long")


def shard_quotas(shards: DataFrame, block_words: int) -> DataFrame:
    """(source, shard, quota) from (source, shard, words, blocks): one task per source, a row per shard."""

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        frame["quota"] = highest_quotients(frame["words"].to_numpy(dtype=float), int(frame["blocks"].iloc[0]))
        return frame[["source", "shard", "quota"]]

    return shards.groupBy("source").applyInPandas(deal, "source string, shard long, quota long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is how many of the document's words the mix takes, repeats counted.
    """
    sized = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_col).alias("draw"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    plan = store(source_plan(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, block_words), "mix-plan")
    per_shard = block_words * shard_blocks
    with_plan = sized.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parts = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.floor(F.col("source_size") / per_shard)))
    with_plan = with_plan.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), parts))
    shards = with_plan.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = shard_quotas(shards, block_words)
    shards = shards.join(
        quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "quota"), F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at"))
    )
    # Whole passes, then `chosen` of the shard's `full` blocks; what is left of a pass goes by blocks.
    wanted = F.least(F.col("quota") * block_words, F.col("words") * most)
    full = F.greatest(F.lit(1), F.floor(F.col("words") / block_words))
    shards = shards.select(
        F.col("of"), F.col("at"), "words",
        F.when(F.col("words") > 0, F.floor(wanted / F.col("words"))).otherwise(0).alias("passes"),
        full.alias("full"),
        F.when(F.col("words") > 0, F.round((wanted % F.greatest(F.col("words"), F.lit(1))) / F.greatest(F.lit(1.0), F.col("words") / full) )).otherwise(0).cast("long").alias("chosen"),
    )
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "of", "at"), F.col("full"))
    shards = store(shards.withColumn("start", start), "mix-shards")
    order = Window.partitionBy("source", "shard").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = with_plan.withColumn("end", F.sum("size").over(order))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))

    def before(word: Column) -> Column:
        """Words of chosen blocks in front of a place of the shard; block k is chosen if the count steps up at it."""
        length = F.col("words") / F.col("full")
        block = F.least(F.floor(word / length), F.col("full") - 1)
        count = lambda k: F.floor((k * F.col("chosen") + F.col("start")) / F.col("full"))
        return count(block) * length + (count(block + 1) - count(block)) * (word - block * length)

    part = F.when(F.col("size") > 0, F.round(before(F.col("end"))) - F.round(before(F.col("end") - F.col("size")))).otherwise(0)
    taken = F.least(F.col("passes") * F.col("size") + F.greatest(part, F.lit(0)), F.col("size") * most)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
