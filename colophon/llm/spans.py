"""Places of pattern matches in texts, by column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.binding import let
from colophon.functions.detect import running_total

SPAN = "array<struct<a:int,z:int,m:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def found(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost matches that do not overlap, as (a, z, m): code points from a up to z, and the match.

    A text is cut at the matches; the lengths of cuts and matches, summed block by block,
    are the places.  A text without a match is searched once only.  ``keep`` drops matches.
    """
    both = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"))
    )

    def placed(cuts: Column) -> Column:
        ends = running_total(F.transform(cuts, lambda x: x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))))
        spans = F.zip_with(cuts, ends, lambda x, z: F.struct((z - F.length(x["m"])).alias("a"), z.alias("z"), x["m"].alias("m")))
        return F.filter(spans, lambda x: x["m"].isNotNull())

    every = let(both, placed)
    if keep is not None:
        every = F.filter(every, lambda x: keep(x["m"]))
    return F.when(text.rlike(pattern), every).otherwise(none())


def tagged(spans: Column, kind: str, place: int) -> Column:
    """Spans with their kind and its place among the kinds."""
    return F.transform(spans, lambda x: F.struct(F.lit(place).alias("place"), x["a"].alias("a"), x["z"].alias("z"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["a"], x["z"])), ",")


#: Code points of a stretch, the unit by which spans of a document meet.
STRETCH = 300


def on_stretches(spans: DataFrame, a: str = "a", z: str = "z", reach: int = 0) -> DataFrame:
    """``spans`` once per ``stretch`` of their document that they, widened by ``reach``, touch."""
    first, last = F.floor((F.col(a) - reach) / STRETCH), F.floor((F.greatest(F.col(z) - 1, F.col(a)) + reach) / STRETCH)
    return spans.withColumn("stretch", F.explode(F.sequence(first, last)))


def clear_of(spans: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``spans`` (id, body, a, z, ...) that overlap none of ``others`` (id, body, a, z)."""
    one = on_stretches(spans.select("id", "body", "a", "z").distinct())
    two = on_stretches(others.select("id", "body", F.col("a").alias("a2"), F.col("z").alias("z2")).distinct(), "a2", "z2")
    met = one.join(two, ["id", "body", "stretch"]).where("a2 < z AND a < z2").select("id", "body", "a", "z").distinct()
    return spans.join(met, ["id", "body", "a", "z"], "left_anti")


def replaced(text: Column, spans: Column, tag: Callable[[Column], Column]) -> Column:
    """The text with spans (by start, not overlapping) replaced by their tags."""
    before = lambda k: F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["z"])
    until = lambda k: F.coalesce(F.get(spans, k)["a"], F.length(text))
    cut = lambda k: F.concat(F.substr(text, before(k) + 1, until(k) - before(k)), F.coalesce(tag(F.get(spans, k)), F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), cut), "")
