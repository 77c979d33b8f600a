"""Toxicity by maximum-scoring segments of token log-odds.

Tokens have log-odds of toxic against other text, with a Dirichlet prior in proportion
to the whole corpus (as in "Fightin' Words" by Monroe, Colaresi and Quinn), shrunk to
the bound of their confidence interval, less a small toll per token.  What is counted is
documents with the token, so that a word repeated in one document stays one piece of
evidence.  A linear scan
(Ruzzo and Tompa) finds every maximal-scoring segment of a document.  Segments are put
on the extreme-value scale of Karlin and Altschul: ``lambda * score - log(K * tokens)``
is a Gumbel variable for text without toxic passages.  A document's evidence is the sum
of the excess of its segments on that scale; a logistic curve fitted on the labelled
rows turns it into a probability.

Sizes
* Tokens are told apart by a hash of 64 bits, and counted and weighed in tables.  Only
  those whose score is not ``-TOLL`` are looked up: up to ``MOST_TOKENS`` they are
  broadcast (16 MB), beyond, the distinct tokens of each text are joined to them.
* Labels are taken from all learning rows; their ids are broadcast up to
  ``MOST_BROADCAST``, beyond which both sides are shuffled.
* The curve is fitted on ``FIT_ROWS`` learning rows at most, those of least hash.

Definitions
* A token is a run of letters: ``a-z`` after lower-casing ``A-Z``, and bytes beyond ASCII.
* Null and empty texts have no segment and get the score of no evidence.
* Ids with several labels count as toxic if one says so; null labels are left out.
* Without learning rows of both kinds every score is 0.
* Each row is scored by itself; repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm import tokens as T
from colophon.llm.kneser_ney import MOST_BROADCAST
from colophon.llm.rows import fresh, keyed
from colophon.workspace import store

MOST_TOKENS = 1_000_000
#: Weight of the prior, in times of what is counted in the labelled documents.
PRIOR = 0.05
#: Standard deviations by which log-odds are drawn to nothing.
CONFIDENCE = 2.5
#: Taken from every token, so that a segment without toxic tokens never scores.
TOLL = 0.2
FIT_ROWS = 200_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Model(NamedTuple):
    table: DataFrame  # (token, score) where the score is not -TOLL
    known: tuple[np.ndarray, np.ndarray] | None  # the same, by token; None if there are too many
    scale: float
    shift: float
    slope: float = 0.0
    intercept: float = 0.0


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, and the first token of each document."""
    data = T.LOWER[data]
    starts, ends, first = T.word_bounds(data, offsets, _LETTER)
    return T.span_hashes(data, starts, ends).astype(np.uint64).view(np.int64), first


def scored(token: np.ndarray, known: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The score of each token; ``known`` is in order."""
    if not len(known):
        return np.full(len(token), -TOLL)
    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
    return np.where(known[at] == token, scores[at], -TOLL)


def segments(scores: np.ndarray) -> list[float]:
    """Scores of all maximal-scoring segments, by Ruzzo and Tompa.

    Runs of one sign are drawn together first; they are never split by a maximal segment.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(up, prepend=not up[0]))
    totals = np.add.reduceat(scores, edges)
    left, right, total = [], [], 0.0  # sums in front of and up to the end of each open segment
    for x in totals.tolist():
        if x <= 0:
            total += x
            continue
        l, r = total, total + x
        total = r
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j -= 1
            if j < 0 or right[j] >= r:
                break
            l = left[j]
            del left[j:], right[j:]
        left.append(l)
        right.append(r)
    return [b - a for a, b in zip(left, right, strict=True)]


def evidence(scores: np.ndarray, scale: float, shift: float) -> tuple[float, float]:
    """(excess of all segments on the extreme-value scale, greatest segment)."""
    found = segments(scores)
    if not found:
        return 0.0, 0.0
    level = shift + np.log(len(scores))
    on_scale = scale * np.array(found) - level
    return float(np.maximum(on_scale, 0.0).sum()), max(found)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n, labelled, toxic): documents with the token, those of mark 0 or 1, those of mark 1; ``docs`` is (text, mark)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_numpy()
            for begin, end, data, offsets in T.pieces(batch.column(0)):
                token, first = tokens_of(data, offsets)
                if not len(token):
                    continue
                names, at = np.unique(token, return_inverse=True)
                once = np.unique(np.repeat(np.arange(end - begin), np.diff(first)) * len(names) + at)
                at, mark = once % len(names), marks[begin:end][once // len(names)]
                counts = [pa.array(np.bincount(part, minlength=len(names))) for part in (at, at[mark >= 0], at[mark == 1])]
                yield pa.RecordBatch.from_arrays([pa.array(names), *counts], ["token", "n", "labelled", "toxic"])

    rows = docs.select("text", F.col("mark").cast("long").alias("mark"))
    return rows.mapInArrow(count, "token long, n long, labelled long, toxic long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "toxic")])


def log_odds(counts: DataFrame) -> DataFrame:
    """(token, drawn, share): log-odds drawn to nothing, and the token's share of other text."""
    sums = counts.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "labelled", "toxic")]).first()
    size, every, labelled, toxic = (float(x) for x in sums)
    whole = PRIOR * labelled
    prior = F.lit(whole / max(every + 1e-3 * size, 1e-9)) * (F.col("n") + 1e-3)
    other = F.col("labelled") - F.col("toxic")
    odds = lambda y, total: F.log(y + prior) - F.log(F.greatest(F.lit(total + whole) - y - prior, F.lit(1e-9)))
    delta = odds(F.col("toxic"), toxic) - odds(other, labelled - toxic)
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (other + prior))
    drawn = F.signum(delta) * F.greatest(F.abs(delta) - CONFIDENCE * spread, F.lit(0.0))
    return counts.select("token", drawn.alias("drawn"), ((other + prior) / max(labelled - toxic + whole, 1e-9)).alias("share"))


def scores_by_share(weighed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(score, share of other text), drawn together where scores differ by less than 0.001."""
    rows = weighed.groupBy(F.round("drawn", 3).alias("at")).agg(F.sum("share").alias("share"), F.sum(F.col("share") * F.col("drawn")).alias("drawn")).toPandas()
    share = rows["share"].to_numpy(dtype=float)
    return rows["drawn"].to_numpy(dtype=float) / share - TOLL, share


def karlin_scale(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * score)) = 1."""
    at, share = scores[share > 0], share[share > 0]
    if not (at > 0).any() or (share * at).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * at)).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * at)).sum() < 1 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of greatest likelihood with a light prior on the slope."""
    a, b = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - 1e-2 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def with_scores(docs: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """``docs`` (id, text, ...) with one more column: the (token, score) of ``table`` that occur in the text, in order."""
    rows, key, body = keyed(docs, "id", column)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in T.pieces(batch.column(2)):
                token, first = tokens_of(data, offsets)
                for k in range(len(first) - 1):
                    once = np.unique(token[first[k] : first[k + 1]])
                    row = pa.array(np.full(len(once), begin + k))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(once)], [key, body, "token"])

    each = rows.select(key, body, column).mapInArrow(split, f"{key} string, {body} long, token long").distinct()
    found = each.join(table, "token").groupBy(key, body).agg(F.array_sort(F.collect_list(F.struct("token", "score"))).alias(name))
    return rows.join(found, [key, body], "left").select(*docs.columns, name)


def measured(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` (id, text, ...) with evidence, best and tokens in place of the text."""
    names, given = [c for c in docs.columns if c != column], fresh(docs.columns, "_scores")
    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != column) + ", evidence double, best double, tokens long"
    scale, shift = model.scale, model.shift
    shared = None if model.known is None else docs.sparkSession.sparkContext.broadcast(model.known)
    if shared is None:
        docs = with_scores(docs, model.table, column, given)

    def own(batch: pa.RecordBatch, row: int, token: np.ndarray) -> np.ndarray:
        pairs = batch.column(given)[row].as_py() or []
        return scored(token, np.array([x["token"] for x in pairs], dtype=np.int64), np.array([x["score"] for x in pairs], dtype=float))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, best, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for begin, end, data, offsets in T.pieces(batch.column(column)):
                token, first = tokens_of(data, offsets)
                scores = None if shared is None else scored(token, *shared.value)
                for k in range(end - begin):
                    part = slice(first[k], first[k + 1])
                    mine = own(batch, begin + k, token[part]) if scores is None else scores[part]
                    total[begin + k], best[begin + k] = evidence(mine, scale, shift)
                sizes[begin:end] = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(total), pa.array(best), pa.array(sizes)], [*names, "evidence", "best", "tokens"]
            )

    return docs.mapInArrow(scan, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model of ``docs`` (id, text) and ``labels`` (id, toxic), learning rows only; None if one kind is missing."""
    known = labels.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = store(known, "toxic-labels")
    kinds = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (kinds.get(0) and kinds.get(1)):
        return None
    few = sum(kinds.values()) <= MOST_BROADCAST
    learning = docs.join(F.broadcast(known) if few else known, "id")
    mark = F.when(F.col("toxic").isNull(), -1).when(F.col("toxic") == 1, 1).otherwise(0)
    marked = docs.join(F.broadcast(known) if few else known, "id", "left").select("text", mark.alias("mark"))
    weighed = store(log_odds(store(token_counts(marked), "toxic-counts")), "toxic-weighed")
    table = store(weighed.where("drawn <> 0").select("token", (F.col("drawn") - TOLL).alias("score")), "toxic-scores")
    frame = table.toPandas().sort_values("token") if table.count() <= MOST_TOKENS else None
    arrays = None if frame is None else (frame["token"].to_numpy(), frame["score"].to_numpy())
    model = Model(table, arrays, karlin_scale(*scores_by_share(weighed)), 0.0)
    # K * tokens * exp(-lambda * x) segments above x are expected in other text: K from how many there are.
    fit = fit_rows(learning, model)
    other = fit[fit["toxic"] == 0]
    x = float(other.loc[other["best"] > 0, "best"].median()) if (other["best"] > 0).any() else 0.0
    shift = float(np.log(((other["best"] > x).sum() + 0.5) / max(1, other["tokens"].sum()))) + model.scale * x
    model = model._replace(shift=shift)
    fit = fit_rows(learning, model)
    slope, intercept = logistic(np.log1p(fit["evidence"].to_numpy()), fit["toxic"].to_numpy(dtype=float))
    return model._replace(slope=slope, intercept=intercept)


def fit_rows(learning: DataFrame, model: Model) -> pd.DataFrame:
    """The FIT_ROWS measured learning rows of least hash."""
    return measured(learning, model).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(FIT_ROWS).toPandas()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(id, evidence, tokens, score) for ``docs`` (id, text)."""
    if model is None:
        return docs.select("id", F.lit(0.0).alias("evidence"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("score"))
    level = F.lit(model.slope) * F.log1p("evidence") + F.lit(model.intercept)
    return measured(docs, model).select("id", "evidence", "tokens", (1 / (1 + F.exp(-level))).alias("score"))
