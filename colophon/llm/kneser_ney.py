"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts n-grams of whole characters (``CHARACTERS``) or of words and marks
(``WORDS``); nothing is folded, so it grows with the text.  Its counts, counts of counts,
context totals and lower orders are tables, grouped and joined by n-gram and context, and
spread over the cluster.  The logarithm of a probability is a sum of one value per order:

    log p(w | h) = log p0 + log g0 + sum over k of V(the k-gram that ends here)

where V(x) is what seeing x gains over its shorter suffix, plus what x leaves, as the
context of the next symbol, to the lower order; an n-gram that was never seen has V = 0.
So a document's score is a join of its n-grams to one table (n-gram, V).  The most frequent
n-grams, ``MOST_SENT`` at most, are sent to the tasks; all others are counted within their
document first and then joined by shuffle, free of the keys that would be hot.

Trusted documents are dealt to two folds by their text, and each document is scored by the
model of the other fold, so no document, nor a copy of it, is judged by a model that has
read it.

A document is accepted if its deviation lies within limits of its language: the ``TAIL``
and ``1 - TAIL`` quantiles of the deviations of trusted documents.  The deviation is how far
the bits per symbol are from the median of the language, in units of the spread that trusted
documents of that length have (variance = a + b / symbols, fitted over them).  Medians and
quantiles of a language with n trusted documents weigh n against ``BLEND`` of all languages.

Definitions
* A text without a symbol (null, empty; in words: white space only) has no perplexity and is not accepted.
* Languages are told apart as given, null is one of them; one without trusted documents
  takes the limits of all languages together.
* Without trusted text there is no model: no perplexity, and all is accepted.
* Each row is judged by its text and language; repeated rows and further columns are kept.
* Texts are told apart by two hashes of 64 bits, n-grams in the join by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm import tokens as T
from colophon.llm.rows import fresh
from colophon.workspace import store

FOLDS = 2
TAIL = 0.005
#: Trusted documents that the limits of all languages together count for in those of one.
BLEND = 20
#: n-grams sent to the tasks, 12 bytes each; the others are joined by shuffle.
MOST_SENT = 4_000_000
#: Ids and texts that are broadcast to filter documents, counted first; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Bytes of text whose n-grams are counted at once.
PIECE = 4 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Symbols before and after each text; no character has them.
BEGIN, END = _U(0xFFFFFE), _U(0xFFFFFF)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(_U)
    reach = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    return symbols, np.diff(reach)


def _word_classes() -> np.ndarray:
    """0 white space, 1 marks, 2 letters, digits and all bytes beyond ASCII."""
    table = np.where(T.PLAIN_WORD, 1, 0).astype(np.uint8)
    table[128:] = 2
    table[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
    return table


_CLASS = _word_classes()


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    real = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][real], edges[1:][real]
    return T.span_hashes(data, starts, ends) | _U(1 << 63), np.diff(np.searchsorted(starts, offsets))


@dataclass(frozen=True)
class Unit:
    """Symbols of a text: how they are read, bytes of one, and the order of the model."""

    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    width: int
    order: int


CHARACTERS = Unit(_characters, 3, 5)
WORDS = Unit(_words, 8, 2)


def line_of(unit: Unit, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each between ``order - 1`` begins and an end; rows that have some, place of the last begin, symbols.

    The line has one more symbol ahead, so that every place has an n-gram.
    """
    symbols, sizes = unit.read(data, offsets)
    rows = np.flatnonzero(sizes)
    sizes = sizes[rows]
    last = unit.order - 1 + np.cumsum(sizes + unit.order) - (sizes + unit.order)
    line = np.full(1 + int((sizes + unit.order).sum()), BEGIN, dtype=_U)
    line[0] = END
    at = np.arange(len(symbols)) + np.repeat(last + 1 - (np.cumsum(sizes) - sizes), sizes)
    line[at] = symbols
    line[last + sizes + 1] = END
    return line, rows, last, sizes


def longer_keys(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their suffixes and the symbols ahead."""
    x = symbols * _ODD
    x += keys
    x += _U(1)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(folds: np.ndarray) -> np.ndarray:
    return T.mix(folds.astype(_U) + _U(1))


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS))


def _places_and_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, and how often it occurs; hashed, not sorted."""
    coded = pa.array(keys).dictionary_encode()
    of = coded.indices.to_numpy()
    where = np.empty(len(coded.dictionary), dtype=np.int64)
    where[of] = np.arange(len(keys))
    return where, np.bincount(of, minlength=len(where))


def ngram_counts(texts: DataFrame, unit: Unit) -> DataFrame:
    """(fold, g, c, r) of the highest order: the n-gram as bytes, and how often it occurs, twice; ``texts`` has text."""
    n = unit.order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(0).to_numpy()
            for first, _, data, offsets in T.pieces(batch.column(1), PIECE):
                line, rows, last, sizes = line_of(unit, data, offsets)
                many = sizes + 1
                at = np.arange(many.sum()) + np.repeat(last + 1 - (np.cumsum(many) - many), many)
                fold = np.repeat(folds[first + rows], many)
                key = seeds(fold)
                for k in range(n):
                    key = longer_keys(key, line[at - k])
                where, c = _places_and_counts(key)
                grams = np.ascontiguousarray(line[at[where][:, None] + np.arange(1 - n, 1)])
                raw = np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(len(c), n, 8)[:, :, : unit.width])
                ends = np.arange(len(c) + 1, dtype=np.int32) * (n * unit.width)
                found = pa.BinaryArray.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(fold[where]), found, pa.array(c)], ["fold", "g", "c"])
        T.give_back()

    rows = texts.select(fold_of(F.col("text")).cast("long").alias("fold"), "text").where(F.length("text") > 0)
    found = rows.mapInArrow(count, "fold long, g binary, c long")
    return found.groupBy("fold", "g").agg(F.sum("c").alias("c")).withColumn("r", F.col("c"))


def discounts(grams: DataFrame) -> DataFrame:
    """(fold, d1, d2, d3, kinds): discounts of n-grams seen once, twice, more often, from counts of counts."""
    n = [F.sum((F.col("c") == k).cast("double")) for k in (1, 2, 3, 4)]
    found = grams.groupBy("fold").agg(*[x.alias(f"n{k + 1}") for k, x in enumerate(n)], F.count("*").alias("kinds"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        usable = (F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0)
        return F.when(usable, F.least(F.greatest(value, F.lit(0.1)), F.lit(k - 0.05))).otherwise(k / 2).alias(f"d{k}")

    return found.select("fold", *[discount(k) for k in (1, 2, 3)], "kinds")


@dataclass
class Model:
    """(n, fold, g, r, v) of every n-gram and context, and what each symbol costs before any of them, by fold."""

    values: DataFrame
    base: dict[int, float]
    unit: Unit


def train(texts: DataFrame, unit: Unit = CHARACTERS) -> Model:
    """The model of ``texts`` (text); its base is empty without text."""
    n, width = unit.order, unit.width
    grams = [store(ngram_counts(texts, unit), "kn-grams")]
    for k in range(n - 1, 0, -1):
        # Below the highest order the counts are how many symbols an n-gram follows.
        shorter = F.substring("g", width + 1, k * width)
        grams.append(store(grams[-1].groupBy("fold", shorter.alias("g")).agg(F.count("*").alias("c"), F.sum("r").alias("r")), "kn-grams"))
    orders: list[DataFrame] = []
    contexts: list[DataFrame] = []
    lower = None
    for k, found in enumerate(reversed(grams), start=1):
        # Two rows of discounts, one per fold.
        found = found.join(F.broadcast(discounts(found)), "fold").withColumn("context", F.substring("g", 1, (k - 1) * width))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        found = found.withColumn("cut", cut)
        totals = found.groupBy("fold", "context").agg(
            F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("gamma"), F.sum("r").alias("rc"), F.first("kinds").alias("kinds")
        )
        contexts.append(store(totals, "kn-contexts"))
        joined = found.drop("kinds").join(contexts[-1].drop("rc"), ["fold", "context"])
        if lower is None:
            joined = joined.withColumn("q", 1 / (F.col("kinds") + 1))
        else:
            suffix = F.substring("g", width + 1, (k - 1) * width)
            joined = joined.withColumn("suffix", suffix).join(lower.select("fold", F.col("g").alias("suffix"), F.col("p").alias("q")), ["fold", "suffix"])
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("q")
        lower = store(joined.select("fold", "g", "r", p.alias("p"), (F.log2(p) - F.log2("q") - F.log2("gamma")).alias("a")), "kn-p")
        orders.append(lower)
    tables = []
    for k, table in enumerate(orders, start=1):
        table = table.select("fold", "g", "r", "a")
        if k < n:
            left = contexts[k].select("fold", F.col("context").alias("g"), "gamma", "rc")
            table = table.join(left, ["fold", "g"], "full").select(
                "fold", "g", F.coalesce("r", "rc").alias("r"), (F.coalesce("a", F.lit(0.0)) + F.coalesce(F.log2("gamma"), F.lit(0.0))).alias("a")
            )
        tables.append(table.select(F.lit(k).alias("n"), "fold", "g", "r", F.col("a").alias("v")))
    values = tables[0]
    for table in tables[1:]:
        values = values.unionByName(table)
    base = {r["fold"]: float(np.log2(r["gamma"] / (r["kinds"] + 1))) for r in contexts[0].collect()}
    return Model(store(values, "kn-values"), base, unit)


def with_keys(values: DataFrame, unit: Unit) -> DataFrame:
    """(n, key, suffix, v): n-grams and their suffixes as numbers, the fold included."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            key, suffix = np.zeros(len(n), dtype=_U), np.zeros(len(n), dtype=_U)
            data, offsets = T.text_bytes(batch.column(2))
            for k in np.unique(n):
                here = np.flatnonzero(n == k)
                symbols = np.zeros((len(here), k, 8), dtype=np.uint8)
                symbols[:, :, : unit.width] = data[offsets[here][:, None] + np.arange(k * unit.width)].reshape(len(here), k, unit.width)
                symbols = symbols.view("<u8")[:, :, 0].astype(_U)
                own = seeds(batch.column(1).to_numpy()[here])
                for j in range(k - 1, -1, -1):
                    suffix[here] = own
                    own = longer_keys(own, symbols[:, j])
                key[here] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64)), pa.array(suffix.view(np.int64)), batch.column(3)], ["n", "key", "suffix", "v"])

    return values.select("n", "fold", "g", "v").mapInArrow(number, "n int, key long, suffix long, v double")


class Table:
    """Numbers by 64-bit keys, found by the upper bits of a key and then one by one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = _U(64 - bits)
        # One more key and value, so that every place can be looked at.
        self.keys, self.values = np.append(keys[order], _U(0)), np.append(values[order], values.dtype.type(0))
        self.first = np.searchsorted(keys[order] >> self.shift, np.arange((1 << bits) + 1, dtype=_U)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is among the keys, and where."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at = self.first[bucket]
        end = self.first[bucket + 1]
        hit = (self.keys[at] == wanted) & (at < end)
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            found = self.keys[at[left]] == wanted[left]
            hit[left[found]] = True
            left = left[~found & (at[left] + 1 < end[left])]
        return hit, at


def frequent(model: Model) -> tuple[list[Table], int]:
    """By order, sums of V over an n-gram and its suffixes, of n-grams that occur ``least`` times, and ``least``.

    ``least`` is a power of two such that there are ``MOST_SENT`` of them at most.  A suffix
    occurs as often as what it ends, so it is among them as well.
    """
    level = F.floor(F.log2(F.col("r").cast("double"))).cast("int").alias("level")
    levels = {r["level"]: r["count"] for r in model.values.groupBy(level).count().collect()}
    least, many = 64, 0
    while least > 0 and many + levels.get(least - 1, 0) <= MOST_SENT:
        least -= 1
        many += levels.get(least, 0)
    sent = with_keys(model.values.where(F.col("r") >= (1 << min(least, 62))), model.unit).toArrow()
    order, key, suffix, v = (sent.column(c).to_numpy() for c in ("n", "key", "suffix", "v"))
    out: list[Table] = []
    for k in range(1, model.unit.order + 1):
        here = np.flatnonzero(order == k)
        total = v[here].copy()
        if out:
            known, at = out[-1].find(suffix[here].view(_U))
            total[known] += out[-1].values[at[known]]
        out.append(Table(key[here].view(_U), total.astype(np.float32)))
    return out, 1 << min(least, 62)


def scores(texts: DataFrame, model: Model) -> DataFrame:
    """(body, again, bits, symbols) of every distinct text with a symbol; ``texts`` has body, again, fold and text."""
    tables, least = frequent(model)
    unit, base, whole = model.unit, [model.base.get(f) for f in range(FOLDS)], least <= 1
    shared = texts.sparkSession.sparkContext.broadcast(tables)
    del tables

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            body, again, folds = (batch.column(c).to_numpy() for c in range(3))
            for first, _, data, offsets in T.pieces(batch.column(3)):
                line, rows, last, sizes = line_of(unit, data, offsets)
                if not len(rows):
                    continue
                rows = rows + first
                many = sizes + 2
                begin = np.cumsum(many) - many
                at = np.arange(many.sum()) + np.repeat(last - begin, many)
                # A document is scored by a fold that has not read it.
                other = 1 - folds[rows]
                key, keys = np.repeat(seeds(other), many), []
                for k in range(unit.order):
                    key = longer_keys(key, line[at - k])
                    keys.append(key)
                gain, reached, left = np.zeros(len(at)), np.zeros(len(at), dtype=np.int8), np.arange(len(at))
                for k in range(unit.order, 0, -1):
                    hit, place = known[k - 1].find(keys[k - 1][left])
                    gain[left[hit]], reached[left[hit]] = known[k - 1].values[place[hit]], k
                    left = left[~hit]
                symbols = sizes + 1
                start = np.array([np.nan if b is None else b for b in base])[other]
                total = np.add.reduceat(gain, begin) + symbols * start
                nothing = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(body[rows]), pa.array(again[rows]), nothing, pa.array(symbols), pa.array(total)], ["body", "again", "key", "n", "total"]
                )
                if whole:
                    continue
                of = np.repeat(np.arange(len(rows)), many)
                rare = [(of[reached < k], keys[k - 1][reached < k]) for k in range(1, unit.order + 1)]
                doc, key = (np.concatenate([r[c] for r in rare]) for c in (0, 1))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(doc)])
                c = np.diff(np.append(new, len(doc)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(body[rows[doc[new]]]), pa.array(again[rows[doc[new]]]), pa.array(key[new].view(np.int64)), pa.array(c), pa.nulls(len(c), pa.float64())],
                    ["body", "again", "key", "n", "total"],
                )
        T.give_back()

    found = texts.select("body", "again", "fold", "text").mapInArrow(score, "body long, again long, key long, n long, total double")
    if whole:
        parts = found.select("body", "again", "n", "total")
    else:
        found = store(found, "kn-rare")
        rare = with_keys(model.values.where(F.col("r") < least), unit).select("key", "v")
        joined = found.where("key IS NOT NULL").join(rare, "key").select("body", "again", F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("v")).alias("total"))
        parts = found.where("key IS NULL").select("body", "again", "n", "total").unionByName(joined)
    # Copies add up to the same ratio as one text.
    sums = parts.groupBy("body", "again").agg(F.max("n").alias("symbols"), F.sum("n").alias("all"), F.sum("total").alias("total"))
    ratio = -F.col("total") / F.col("all")
    out = store(sums.select("body", "again", F.when(~F.isnan(ratio), ratio).alias("bits"), "symbols"), "kn-scores")
    shared.destroy()
    return out


def limits_of(trusted: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(lang, middle, low, high) and the same of all languages, with a and b, from (lang, bits, symbols) of trusted documents."""

    def quantiles(rows: DataFrame, name: str, q: list[float]) -> tuple[DataFrame, list[float | None]]:
        value = F.percentile_approx(name, q, 10000).alias("q")
        every = rows.agg(value).first()["q"] or [None] * len(q)
        own = rows.groupBy("lang").agg(value, F.count("*").alias("n"))
        mixed = [((F.col("n") * F.col("q")[k] + BLEND * F.lit(every[k])) / (F.col("n") + BLEND)).alias(f"q{k}") for k in range(len(q))]
        return own.select(F.col("lang").alias("of"), *mixed), every

    trusted = trusted.where("bits IS NOT NULL")
    middles, (middle,) = quantiles(trusted, "bits", [0.5])
    middles = store(middles, "quality-middles")
    off = trusted.join(middles, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "symbols", (F.col("bits") - F.col("q0")).alias("off"))
    fit = off.agg(F.regr_slope(F.col("off") * F.col("off"), 1 / F.col("symbols")).alias("b"), F.regr_intercept(F.col("off") * F.col("off"), 1 / F.col("symbols")).alias("a"), F.var_pop("off").alias("v")).first()
    every = {"middle": middle, "a": max(fit["a"] if fit["a"] is not None else fit["v"] or 0.0, 1e-6), "b": max(fit["b"] or 0.0, 0.0)}
    ends, (every["low"], every["high"]) = quantiles(off.select("lang", (F.col("off") / spread(every, F.col("symbols"))).alias("deviation")), "deviation", [TAIL, 1 - TAIL])
    limits = middles.withColumnRenamed("q0", "middle").join(ends.select(F.col("of").alias("of2"), F.col("q0").alias("low"), F.col("q1").alias("high")), F.col("of").eqNullSafe(F.col("of2")))
    return store(limits.select(F.col("of").alias("lang"), "middle", "low", "high"), "quality-limits"), every


def spread(every: dict[str, float], symbols: Column) -> Column:
    """How far trusted documents of so many symbols usually are from the median."""
    return F.sqrt(F.lit(every["a"]) + F.lit(every["b"]) / symbols)


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_id: str, quality: str) -> DataFrame:
    """The documents that every label calls good."""
    good = store(labels.groupBy(F.col(label_id).alias("_good")).agg(F.min(quality).alias("q")).where("q = 1 AND _good IS NOT NULL").select("_good"), "trusted-ids")
    few = good.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(good) if few else good, F.col(id_col) == F.col("_good"), "left_semi")


RESULTS = ("perplexity", "bits", "deviation", "low", "high", "accepted")


def result_names(docs: DataFrame) -> dict[str, str]:
    return {x: fresh(docs.columns, x) for x in RESULTS}


def judgements(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_id: str, quality: str, unit: Unit) -> DataFrame | None:
    """(body, again, lang) and the results of every distinct text in its language, stored; None without trusted text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.select("id", "text", "lang", *hashes(F.col("text"), "body", "again"), fold_of(F.col("text")).cast("long").alias("fold"))
    trusted = trusted_rows(rows, labels, "id", label_id, quality)
    model = train(trusted, unit)
    if not model.base:
        return None
    scored = scores(rows, model)
    limits, every = limits_of(trusted.select("lang", "body", "again").join(scored, ["body", "again"]))
    found = rows.select("body", "again", "lang").distinct().join(scored, ["body", "again"], "left")
    limits = limits.select(F.col("lang").alias("of"), *[F.col(x).alias(f"own_{x}") for x in ("middle", "low", "high")])
    found = found.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    middle, low, high = (F.coalesce(F.col(f"own_{x}"), F.lit(every[x])) for x in ("middle", "low", "high"))
    deviation = (F.col("bits") - middle) / spread(every, F.col("symbols"))
    judged = found.select(
        "body", "again", "lang", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), "bits", deviation.alias("deviation"), low.alias("low"), high.alias("high")
    )
    # A fold without trusted text judges nobody.
    unknown = F.col("bits").isNull() & F.lit(len(model.base) < FOLDS) & (F.col("body") != F.xxhash64(F.lit("")))
    return store(judged.withColumn("accepted", unknown | F.coalesce(F.col("deviation").between(F.col("low"), F.col("high")), F.lit(False))), "quality-judged")


def hashes(text: Column, body: str, again: str) -> tuple[Column, Column]:
    """Two hashes that tell texts apart."""
    return F.xxhash64(text).alias(body), F.xxhash64(F.lit("again"), text).alias(again)


def _with_hashes(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, list[str]]:
    body, again, lang = (fresh(docs.columns, x) for x in ("_body", "_again", "_lang"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *hashes(text, body, again), F.col(lang_col).cast("string").alias(lang)), [body, again, lang]


def _same(names: list[str]) -> Column:
    body, again, lang = names
    return (F.col(body) == F.col("j.body")) & (F.col(again) == F.col("j.again")) & F.col(lang).eqNullSafe(F.col("j.lang"))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_id: str = "doc_id",
    quality: str = "quality",
    unit: Unit = CHARACTERS,
) -> DataFrame:
    """``docs`` with perplexity (per symbol), bits, deviation, low, high and accepted.

    A name that ``docs`` has already gets an underscore (``result_names``).
    """
    names = result_names(docs)
    found = judgements(docs, labels, id_col, text_col, lang_col, label_id, quality, unit)
    if found is None:
        nothing = F.lit(None).cast("double")
        return docs.withColumns({names["accepted"]: F.lit(True)} | {names[x]: nothing for x in RESULTS[:-1]})
    rows, keys = _with_hashes(docs, text_col, lang_col)
    results = [F.col(f"j.{x}").alias(names[x]) for x in RESULTS]
    return rows.alias("d").join(found.alias("j"), _same(keys)).select(*[F.col(f"d.`{c}`") for c in docs.columns], *results)


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_id: str = "doc_id",
    quality: str = "quality",
    unit: Unit = CHARACTERS,
) -> DataFrame:
    """The rows of ``docs`` that are accepted, with the columns of ``docs``."""
    found = judgements(docs, labels, id_col, text_col, lang_col, label_id, quality, unit)
    if found is None:
        return docs
    gone = store(found.where("NOT accepted").select("body", "again", "lang"), "quality-gone")
    gone = (F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone).alias("j")
    rows, keys = _with_hashes(docs, text_col, lang_col)
    return rows.alias("d").join(gone, _same(keys), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
