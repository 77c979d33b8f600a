"""Phrase collocations, mined by SON partitioning.

Documents are cut into shards that a task holds whole.  A phrase that occurs ``support``
times in a language occurs, in some shard, at least as often as the shard's share of the
language's words demands; so each shard is mined completely at its lowered support, and
the union of what the shards find misses nothing.  All of these candidates are then
counted over all shards.  Where a shard's share is so small that its lowered support is
one, its counts are complete as they are, and if that holds for all shards their sum is
the count; otherwise the texts are read again for the candidates.

Phrases grow by a word at a time: one is only looked for if its first and its last words,
one fewer, are phrases of the language.  Hashes of those are sent to the tasks as long as
there are at most ``MOST_SENT``; beyond, more phrases are counted, with the same result.

Definitions
* ``A-Z`` are lower-cased.  Pieces end at ``.,;:!?`` and at ``\\n\\v\\f\\r``, words of a piece
  at spaces and tabs; no phrase leaves its piece.  Null is an empty text.
* Everything is counted by language; a null language is ``und``, one with those so named.
* Overlapping occurrences count, repeated rows as often as they occur.
* A phrase's score is that of its worst cut in two; of equal ones the first cut counts.
* A phrase inside a longer one that takes at least half of its occurrences is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm import tokens as T
from colophon.workspace import store

UNKNOWN = "und"
SUPPORT, LONGEST, REPORTED = 10, 3, 2000
#: A phrase is dropped for a longer one with at least so many hundredths of its occurrences.
SHARE = 50
SCORE = 1_000_000
#: Bytes of text of a shard, at most; whole documents only, a longer one is a shard of its own.
SHARD_BYTES = 5 << 20
#: Hashes of phrases sent to the tasks (32 MB).
MOST_SENT = 4_000_000
#: Languages whose numbers of words are sent to the tasks; others are mined at a support of one.
MOST_LANGUAGES = 100_000
#: Rows of frequent words that are broadcast to a join.
MOST_BROADCAST = 1_000_000
_ROWS = 1 << 14

# What ends a piece, and what ends a word.
PIECE_ENDS = ".,;:!?\n\v\f\r"
WORD_ENDS = " \t"
_WORD = T.byte_class(without=PIECE_ENDS + WORD_ENDS)
_END = ~T.byte_class(without=PIECE_ENDS)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def hashes(column: pa.Array) -> np.ndarray:
    data, offsets = T.text_bytes(column)
    return T.span_hashes(data, offsets[:-1], offsets[1:])


def word_hashes(language: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a word of a language, from those of both."""
    return T.mix(language + word * _GOLDEN)


def joined_hash(one: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last, and of the last."""
    return T.mix(one * _GOLDEN + word)


def phrase_hashes(languages: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hash of each phrase of a language, words joined by a space."""
    data, offsets = T.text_bytes(phrases)
    starts, ends, first = T.word_bounds(data, offsets, _WORD)
    many, words = np.diff(first), T.span_hashes(data, starts, ends)
    words = word_hashes(np.repeat(hashes(languages), many), words)
    out = words[first[:-1]]
    for k in range(1, int(many.max(initial=0))):
        longer = np.flatnonzero(many > k)
        out[longer] = joined_hash(out[longer], words[first[:-1][longer] + k])
    return out


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them; keys are not negative."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    # One sort of keys and places together takes a third of the time.
    both = np.sort((keys << bits) | np.arange(len(keys)))
    ordered, place = both >> bits, both & ((1 << bits) - 1)
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    code = np.empty(len(keys), dtype=np.int32)
    code[place] = np.cumsum(first) - 1
    return ordered[first], code


class Shard:
    """The words of some documents, coded by language and word, and which follow each other in a piece."""

    def __init__(self, texts: pa.ChunkedArray, languages: pa.ChunkedArray) -> None:
        data, offsets = T.text_bytes(texts)
        data = T.LOWER[data]
        starts, ends, first = T.word_bounds(data, offsets, _WORD)
        lengths = ends - starts
        edges = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data[_WORD[data]])).dictionary_encode()
        named = languages.combine_chunks().dictionary_encode()
        self.languages, self.vocabulary = named.dictionary, words.dictionary
        self.language = np.repeat(named.indices.to_numpy(zero_copy_only=False), np.diff(first))
        spelled = words.indices.to_numpy(zero_copy_only=False)
        # A code per language and spelling, dense.
        pairs, self.codes = dense(self.language.astype(np.int64) * max(1, len(self.vocabulary)) + spelled)
        self.pair_language, self.pair_word = np.divmod(pairs, max(1, len(self.vocabulary)))
        self.pair_hash = word_hashes(hashes(self.languages)[self.pair_language], hashes(self.vocabulary)[self.pair_word])
        piece = np.searchsorted(np.flatnonzero(_END[data]), starts)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        #: Whether the next word goes on with this one's piece.
        self.goes_on = np.zeros(len(starts), dtype=bool)
        self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])

    def words_of(self) -> np.ndarray:
        """How many words each language has here."""
        return np.bincount(self.language, minlength=len(self.languages))

    def phrases(self, size: int, known: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each phrase as codes, occurrences, language) of the phrases of ``size`` words.

        ``known[k]`` are the sorted hashes of the phrases of k + 1 words that a longer one may
        begin and end with, or None for all.
        """
        words, hashes, span = np.arange(len(self.pair_hash), dtype=np.int32)[:, None], self.pair_hash, max(1, len(self.pair_hash))
        run = self.codes  # the phrase that begins at each word, or -1
        for k in range(1, size):
            if known[k - 1] is not None and len(run):
                run = np.where(np.append(np.isin(hashes, known[k - 1]), False)[run], run, -1)
            at = np.flatnonzero((run[:-1] >= 0) & (run[1:] >= 0) & self.goes_on[:-1])
            keys = run[at].astype(np.int64) * span + self.codes[at + k]
            pairs, key = dense(keys) if k + 1 < size else np.unique(keys, return_counts=True)
            del keys
            before, after = np.divmod(pairs, span)
            words = np.concatenate([words[before], after[:, None].astype(np.int32)], axis=1)
            if k + 1 == size:
                return words, key, self.pair_language[words[:, 0]]
            hashes = joined_hash(hashes[before], self.pair_hash[after])
            run = np.full(len(self.codes), -1, dtype=np.int32)
            run[at] = key
        return words, np.bincount(run, minlength=len(words)), self.pair_language[words[:, 0]]

    def hashes(self, words: np.ndarray) -> np.ndarray:
        out = self.pair_hash[words[:, 0]]
        for k in range(1, words.shape[1]):
            out = joined_hash(out, self.pair_hash[words[:, k]])
        return out

    def spelled(self, words: np.ndarray) -> pa.Array:
        columns = [self.vocabulary.take(pa.array(self.pair_word[words[:, k]])) for k in range(words.shape[1])]
        return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if len(columns) > 1 else columns[0]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of (text, language) rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for row, length in enumerate(lengths.tolist()):
            if size and size + length > SHARD_BYTES:
                held.append(batch.slice(begin, row - begin))
                yield _shard(held)
                held, size, begin = [], 0, row
            size += length
        held.append(batch.slice(begin))
    if held:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]) -> Shard:
    table = pa.Table.from_batches(held)
    text = pc.cast(table.column(0), pa.large_string())  # joined, it may pass 2 GB
    return Shard(text, table.column(1))


def mine(docs: DataFrame, size: int, known: list[np.ndarray | None], words: dict[str, int], support: int, only: np.ndarray | None = None) -> DataFrame:
    """(language, phrase, n, own) of the phrases of each shard at its lowered support; ``own`` counts its words of the language.

    ``words`` are the words of each language in all shards; a language that is not in it is
    mined at a support of one.  ``only``, sorted hashes, limits what is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_for = [*known, only]
        for shard in shards(batches):
            found, counts, language = shard.phrases(size, looked_for)
            own = shard.words_of()
            total = [words.get(x, 0) for x in shard.languages.to_pylist()]
            lowered = np.array([max(1, -(-support * n // t)) if t else 1 for n, t in zip(own.tolist(), total, strict=True)], dtype=np.int64)
            given = counts >= lowered[language]
            if only is not None:
                given &= np.isin(shard.hashes(found), only)
            given = np.flatnonzero(given)
            for at in range(0, len(given), _ROWS):
                part = given[at : at + _ROWS]
                of = language[part]
                yield pa.RecordBatch.from_arrays(
                    [pc.cast(shard.languages.take(pa.array(of)), pa.string()), pc.cast(shard.spelled(found[part]), pa.string()), pa.array(counts[part], pa.int64()), pa.array(own[of], pa.int64())],
                    ["language", "phrase", "n", "own"],
                )
            del shard, found, counts, language, given
            T.give_back()

    return docs.mapInArrow(run, "language string, phrase string, n long, own long")


def hashes_of(found: DataFrame) -> np.ndarray | None:
    """The sorted hashes of the phrases of ``found``, or None if there are more than MOST_SENT."""
    if found.count() > MOST_SENT:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(T.spark_int64(phrase_hashes(batch.column(0), batch.column(1))))], ["hash"])

    column = found.select("language", "phrase").mapInArrow(run, "hash long").toArrow().column(0)
    return np.unique(column.to_numpy().view(np.uint64)) if len(column) else np.zeros(0, dtype=np.uint64)


def frequent(docs: DataFrame, size: int, known: list[np.ndarray | None], words: dict[str, int], support: int) -> DataFrame:
    """(language, phrase, f) of all phrases of ``size`` words that occur ``support`` times in their language.

    ``words`` is empty if the lowered support of every shard is one.
    """
    union = mine(docs, size, known, words, support).groupBy("language", "phrase").agg(F.sum("n").alias("f"))
    if words:
        union = store(union.select("language", "phrase"), "collocation-candidates")
        every = mine(docs, size, known, {}, support, hashes_of(union)).join(union, ["language", "phrase"], "left_semi")
        union = every.groupBy("language", "phrase").agg(F.sum("n").alias("f"))
    return store(union.where(F.col("f") >= support), f"collocation-{size}")


def part(phrase: Column, first: int, count: int) -> Column:
    """``count`` words of a phrase from the word ``first`` (0 is the first)."""
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, count), " ")


def scored(phrases: list[DataFrame]) -> DataFrame:
    """(language, phrase, size, a, l, r, score) of phrases of two words and more; ``phrases[k]`` has those of k + 1 words."""
    counts = [p.select("language", F.col("phrase").alias("part"), F.col("f").alias("count")) for p in phrases]
    few = [p.count() <= MOST_BROADCAST for p in counts]
    exact = "decimal(16,0)"
    every = None
    for size in range(2, len(phrases) + 1):
        rows = phrases[size - 1].select("language", "phrase", F.lit(size).alias("size"), F.col("f").alias("a"))
        for k in range(1, size):
            for name, first, many in (("l", 0, k), ("r", k, size - k)):
                known = counts[many - 1].withColumnRenamed("count", f"{name}{k}")
                rows = rows.withColumn("part", part(F.col("phrase"), first, many)).join(F.broadcast(known) if few[many - 1] else known, ["language", "part"]).drop("part")
        cut = lambda k: F.struct(
            F.expr(f"{SCORE}BD * (CAST(a AS {exact}) * CAST(a AS {exact})) div (CAST(l{k} AS {exact}) * CAST(r{k} AS {exact}))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")
        )
        rows = rows.withColumn("worst", F.array_min(F.array(*[cut(k) for k in range(1, size)]))).select("language", "phrase", "size", "a", "worst.l", "worst.r", "worst.score")
        every = rows if every is None else every.unionByName(rows)
    return every


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, reported: int = REPORTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``reported`` phrases of each language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("language"))
    counted = store(mine(rows, 1, [], {}, support).groupBy("language", "phrase").agg(F.sum("n").alias("f"), F.max("own").alias("own")), "collocation-words")
    totals = store(counted.groupBy("language").agg(F.sum("f").alias("n"), F.max("own").alias("largest")), "collocation-totals")
    # A shard's lowered support passes one if its share of the words passes 1 / support.
    lowered = not totals.where(F.col("largest") * support > F.col("n")).isEmpty() and totals.count() <= MOST_LANGUAGES
    words = {r["language"]: r["n"] for r in totals.collect()} if lowered else {}
    phrases = [store(counted.where(F.col("f") >= support).drop("own"), "collocation-1")]
    known = [hashes_of(phrases[0])]
    for size in range(2, longest + 1):
        phrases.append(frequent(rows, size, known, words, support))
        known.append(hashes_of(phrases[-1]) if size < longest else None)
    found = store(scored(phrases), "collocation-scored")
    # The most frequent longer phrase that each phrase stands in.
    inner = None
    for size in range(3, longest + 1):
        for many in range(2, size):
            for first in range(size - many + 1):
                one = found.where(F.col("size") == size).select("language", part(F.col("phrase"), first, many).alias("phrase"), F.col("a").alias("longer"))
                inner = one if inner is None else inner.unionByName(one)
    if inner is not None:
        most = inner.groupBy("language", "phrase").agg(F.max("longer").alias("longer"))
        found = found.join(most, ["language", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
    place = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= reported)
    return top.join(totals.drop("largest"), "language").select(F.col("language").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
