"""Token ids in binary files, coded with Simple-8b.

Documents are dealt to files by ranges of their ids, encoded with a public tokenizer and
written in ascending order as raw bytes through Spark's own file commit, so that a lost
executor leaves no half file and any store that Spark writes to will do.

A file is a row of segments; all numbers are little-endian words of 64 bits:

    magic, documents, ids, blocks, code words, exceptions, first-is-continued, crc32
    per document: id; 1 if the id is known, 0 if it is null; ids in this segment
    per block: its first code word; its first exception
    code words; exceptions; end mark

A code word has a selector in its upper four bits, which says how many ids of how many
bits follow from the lowest bit on.  Selector 0 is an escape: the word holds the place of
an id of more than 60 bits among the exceptions of its block.  A block begins with every
``BLOCK``-th id of a segment and is decoded by itself; all words of a segment are decoded
at once, one selector after the other.

Definitions
* Documents are in order of their ids, null last; of equal ids, by a hash of the text, then
  as they were read.  Repeated rows are documents of their own.
* Null is an empty text; an empty text has its end id only.
* A file holds whole documents, as many as come to ``FILE_BYTES`` of text on average.  A
  long document takes several segments.
* An empty table gives files without segments and no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.llm import tokens as T

# Fixed values of the format: ids in a code word and bits of each, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = int.from_bytes(b"S8BTOK01", "little")
END_MARK = "S8B-END\n"
HEADER = 8

#: Ids of a block.
BLOCK = 16_384
#: Ids of a segment, at most; some 500 KB as code words.
SEGMENT = 16 * BLOCK
#: Bytes of text per file.
FILE_BYTES = 16 << 20
#: Bytes of text that are encoded at once, whole documents only.
PIECE = 2 << 20
#: Encoded words that a task remembers, some 50 bytes each.
MOST_KNOWN = 300_000

_U = np.uint64
#: What a byte may be, as bits: seen; first of U+00C0 to U+07FF, none of which is white space;
#: first of U+00C0 to U+024F, letters but for two signs; a letter; a digit; a stop.
_VISIBLE, _TWO, _LATIN, _LETTER, _DIGIT, _STOP = (1 << k for k in range(6))
#: Second bytes of the two signs, after 0xC3.
_SIGNS = b"\x97\xb7"


def _byte_kinds() -> bytes:
    kinds = bytearray(256)
    letters = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for bit, members in (
        (_VISIBLE, range(0x21, 0x7F)), (_TWO, range(0xC3, 0xE0)), (_LATIN, range(0xC3, 0xC9)),
        (_LETTER, letters), (_DIGIT, b"0123456789"), (_STOP, b".,;:!?"),
    ):
        for byte in members:
            kinds[byte] |= bit
    return bytes(kinds)


_KINDS = _byte_kinds()
#: The same letters as characters, a space perhaps ahead.
_LETTERS_ALONE = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u023f]+$"


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level BPE: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(unseen)}


_AS_CHARACTER = _byte_characters()


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a unit may begin at each byte (see ``Encoder``)."""
    begins = np.zeros(len(data), dtype=bool)
    if len(data) < 2:
        return begins
    # All bytes are looked up at once, each by a table in one go.
    kind = np.frombuffer(data.tobytes().translate(_KINDS), dtype=np.uint8)
    is_ = lambda bits: (kind & bits) != 0
    latin = np.append(False, is_(_LATIN)[:-1])
    latin[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == _SIGNS[0]) | (data[1:] == _SIGNS[1])))
    # By the last byte of a character, and by its first one.
    solid, opens = is_(_VISIBLE), is_(_VISIBLE | _TWO)
    solid[1:] |= is_(_TWO)[:-1]
    plain, digit = is_(_LETTER), is_(_DIGIT)
    letter = plain | latin
    between = solid[:-2] & opens[2:]
    begins[1:-1] |= (data[1:-1] == 32) & between
    begins[2:] |= (data[1:-1] == 10) & between
    begins[1:] |= is_(_STOP)[1:] & (letter | digit)[:-1]
    begins[1:] |= digit[1:] & letter[:-1]
    begins[1:] |= plain[1:] & digit[:-1]
    return begins


def takes_words_alone(tokenizer: dict) -> bool:
    """Whether a tokenizer, as its file describes it, may be given the units between cuts one by one."""
    split = tokenizer.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    model = tokenizer.get("model") or {}
    if not usual or tokenizer.get("normalizer") or model.get("type", "BPE") != "BPE" or model.get("dropout"):
        return False
    added = [t["content"] for t in tokenizer.get("added_tokens") or []]
    return not any(cuts(np.frombuffer(t.encode(), dtype=np.uint8)).any() or re.search(_LETTERS_ALONE, t) for t in added)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code words, exceptions) of unsigned 64-bit ids."""
    n = len(ids)
    longer = np.zeros(n + 60, dtype=_U)
    longer[:n] = ids
    selector = np.zeros(n, dtype=np.int64)
    # Later selectors hold more ids; what is beyond the end counts as zeros.
    # What does not fit a selector fits no later one, whose ids are more and shorter.
    alive = np.arange(n)
    for s in range(len(COUNTS) - 1, 0, -1):
        wide = longer >> _U(WIDTHS[s]) != 0
        if wide.any():
            if 8 * len(alive) > n:
                before = np.zeros(n + 61, dtype=np.int32)
                np.cumsum(wide, out=before[1:])
                fits = before[alive + COUNTS[s]] == before[alive]
            else:
                fits = ~wide[alive[:, None] + np.arange(COUNTS[s])].any(axis=1)
            alive = alive[fits]
        selector[alive] = s
        if not len(alive):
            break
    # Words begin where one follows the other from the first id on: all places reached in
    # 1, 2, 4, ... steps, instead of step by step.
    begins, step = np.zeros(n + 1, dtype=bool), np.minimum(np.arange(n + 1) + np.append(COUNTS[selector], 0), n)
    begins[0] = True
    reached = 0
    while reached < (reached := int(np.count_nonzero(begins))):
        begins[step[begins]] = True
        step = step[step]
    at = np.flatnonzero(begins[:n])
    chosen = selector[at]
    words = chosen.astype(_U) << _U(60)
    for s in np.flatnonzero(np.bincount(chosen)):
        here = np.flatnonzero(chosen == s)
        if s == 0:
            words[here] = np.arange(len(here), dtype=_U)
        else:
            many = np.arange(COUNTS[s])
            words[here] |= np.bitwise_or.reduce(longer[at[here][:, None] + many] << (many * WIDTHS[s]).astype(_U), axis=1)
    return words, longer[at[chosen == 0]]


def unpack(words: np.ndarray, exceptions: np.ndarray, first_words: np.ndarray, first_exceptions: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of blocks of code words."""
    selector = (words >> _U(60)).astype(np.int64)
    if (selector >= len(COUNTS)).any():
        raise ValueError("a code word with an unknown selector")
    blocks = len(first_words)
    of = np.repeat(np.arange(blocks), np.diff(np.append(first_words, len(words))))
    begins = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    # A block may end in zeros that fill its last word: rows are wider than a block by as much.
    out = np.zeros((blocks, block + 60), dtype=_U)
    place = begins - begins[first_words][of] + of * (block + 60) if blocks else begins
    flat = out.reshape(-1)
    payload = words & _U((1 << 60) - 1)
    for s in np.flatnonzero(np.bincount(selector)):
        here = np.flatnonzero(selector == s)
        if s == 0:
            flat[place[here]] = exceptions[payload[here].astype(np.int64) + first_exceptions[of[here]]]
        else:
            many = np.arange(COUNTS[s])
            flat[place[here][:, None] + many] = (payload[here][:, None] >> (many * WIDTHS[s]).astype(_U)) & _U((1 << int(WIDTHS[s])) - 1)
    return out[:, :block].reshape(-1)[:n]


def segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, continued: bool) -> bytes:
    """One segment of a file."""
    packed = [pack(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    words = np.concatenate([w for w, _ in packed]) if packed else np.zeros(0, dtype=_U)
    exceptions = np.concatenate([e for _, e in packed]) if packed else np.zeros(0, dtype=_U)
    first = lambda k: np.cumsum([0, *[len(p[k]) for p in packed[:-1]]])[: len(packed)]
    body = b"".join(
        np.ascontiguousarray(x, dtype=kind).tobytes()
        for x, kind in (
            ([0 if d is None else d for d in doc_ids], "<i8"), ([d is not None for d in doc_ids], "<u8"), (counts, "<u8"),
            (first(0), "<u8"), (first(1), "<u8"), (words, "<u8"), (exceptions, "<u8"),
        )
    )
    head = [MAGIC, len(doc_ids), len(ids), len(packed), len(words), len(exceptions), int(continued), zlib.crc32(body)]
    return np.array(head, dtype="<u8").tobytes() + body


def segments(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, bool]]:
    """(document ids, ids per document, ids, first is continued) of each segment of a file."""
    at, mark = 0, END_MARK.encode()
    while at < len(content):
        if len(content) < at + 8 * HEADER:
            raise ValueError("a token file is cut off")
        magic, n_docs, n_ids, n_blocks, n_words, n_exceptions, continued, crc = np.frombuffer(content, "<u8", HEADER, at).tolist()
        end = at + 8 * (HEADER + 3 * n_docs + 2 * n_blocks + n_words + n_exceptions)
        if magic != MAGIC or content[end : end + len(mark)] != mark or zlib.crc32(memoryview(content)[at + 8 * HEADER : end]) != crc:
            raise ValueError("a token file is damaged")
        cuts = np.cumsum([HEADER, n_docs, n_docs, n_docs, n_blocks, n_blocks, n_words, n_exceptions]).tolist()
        part = [np.frombuffer(content, "<u8", b - a, at + 8 * a) for a, b in zip(cuts, cuts[1:], strict=False)]
        doc_ids = [int(d) if known else None for d, known in zip(part[0].view("<i8"), part[1], strict=True)]
        ids = unpack(part[5], part[6], part[3].astype(np.int64), part[4].astype(np.int64), n_ids)
        yield doc_ids, part[2].astype(np.int64), ids, bool(continued)
        at = end + len(mark)


@lru_cache(maxsize=1)
def _made(tokenizer: str) -> tuple:
    """The tokenizer that a file describes, and whether it takes words alone; a worker makes it for its first task only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer), takes_words_alone(json.loads(tokenizer))


class Encoder:
    """Encodes columns of texts.  With ``words_alone``, every distinct word is encoded once.

    A text is cut where byte-level BPE with the usual pattern never joins anything across:
    before a single space and after a single line feed between two characters that are no
    white space, between a letter and a digit, and between either and one of ``.,;:!?``.
    What lies between two cuts is a unit of its own.  A unit of letters alone, perhaps with a
    space ahead, is one word of the pattern and goes to the tokenizer's model directly; any
    other unit goes through the whole tokenizer.  Tokenizers of another kind, and those
    with an added token that a cut would part or that letters could spell, take whole texts.
    """

    def __init__(self, tokenizer: str, words_alone: bool) -> None:
        self.tokenizer, alone = _made(tokenizer)
        self.words_alone = words_alone and alone
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.sizes, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        if not words:
            return []
        # Letters hold no line feed, so all words are turned into characters at once.
        spelled = "\n".join(words).encode().decode("latin-1").translate(_AS_CHARACTER).split(chr(_AS_CHARACTER[10]))
        tokenize = self.tokenizer.model.tokenize
        return [[token.id for token in tokenize(w)] for w in spelled]

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Add ids of words that are not known; the place of each."""
        plain = np.zeros(len(words), dtype=bool)
        if self.words_alone:
            plain = pc.match_substring_regex(words, _LETTERS_ALONE).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        found = self._letters(words.filter(pa.array(plain)).to_pylist()) + self._whole(words.filter(pa.array(~plain)).to_pylist())
        place = np.empty(len(words), dtype=np.int64)
        place[order] = len(self.known) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, words.take(pa.array(order))])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32)])
        return place

    def _encoded(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct word among the known ones."""
        if len(self.known) > MOST_KNOWN or not self.words_alone:
            self._forget()
        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new := np.flatnonzero(place < 0)):
            place[new] = self._learn(words.take(pa.array(new)))
        return place

    def __call__(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ids per row) of runs of rows; each row ends in ``end_id``."""
        for first, end, data, offsets in T.pieces(column, PIECE):
            begins = cuts(data) if self.words_alone else np.zeros(len(data), dtype=bool)
            begins[offsets[:-1][np.diff(offsets) > 0]] = True
            begins = np.flatnonzero(begins)
            edges = np.append(begins, len(data)).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            of = self._encoded(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
            per_word = self.sizes[of]
            until = np.cumsum(per_word)
            total = int(until[-1]) if len(until) else 0
            source = np.repeat((np.cumsum(self.sizes) - self.sizes)[of] - (until - per_word), per_word) + np.arange(total)
            before = np.append(0, until)[np.searchsorted(begins, offsets)]
            rows = end - first
            ids = np.full(total + rows, end_id, dtype=np.uint32)
            ids[np.arange(total) + np.repeat(np.arange(rows), np.diff(before))] = self.flat[source]
            yield first, end, ids, np.diff(before) + 1


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, words_alone: bool = True, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text of ``docs`` and write the files to the folder ``path``.

    The tokenizer's file is read here and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_last("id"), F.xxhash64("text"), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, words_alone)
        names: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size, continued = 0, False

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(names, counts, np.concatenate(held), continued)], pa.binary())], ["value"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, ids, per_row in encode(batch.column(1), end_id):
                ends = np.cumsum(per_row).tolist()
                for row, until in zip(range(first, end), ends, strict=True):
                    at = until - int(per_row[row - first])
                    again = False
                    while at < until:
                        take = min(until - at, SEGMENT - size)
                        if not names:
                            continued = again
                        names.append(doc_ids[row])
                        counts.append(take)
                        held.append(ids[at : at + take])
                        size, at, again = size + take, at + take, True
                        if size == SEGMENT:
                            yield flushed()
                            names, counts, held, size = [], [], [], 0
                            T.give_back()
        if names:
            yield flushed()
        del encode, held
        T.give_back()

    coded = dealt.select("id", "text").mapInArrow(code, "value binary")
    coded.select(F.col("value").cast("string")).write.mode("errorifexists").option("lineSep", END_MARK).option("compression", "none").text(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, file, place, begin, n_tokens, ids_crc32) of every document in the files at ``path``, and its ids if asked for.

    ``file`` is the number of a file, ``place`` that of a document in it, and ``begin``
    counts the ids before it in its file; ``ids_crc32`` is of the ids as little-endian
    unsigned numbers of 32 bits.
    """
    kinds = [("doc_id", pa.int64()), ("file", pa.int64()), ("place", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int64()))] if ids else []

    def batch(found: list[list]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for k in range(files.num_rows):
                number, begin, held = files.column(0)[k].as_py(), 0, []
                place = -1
                for doc_ids, counts, values, continued in segments(files.column(1)[k].as_buffer()):
                    # The last document may go on in the next segment.
                    if held and not continued:
                        yield batch(held)
                        held = []
                    elif len(held) > 1:
                        yield batch(held[:-1])
                        held = held[-1:]
                    at = 0
                    for j, (doc_id, n) in enumerate(zip(doc_ids, counts.tolist(), strict=True)):
                        own = values[at : at + n]
                        raw = own.astype("<u4").tobytes()
                        if j == 0 and continued:
                            last = held[-1]
                            last[4], last[5] = last[4] + n, zlib.crc32(raw, last[5])
                            if ids:
                                last[6] = np.concatenate([last[6], own.astype(np.int64)])
                        else:
                            place += 1
                            held.append([doc_id, number, place, begin, n, zlib.crc32(raw), *([own.astype(np.int64)] if ids else [])])
                        begin, at = begin + n, at + n
                if held:
                    yield batch(held)
                T.give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # Numbers, not names, are in order: a name has five digits at least.
    number = F.regexp_extract("path", r"part-([0-9]+)[^/]*$", 1).cast("long")
    schema = "doc_id long, file long, place long, begin long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return files.select(number.alias("file"), "content").mapInArrow(decode, schema)


def with_starts(found: DataFrame) -> DataFrame:
    """``found`` of ``read_tokens`` with ``start``: the ids of all documents before it in all files.

    One task adds up one number per file.
    """
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return found.join(starts, "file").withColumn("start", F.col("earlier") + F.col("begin")).drop("earlier", "begin")
