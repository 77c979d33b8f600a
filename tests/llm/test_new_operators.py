"""Collocations, vector codes and token files against brute force, on rows with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.llm import collocations, token_files, vector_codes
from colophon.workspace import new_folder
from tests.llm.plain import LOWER

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def best_phrases(docs: list[tuple], support: int, first: int) -> set:
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    count: dict[str, Counter] = defaultdict(Counter)
    words_of: Counter = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang or "und"] += len(words)
            for size in (1, 2, 3):
                count[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in count.items():
        rows = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < support:
                continue
            longer = [f[p] for p in f if len(p) > len(phrase) and f[p] >= support and any(p[i : i + len(phrase)] == phrase for i in range(2))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, _, left, right = min((10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            rows.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], start=1):
            out.add((lang, rank, phrase.decode(), -a, left, right, words_of[lang], -score))
    return out


def prose(seed: int, documents: int) -> list[tuple]:
    draw = random.Random(seed)
    words = ["A", "b", "Übel", "c c", "dd", "e", "ff'", "G", "-", "h"]
    join = lambda: draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ": "])
    return [("".join(draw.choice(words) + join() for _ in range(draw.randint(0, 60))), draw.choice(["en", "en", "de", None, "und"])) for _ in range(documents)]


@pytest.mark.parametrize("size", [400, 1 << 24])
def test_collocations(spark, monkeypatch, size):
    # Shards of one size are mined at a support of one, of the other at more, and counted twice.
    monkeypatch.setattr(collocations, "SHARD_BYTES", size)
    rows = [*prose(3, 150), (None, "en"), ("", None), ("A b dd " * 500, "fr"), ("one. two. three", "xx"), *prose(3, 20), *[("hot phrase here", "en")] * 60]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n long").repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, reported=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == best_phrases(rows, 10, 40)
    assert any(r[0] == "fr" for r in got) and any(r[0] == "und" for r in got)


def test_collocations_without_pruning(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_SENT", 0)
    monkeypatch.setattr(collocations, "MOST_BROADCAST", 0)
    rows = prose(5, 80)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    got = {tuple(r) for r in collocations.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == best_phrases(rows, 10, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_scores_are_exact(spark):
    one = spark.createDataFrame([("en", "a", 10**13 + 1), ("en", "b", 10**13 + 7)], "language string, phrase string, f long")
    two = spark.createDataFrame([("en", "a b", 10**13 - 3)], "language string, phrase string, f long")
    a, left, right = 10**13 - 3, 10**13 + 1, 10**13 + 7
    assert [r["score"] for r in collocations.scored([one, two]).collect()] == [10**6 * a * a // (left * right)]


def quantised(rows: list[tuple]) -> dict:
    """(code, error) by id and the codebooks, by the definition, over (id, vector)."""
    vectors = sorted((i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows)
    length = len(vectors[0][1])
    at = [k * length // 4 for k in range(5)]
    books = [[v[a:b] for _, v in vectors[:256]] for a, b in zip(at, at[1:], strict=False)]
    near = lambda q, book: min((sum((x - y) ** 2 for x, y in zip(q, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            members = defaultdict(list)
            for _, v in vectors:
                members[near(v[at[p] : at[p + 1]], books[p])[1]].append(v[at[p] : at[p + 1]])
            for k, own in members.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = {}
    for i, v in vectors:
        found = [near(v[at[p] : at[p + 1]], books[p]) for p in range(4)]
        codes[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return {"codes": codes, "sha": hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()}


def test_vector_codes(spark):
    draw = random.Random(11)
    centres = [[draw.uniform(-1, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + draw.choice([0, 0, 0.01, -0.02]) for x in draw.choice(centres)], draw.choice(["a", "b", None])) for i in range(420)]
    odd = [(900, None, "a"), (901, [1.0] * 11 + [None], "a"), (902, [1.0] * 11 + [float("nan")], "b"), (903, [float("inf")] * 12, "b")]
    misfit = [(904, [1.0] * 5, "b"), (905, [1e300] * 12, None)]
    table = spark.createDataFrame([(*r, "x") for r in [*rows, *odd, *misfit]], "vec_id long, embedding array<double>, label string, code string").repartition(3)
    want = quantised([(i, v) for i, v, _ in rows])
    labels = Counter()
    for i, _, label in rows:
        labels[label] += want["codes"][i][1]
    expected = {(i, *want["codes"][i], labels[label], want["sha"]) for i, _, label in rows}
    expected |= {(904, None, None, labels["b"], want["sha"]), (905, None, None, labels[None], want["sha"])}
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert {tuple(r) for r in vector_codes.coded(table).select(*columns).collect()} == expected


def test_vector_codes_of_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_BROADCAST", 0)
    rows = [(i, [float(i % 7), 1.0, -2.0, 0.5], None) for i in range(60)] + [(7, [0.0, 0.0, 0.0, 0.0], 3)]
    got = vector_codes.coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got.count() == 61 and {r["label_error"] for r in got.collect()} == {0}


def test_vector_codes_of_nothing(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.coded(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.coded(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    assert vector_codes.coded(spark.createDataFrame([(1, [], 1)], kind)).count() == 1


@pytest.mark.parametrize("top", [3, 1000, 1 << 27])
def test_nearest_by_tree(top):
    draw = np.random.default_rng(top)
    entries = draw.integers(-top, top + 1, (256, 4))
    entries[100:140] = entries[3]  # ties: the least index wins
    q = np.concatenate([draw.integers(-top, top + 1, (500, 4)), entries])
    d = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in entries] for a in q]
    index, least, seen = vector_codes.nearest(vector_codes.tree(entries), q)
    assert index.tolist() == [row.index(min(row)) for row in d] and least.tolist() == [min(row) for row in d]
    assert seen < len(q) * len(entries)


def test_tree_leaves_out_subtrees():
    draw = np.random.default_rng(5)
    centres = draw.integers(-9000, 9000, (16, 8))
    entries = np.repeat(centres, 16, axis=0) + draw.integers(-50, 50, (256, 8))
    q = np.repeat(centres, 20, axis=0) + draw.integers(-50, 50, (320, 8))
    seen = vector_codes.nearest(vector_codes.tree(entries), q)[2]
    assert seen < len(q) * len(entries) / 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(1, 90))
def test_code_words_round_trip(ids, block):
    given_ids = np.array(ids, dtype=np.uint64)
    packed = [token_files.pack(given_ids[at : at + block]) for at in range(0, len(ids), block)]
    first = lambda k: np.cumsum([0, *[len(p[k]) for p in packed]])[:-1]
    join = lambda k: np.concatenate([p[k] for p in packed]) if packed else np.zeros(0, np.uint64)
    assert token_files.unpack(join(0), join(1), first(0), first(1), len(ids), block).tolist() == ids


def test_code_words_hold_many_ids():
    ones, shorts, ids = (np.full(6000, x, dtype=np.uint64) for x in (1, 200, 50_000))
    assert [len(token_files.pack(x)[0]) for x in (ones, shorts, ids)] == [100, 858, 2000]


PIECES = st.sampled_from([" ", "  ", "\n", "\t ", "a", "It's", "naïve", "日本", " ", "　", "1984", "--", "<|endoftext|>", "😀", "x" * 30, ".", "\x1f", "'s", "é", "×", "ñ", "Ж", "ɐ", "\u0301", "\u0085", "7", "B", "²", "ª", ":", "?"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_words_alone_encode_like_whole_texts(texts):
    with open(TOKENIZER, encoding="utf-8") as file:
        encode = token_files.Encoder(file.read(), True)
    got = []
    for _, _, ids, sizes in encode(pa.array(texts, pa.string()), 2):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    whole = tokenizers.Tokenizer.from_file(TOKENIZER)
    assert got == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_tokenizers_that_take_whole_texts():
    with open(TOKENIZER, encoding="utf-8") as file:
        spec = json.load(file)
    assert token_files.takes_words_alone(spec)
    added = lambda text: spec | {"added_tokens": [*spec["added_tokens"], {"content": text}]}
    assert token_files.takes_words_alone(added("<|pad|>"))
    odd = [added("pad"), added("<|pad7|>"), added("<a b>"), spec | {"normalizer": {"type": "NFC"}}, spec | {"pre_tokenizer": {"type": "Whitespace"}}]
    assert not any(token_files.takes_words_alone(x) for x in odd)


def test_a_worker_makes_a_tokenizer_once():
    with open(TOKENIZER, encoding="utf-8") as file:
        spec = file.read()
    one, two = token_files.Encoder(spec, True), token_files.Encoder(spec, False)
    assert one.tokenizer is two.tokenizer and (one.words_alone, two.words_alone) == (True, False)
    words = [" naïve", "Ab", "é", " x"]
    assert one._letters([]) == [] and one._letters(words) == one._whole(words)


def expected_tokens(rows: list[tuple]) -> list[tuple]:
    """(doc_id, start, n_tokens, crc32) in order; rows of equal id must have equal texts here."""
    whole, out, start = tokenizers.Tokenizer.from_file(TOKENIZER), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("blocks", [1, 128])
def test_token_files(spark, monkeypatch, blocks):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    if blocks == 1:  # long documents then take several segments
        monkeypatch.setattr(token_files, "SEGMENT", 700)
    draw = random.Random(2)
    words = ["the", "naïve", "'s", "<|endoftext|>", "\n\n", "x1", "日本", " ", "cat,"]
    rows = [(draw.randrange(-500, 500) * 1000 + k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 200)))) for k in range(300)]
    rows += [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "word " * 9000), *[(7, "seven times")] * 7, (None, "no id"), (None, "no id")]
    path = new_folder(spark, "tokens")
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, id long").repartition(4)
    token_files.write_tokens(docs, path, TOKENIZER)
    read = token_files.with_starts(token_files.read_tokens(spark, path, ids=True))
    got = [tuple(r) for r in read.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == expected_tokens(rows)
    assert read.select("file").distinct().count() > 3
    for r in read.collect():
        assert len(r["ids"]) == r["n_tokens"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]


def test_token_files_of_nothing(spark):
    path = new_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, TOKENIZER)
    assert token_files.with_starts(token_files.read_tokens(spark, path)).count() == 0


def test_damaged_token_files_are_refused(spark):
    path = new_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), path, TOKENIZER)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0).first()["content"]
    assert [d for d, *_ in token_files.segments(bytes(content))] == [[1]]
    for bad in (content[:-1], content[:100], content[:80] + b"\xff" + content[81:]):
        with pytest.raises(ValueError):
            list(token_files.segments(bytes(bad)))
