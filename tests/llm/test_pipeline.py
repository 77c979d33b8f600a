"""The pipeline stage by stage against brute force, and its language model against a plain one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colophon.llm import kneser_ney, minhash
from colophon.workspace import store
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, then what each stage leaves."""
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], SMALL), name.split()[0]))
    return out


def texts(df) -> list[tuple]:
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_hand_on_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_quality_stage(spark, stages):
    judged = kneser_ney.judged(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {r["doc_id"] for r in judged.where("deviation BETWEEN low AND high").collect()}
    assert {i for i, _ in texts(stages[1])} == kept
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept) >= 0.98 * len(good) and len(kept) < stages[0].count()


def test_line_stage(stages):
    want = plain.repeated_lines(texts(stages[1]))
    assert texts(stages[2]) == sorted((i, w[2]) for i, w in want.items())
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicate_stage(stages):
    kept = {x[0] for x in plain.near_duplicates(texts(stages[2])) if x[3]}
    assert texts(stages[3]) == [t for t in texts(stages[2]) if t[0] in kept]


def test_near_duplicates_from_80(spark):
    """At 80, texts of similarity 0.80 to 0.85 are near duplicates, those below are not."""
    draw, rows, near = random.Random(3), [], 0
    for k in range(40):
        base = [f"w{draw.randrange(10**6)}" for _ in range(100)]
        other = base[: 91 - k % 8] + [f"v{draw.randrange(10**6)}" for _ in range(9 + k % 8)]
        one, two = (plain.shingles(" ".join(x)) for x in (base, other))
        near += 0.8 <= len(one & two) / len(one | two) < 0.85
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    kept = {x[0] for x in plain.near_duplicates(rows, 80) if x[3]}
    found = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert near >= 5 and len(kept) > 40
    assert {r["doc_id"] for r in found.collect()} == kept


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in plain.contamination(texts(stages[3]), items) if x[5]}
    assert hit and texts(stages[4]) == [t for t in texts(stages[3]) if t[0] not in hit]


def test_mixing_stage(stages):
    rows = stages[5].collect()
    assert {(r["doc_id"], r["size"]) for r in rows} == {(i, len(plain.PLAIN.findall(t))) for i, t in texts(stages[4])}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 0.02 * sum(r["size"] for r in rows)


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[5].collect()))


def symbols(text: str, unit) -> list:
    return list(text) if unit is kneser_ney.CHARACTERS else re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|[^\x20\x09-\x0d0-9A-Za-z\x80-\U0010ffff]+", text)


def plain_bits(rows: list[str], unit):
    """Bits per symbol under interpolated modified Kneser-Ney of ``rows``, by its textbook recursion."""
    order = unit.order
    counts = [Counter() for _ in range(order + 1)]

    def grams(text: str) -> list[tuple]:
        line = ["<"] * (order - 1) + [f"={x}" for x in symbols(text, unit)] + [">"]
        return [tuple(line[k - order + 1 : k + 1]) for k in range(order - 1, len(line))]

    for text in rows:
        counts[order].update(grams(text))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    cuts, total, gamma = {}, defaultdict(int), defaultdict(float)
    for n in range(1, order + 1):
        m = [sum(c == k for c in counts[n].values()) for k in range(5)]
        for k in (1, 2, 3):
            usable = m[1] and m[k] and m[k + 1]
            cuts[n, k] = min(max(k - (k + 1) * m[1] / (m[1] + 2 * m[2]) * m[k + 1] / m[k], 0.1), k - 0.05) if usable else k / 2
        for g, c in counts[n].items():
            total[g[:-1]] += c
            gamma[g[:-1]] += cuts[n, min(c, 3)]

    def p(g: tuple) -> float:
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(counts[1]) + 1)
        if not total[g[:-1]]:
            return lower
        c = counts[len(g)][g]
        return ((c - cuts[len(g), min(c, 3)] if c else 0) + gamma[g[:-1]] * lower) / total[g[:-1]]

    # All symbols and one for what was never seen share one.
    seen = {g[-1] for g in counts[order]} | {None}
    for g in list(counts[order])[:20]:
        assert math.isclose(sum(p((*g[:-1], x)) for x in seen), 1, abs_tol=1e-9)

    def bits(text: str) -> float | None:
        found = grams(text) if symbols(text, unit) else []
        return -sum(math.log2(p(g)) for g in found) / len(found) if found else None

    return bits


@pytest.mark.parametrize("unit", [kneser_ney.CHARACTERS, kneser_ney.WORDS])
@pytest.mark.parametrize("sent", [kneser_ney.MOST_SENT, 40, 0])
def test_perplexity_and_acceptance_equal_the_textbook(spark, monkeypatch, unit, sent):
    """All, some or none of the n-grams sent to the tasks; copies, odd texts and a language without trusted text."""
    monkeypatch.setattr(kneser_ney, "MOST_SENT", sent)
    draw = random.Random(8)
    rows = [(k, " ".join("".join(draw.choice("abcdeé,.X7") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 25))), draw.choice(["en", "de", None])) for k in range(60)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1], "xx"), (102, "", "en"), (103, None, "en"), (104, " \n ", "de"), (105, "日本 😀 ab", "xx"), (None, "abc", "en"), (106, "ab " * 3000, "en")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, bits string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(0, 1), (45, 0), (46, None)], "doc_id long, quality int")
    folds = {r["doc_id"]: r["f"] for r in frame.select("doc_id", kneser_ney.fold_of(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    models = [plain_bits([r[1] for r in rows if r[0] in range(40) and folds[r[0]] != f], unit) for f in range(kneser_ney.FOLDS)]
    judged = kneser_ney.judged(frame, labels, unit=unit)
    found = {r["doc_id"]: r for r in judged.collect()}
    assert len(found) == len(rows) == judged.count() and judged.columns == [*frame.columns, "perplexity", "bits_", "deviation", "low", "high", "accepted"]
    for k, text, _ in rows:
        want, got = models[folds[k]](text or ""), found[k]["bits_"]
        assert (got is None) == (want is None) and (want is None or math.isclose(got, want, rel_tol=1e-5)), (k, got, want)
    # Limits from the definition.
    bits = {k: found[k]["bits_"] for k in range(40)}
    of = {k: lang for k, _, lang in rows}
    size = {k: len(symbols(text, unit)) + 1 for k, text, _ in rows if text}

    def quantile(values: list[float], q: float) -> float:
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]

    def blended(values: dict, lang, q: float) -> float:
        own, every = [v for k, v in values.items() if of[k] == lang], quantile(list(values.values()), q)
        return (len(own) * quantile(own, q) + kneser_ney.BLEND * every) / (len(own) + kneser_ney.BLEND) if own else every

    off = {k: b - blended(bits, of[k], 0.5) for k, b in bits.items()}
    x, y = [1 / size[k] for k in off], [v * v for v in off.values()]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    b = sum((i - mx) * (j - my) for i, j in zip(x, y, strict=True)) / sum((i - mx) ** 2 for i in x)
    a, b = max(my - b * mx, 1e-6), max(b, 0)
    deviations = {k: v / math.sqrt(a + b / size[k]) for k, v in off.items()}
    for k, _, lang in rows:
        r = found[k]
        assert math.isclose(r["low"], blended(deviations, lang, kneser_ney.TAIL), rel_tol=1e-3) and math.isclose(r["high"], blended(deviations, lang, 1 - kneser_ney.TAIL), rel_tol=1e-3)
        if r["bits_"] is not None:
            want = (r["bits_"] - blended(bits, lang, 0.5)) / math.sqrt(a + b / size.get(k, 1))
            assert math.isclose(r["deviation"], want, rel_tol=1e-3, abs_tol=1e-3)
        assert r["accepted"] == (r["bits_"] is not None and r["low"] <= r["deviation"] <= r["high"])
    kept = kneser_ney.accepted(frame, labels, unit=unit)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k, r in found.items() if r["accepted"])
