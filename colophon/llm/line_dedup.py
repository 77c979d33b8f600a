"""Line dedup: passages of consecutive lines that occurred before are removed.

Every run of three consecutive lines is a window; windows overlap.  A window is
hashed, windows found more than once in the corpus are kept with their places, and
every place but the first is covered.  Covered lines are merged to runs and cut out.

Definitions
* Lines end at ``\\n``.  Blank lines (ASCII white space only) count for nothing: windows
  run over the other lines, compared without the white space at their ends.  A blank
  line goes with a removed run if it lies inside it.
* Places are ordered by id (null first; fewer characters first, then by character, so that
  natural numbers keep their order), then by a hash of the text, then by line.
* Rows that agree in id and text are one document; each such row gets its result.
* A text of fewer non-blank lines than a window keeps all; null stays null, empty stays empty.
* Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.rows import fresh, keyed
from colophon.workspace import store

WINDOW_LINES = 3
_WHITE = " \t\n\v\f\r"


def line_windows(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(id, body, place, a, b, hi, lo): every window, its first and last line and 128 bits of hash.

    ``docs`` has id, body (hash of the text) and text.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for row, text in enumerate(frame["text"]):
                lines = [(k, x) for k, line in enumerate((text or "").split("\n")) if (x := line.strip(_WHITE))]
                for place in range(len(lines) - size + 1):
                    run = lines[place : place + size]
                    digest = blake2b("\n".join(x for _, x in run).encode(), digest_size=16).digest()
                    rows.append((row, place, run[0][0], run[-1][0], digest))
            at = np.array([r[0] for r in rows], dtype=np.int64)
            hashes = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "id": frame["id"].to_numpy()[at] if len(at) else pd.Series(dtype=object),
                    "body": frame["body"].to_numpy()[at],
                    "place": np.array([r[1] for r in rows], dtype=np.int64),
                    "a": np.array([r[2] for r in rows], dtype=np.int64),
                    "b": np.array([r[3] for r in rows], dtype=np.int64),
                    "hi": hashes[:, 0],
                    "lo": hashes[:, 1],
                }
            )

    return docs.select("id", "body", "text").mapInPandas(cut, "id string, body long, place long, a long, b long, hi long, lo long")


def repeated_runs(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(id, body, runs): for each document with later occurrences, the line runs they cover."""
    windows = store(line_windows(docs, size), "line-windows")
    often = windows.groupBy("hi", "lo").agg(F.count("*").alias("times")).where("times > 1").select("hi", "lo")
    found = store(windows.join(often, ["hi", "lo"], "left_semi"), "line-repeats")
    order = F.struct(F.length("id").alias("digits"), "id", "body", "place")
    first = found.groupBy("hi", "lo").agg(F.min(order).alias("first"))
    later = found.join(first, ["hi", "lo"]).where(order != F.col("first"))
    return later.groupBy("id", "body").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def merged(runs: list) -> list[tuple[int, int]]:
    """Overlapping or touching line runs as one."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_LINES, counts: bool = False
) -> DataFrame:
    """``docs`` with its columns, later occurrences of line windows cut out of the text.

    ``counts`` adds n_lines and n_removed (lines of the text before, and cut out of it).
    """
    names = docs.columns
    rows, key, body = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows.select(F.col(key).alias("id"), F.col(body).alias("body"), F.col(text_col).alias("text")), size)
    spans, total, gone = (fresh([*rows.columns, "n_lines", "n_removed"], x) for x in ("_runs", "_lines", "_gone"))
    runs = runs.select(F.col("id").alias("_r_id"), F.col("body").alias("_r_body"), F.col("runs").alias(spans))
    same = (F.col(key) == F.col("_r_id")) & (F.col(body) == F.col("_r_body"))
    joined = rows.join(runs, same, "left").drop("_r_id", "_r_body")
    joined = joined.withColumn(total, F.when(F.length(text_col) > 0, F.size(F.split(text_col, "\n", -1))).otherwise(0).cast("long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, found in zip(batch.column(text_col).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                lines, keep, at, n = text.split("\n"), [], 0, 0
                for a, b in merged(found):
                    keep += lines[at:a]
                    at, n = b + 1, n + b + 1 - a
                texts.append("\n".join(keep + lines[at:]))
                removed.append(n)
            new = {text_col: pa.array(texts, pa.string()), gone: pa.array(removed, pa.int64())}
            left = [c for c in batch.schema.names if c != spans]
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in left], left)

    joined = joined.withColumn(gone, F.lit(0).cast("long"))
    kept = joined.where(F.col(spans).isNull()).drop(spans)
    touched = joined.where(F.col(spans).isNotNull())
    cleaned = touched.mapInArrow(cut, kept.schema)
    extra = [F.col(total).alias("n_lines"), F.col(gone).alias("n_removed")] if counts else []
    return kept.unionByName(cleaned).select(*[F.col(f"`{c}`") for c in names], *extra)
