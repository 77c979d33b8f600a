"""Identity of rows: documents are told apart by id and text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column has it in any case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the id as text, and a hash of the text.

    Neither is ever null: an id is written after ``=``, a null id is empty.  Rows that
    agree in both are one document to an operator; each keeps its own row.
    """
    key = fresh(docs.columns, "_id")
    body = fresh([*docs.columns, key], "_body")
    written = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return docs.withColumns({key: written, body: F.xxhash64(F.col(text_col))}), key, body
