"""Secret scan with linking of multipart credentials.  Only DataFrame functions.

Some patterns are secrets by themselves (assignments, access keys, long hexadecimal
runs).  Others are parts that mean nothing alone: names of an account, random-looking
strings, endpoints.  Parts are rows; an interval join brings together those whose scopes
meet, and a weak part is reported only if its complement is there: an account or an
endpoint with a secret, a random-looking string with an account, access key or endpoint.

Definitions
* Offsets are code points, the end exclusive.  Base matches are leftmost and do not
  overlap within a kind; one that fails its length is dropped without another try.
* A weak part that overlaps a base match is none.  A scope reaches ``SCOPE``
  characters around a part.
* Null and empty texts have no spans.  Rows are told apart by id and text; repeated rows
  get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm import spans as S
from colophon.llm.rows import keyed
from colophon.workspace import store

# The patterns that define the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

#: Weak parts: an account's name, a string of mixed characters, a host that is called.
ACCOUNT = r"""(?i:client_?id|key_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})"""
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}"""
WEAK = ("account", "random", "endpoint")
SCOPE = 300


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    return {"assign": S.found(text, ASSIGN, value), "access": S.found(text, ACCESS, lambda m: F.length(m) >= 20), "hex": S.found(text, HEX)}


def weak_spans(text: Column) -> Column:
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    found = (S.found(text, ACCOUNT), S.found(text, RANDOM, mixed), S.found(text, ENDPOINT))
    return F.concat(*[S.tagged(x, kind, len(KINDS) + k) for k, (kind, x) in enumerate(zip(WEAK, found, strict=True))])


def linked(parts: DataFrame) -> DataFrame:
    """The weak rows of (id, body, place, a, z, kind) with a complement within reach.

    Joined by document and stretch of text.  A stretch holds as many parts as fit its
    length, so no document makes more than a fixed number of pairs per part.
    """
    ask = S.on_stretches(parts.where(F.col("kind").isin(*WEAK)), reach=SCOPE)
    have = parts.select("id", "body", F.col("a").alias("a2"), F.col("z").alias("z2"), F.col("kind").alias("kind2"))
    near = ask.join(S.on_stretches(have, "a2", "z2"), ["id", "body", "stretch"]).where((F.col("a2") < F.col("z") + SCOPE) & (F.col("a") < F.col("z2") + SCOPE))
    key = F.col("kind2").isin("account", "access", "endpoint")
    secret = F.col("kind2").isin("assign", "hex", "random")
    complement = F.when(F.col("kind") == "random", key).otherwise(secret)
    return near.where(complement).select("id", "body", "place", "a", "z", "kind").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: base spans, and these with linked weak parts, by start, then kind."""
    rows, key, body = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[S.tagged(x, kind, k) for k, (kind, x) in enumerate(base_spans(text).items())])
    seen = rows.select("doc_id", F.col(key).alias("id"), F.col(body).alias("body"), "text", base.alias("base"))
    seen = store(seen.select("doc_id", "id", "body", "base", weak_spans(text).alias("weak")), "secret-spans")
    # A weak part alone in its document has no complement.
    some = seen.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    strong = some.select("id", "body", F.explode("base").alias("p")).select("id", "body", "p.*").distinct()
    weak = some.select("id", "body", F.explode("weak").alias("p")).select("id", "body", "p.*").distinct()
    parts = store(strong.unionByName(S.clear_of(weak, strong)), "secret-parts")
    kept = linked(parts).groupBy("id", "body").agg(F.collect_list(F.struct("place", "a", "z", "kind")).alias("more"))
    out = seen.join(kept, ["id", "body"], "left")
    every = F.concat("base", F.coalesce("more", F.expr("array()").cast("array<struct<place:int,a:int,z:int,kind:string>>")))
    return out.select("doc_id", in_order(F.col("base")).alias("base"), in_order(every).alias("spans"))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    moved = F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["place"].alias("place"), x["z"].alias("z"), x["kind"].alias("kind")))
    return F.array_sort(moved)
