"""Personal data, and the words that give it away.  Only DataFrame functions.

Direct identifiers (e-mail, IP address, card, phone) are found by pattern.  Whether a
word reveals one of them is read off the corpus: of N rows, n(entity) hold the entity,
n(word) the word and n(word, entity) both.  With ``P(entity) = n(entity) / N``, a row
with the word holds the entity with the smoothed probability ``P(entity | word) =
(n(word, entity) + PRIOR P(entity)) / (n(word) + PRIOR)``, and the word's information on
the entity is ``log2(P(entity | word) / P(entity))``.  The entity's own is
``-log2 P(entity)``; the ratio of both nears 1 if the word never occurs without the
entity, also for an entity in a single row, and is 0 if they are independent.  From
``REMOVE`` on the word is removed, from ``GENERALISE`` on it is replaced by its class
(after Sanchez and Batet's C-sanitised documents).

Definitions
* Offsets are code points, the end exclusive.  Base matches are leftmost and do not
  overlap within a kind; one that fails its test is dropped without another try.
* A word is a run of letters, ``LEAST_LETTERS`` at least, compared in lower case.  One
  that overlaps a base span is not marked, but counts in n(word).
* Every occurrence of a word that gives away an entity is marked in every row that holds
  the entity.  Where a row has several, the greatest ratio holds.
* Entities are compared by kind and matched text, e-mail addresses in lower case.
* Null and empty texts have no spans.  Rows are told apart by id and text; repeated rows
  get the same result, and count once for each row in the corpus counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm import spans as S
from colophon.llm.rows import keyed
from colophon.workspace import store

# The patterns that define the base kinds.  Possessive repeats and the
# look-behinds change no match; they keep the search linear in long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

WORD = r"(?<!\p{L})\p{L}{4,}"
LEAST_LETTERS = 4
#: Rows that the smoothing adds to those with a word.
PRIOR = 1.0
REMOVE = 0.9
GENERALISE = 0.75
TERM_KINDS = ("remove", "generalise")
TERM_TYPE = "array<struct<place:int,a:int,z:int,kind:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda k: F.substring(number, -k, 1).cast("int")
    place = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, k: Column) -> Column:
        d = F.substr(number, F.length(number) - k + 1, F.lit(1)).cast("int") * (2 - k % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(place, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    small = F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    return {
        "email": S.found(text, EMAIL),
        "ip": S.found(text, IP, lambda m: F.regexp_like(m, small)),
        "card": S.found(text, CARD, lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m))),
        "phone": S.found(text, PHONE, lambda m: F.length(digits(m)).between(9, 15)),
    }


def entities_of(spans: dict[str, Column]) -> Column:
    """The distinct entities of a text: kind and lower-cased match."""
    return F.array_distinct(F.concat(*[F.transform(x, lambda m, kind=kind: F.concat_ws(":", F.lit(kind), F.lower(m["m"]))) for kind, x in spans.items()]))


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def places(held: DataFrame) -> DataFrame:
    """(id, body, term, a, z): every word of (id, body, text, base) outside the base spans.

    The lengths of gaps and words, summed along the text, are the places.
    """
    cut = F.zip_with(F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    each = held.select("id", "body", F.posexplode(cut).alias("k", "w")).select("id", "body", "k", F.col("w.gap").alias("gap"), F.col("w.m").alias("m"))
    size = F.coalesce(F.length("m"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("id", "body").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    words = each.withColumn("z", end).where("m IS NOT NULL").select("id", "body", F.lower("m").alias("term"), (F.col("z") - F.length("m")).alias("a"), "z")
    spans = held.select("id", "body", F.explode("base").alias("s")).select("id", "body", "s.a", "s.z")
    return S.clear_of(words, spans)


def holders(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, id, body, n) and (class, n_entity): entities that the same rows hold are one class, as they have the same counts."""
    each = store(held.select("id", "body", "n", F.explode("entities").alias("entity")), "pii-entities")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "id", "body")).cast("string") for k in range(2)]
    sets = each.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.concat_ws(":", *marks, F.sum("n").cast("string")).alias("class"))
    return each.join(sets, "entity").select("class", "id", "body", "n").distinct(), sets.select("class", "n_entity").distinct()


def disclosing(found: DataFrame, held: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(id, body, term, ratio) of words that tell enough about an entity of their row."""
    total = float(max(docs.count(), 2))
    holding, own = holders(held)
    pairs = store(found.select("id", "body", "term").distinct().join(holding, ["id", "body"]), "pii-pairs")
    both = pairs.groupBy("class", "term").agg(F.sum("n").alias("both"))
    # Each word once a row; folded before it meets the words that are asked for.
    words = docs.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_word"))
    known = both.join(words.join(pairs.select("term").distinct(), "term", "left_semi"), "term").join(own, "class")
    share = F.col("n_entity") / total
    whole = -F.log2(share)
    told = F.log2((F.col("both") + PRIOR * share) / ((F.col("n_word") + PRIOR) * share))
    known = known.select("class", "term", (told / F.greatest(whole, F.lit(1e-9))).alias("ratio")).where(F.col("ratio") >= GENERALISE)
    return pairs.join(known, ["class", "term"]).groupBy("id", "body", "term").agg(F.max("ratio").alias("ratio"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, base, spans[, sanitised]) of every row.

    ``spans`` has the base spans by kind as listed, then start, then the words to remove
    and to generalise; ``sanitised`` is the text with tags in their place.
    """
    rows, key, body = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    matched = rows.select("doc_id", F.col(key).alias("id"), F.col(body).alias("body"), text.alias("text"), *[x.alias(kind) for kind, x in base_spans(text).items()])
    by_kind = {kind: F.col(kind) for kind in KINDS}
    base = F.concat(*[S.tagged(x, kind, k) for k, (kind, x) in enumerate(by_kind.items())])
    seen = matched.select("doc_id", "id", "body", "text", base.alias("base"), entities_of(by_kind).alias("entities"))
    # Only texts with personal data are kept for what follows.
    seen = store(seen.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "pii-spans")
    held = seen.where(F.size("base") > 0).groupBy("id", "body").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.first("entities").alias("entities"), F.count("*").alias("n"))
    held = store(held, "pii-held")
    found = store(places(held), "pii-words")
    told = disclosing(found, held, rows, "text")
    kind = F.when(F.col("ratio") >= REMOVE, F.lit(TERM_KINDS[0])).otherwise(F.lit(TERM_KINDS[1]))
    terms = found.join(told, ["id", "body", "term"])
    place = F.when(F.col("ratio") >= REMOVE, len(KINDS)).otherwise(len(KINDS) + 1)
    terms = terms.groupBy("id", "body").agg(F.collect_list(F.struct(place.alias("place"), "a", "z", kind.alias("kind"))).alias("terms"))
    out = seen.join(terms, ["id", "body"], "left")
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.expr("array()").cast(TERM_TYPE))))
    columns = ["doc_id", F.array_sort("base").alias("base"), every.alias("spans")]
    if texts:
        by_place = F.array_sort(F.transform(every, lambda x: F.struct(x["a"].alias("a"), x["z"].alias("z"), x["kind"].alias("kind"))))
        # Of overlapping spans (kinds may overlap) the first goes, and what another reaches beyond it.
        cut = F.aggregate(
            by_place, F.struct(F.lit(0).alias("end"), F.expr("array()").cast("array<struct<a:int,z:int,kind:string>>").alias("kept")),
            lambda s, x: F.struct(
                F.greatest(s["end"], x["z"]).alias("end"),
                F.when(x["z"] <= s["end"], s["kept"]).otherwise(F.array_append(s["kept"], F.struct(F.greatest(s["end"], x["a"]).alias("a"), x["z"].alias("z"), x["kind"].alias("kind")))).alias("kept"),
            ),
        )["kept"]
        tag = lambda x: F.when(x["kind"] == "remove", F.lit("")).when(x["kind"] == "generalise", F.lit("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        clean = S.replaced(F.col("t"), F.col("cut"), tag)
        source = rows.select(F.col(key).alias("id"), F.col(body).alias("body"), text.alias("t")).distinct()
        out = out.withColumn("cut", cut).join(source, ["id", "body"])
        columns.append(clean.alias("sanitised"))
    return out.select(*columns)
