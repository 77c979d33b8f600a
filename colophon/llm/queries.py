"""The driver's queries on the operators of this subpackage, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import collocations, disclosure, kneser_ney, line_dedup, metric_join, minhash, mixing, phrase_index, repeated_bytes, secret_links, spans, token_files, toxic_segments, vector_codes
from colophon.llm.rows import keyed
from colophon.workspace import new_folder, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows and items that occur in each document, and items whose rare terms stand close together."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = phrase_index.contamination(docs, items)
    near = found.near().groupBy("id", "body").agg(F.count("*").alias("n_near"))
    rows, key, body = keyed(docs.select("doc_id", "text"), "doc_id", "text")
    rows = rows.select("doc_id", F.col(key).alias("id"), F.col(body).alias("body"))
    out = rows.join(found.lengths, ["id", "body"]).join(found.hits, ["id", "body"], "left").join(near, ["id", "body"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_text = F.coalesce(F.array_join("items", ","), F.lit(""))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(items_text, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document under strings of 400 bytes that occur twice."""
    found = repeated_bytes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["z"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before and after removal of repeated three-line windows."""
    cleaned = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def kind_counts(kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> of the column base."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(kind) for kind in kinds]


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document, and the words that disclose it."""
    found = disclosure.sanitised(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    base = F.sha2(spans.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *kind_counts(disclosure.KINDS), base, spans.written(F.col("spans")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under the model of trusted text, and whether it is accepted."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    return kneser_ney.judged(docs, labels).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic; labels of a fifth of the ids are never read."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    model = toxic_segments.train(docs, labels.where(~toxic_segments.held_out(F.col("id"))))
    found = toxic_segments.score(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), toxic_segments.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, and weak parts that complement each other."""
    found = secret_links.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(spans.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *kind_counts(secret_links.KINDS), base, spans.written(F.col("spans")).alias("spans"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label."""
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by the score of their worst cut."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks trained on all of them."""
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, from the files they were written to."""
    import public_tokenizers

    path = new_folder(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    # Stored, so that the files are decoded once and not again for their sums.
    found = store(token_files.read_tokens(spark, path), "token-rows")
    return token_files.with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_line_dedup": op4_line_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_embeddings": op9_embeddings,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}

LINES_SQL = """
with d as (select doc_id, case when text is null or text = '' then 0 else len(string_split(text, chr(10))) end as n_lines,
                  string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
c as (select doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t from l),
w as (select doc_id, pos as a, lead(pos, 2) over p as b, concat(t, chr(10), lead(t, 1) over p, chr(10), lead(t, 2) over p) as win
      from c where t <> '' window p as (partition by doc_id order by pos)),
later as (select doc_id, a, b from (select doc_id, a, b, row_number() over (partition by win order by doc_id, a) as turn
                                    from w where b is not null) r where turn > 1),
gone as (select distinct l.doc_id, l.pos from l join later x on l.doc_id = x.doc_id and l.pos between x.a and x.b),
kept as (select l.doc_id, count(g.pos) as n_removed, string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null) as text
         from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, d.n_lines, k.n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from d join kept k on d.doc_id = k.doc_id
"""

VECTORS_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, seen) as (select vec_id, vec_id from embeddings union select r.node, l.b from reach r join links l on r.seen = l.a),
least as (select node, min(seen) as component_id from reach group by node)
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
from embeddings e join least m on e.vec_id = m.node
"""

PHRASES_SQL = """
with d as (select doc_id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select doc_id, lang, unnest(ps) as piece, unnest(range(len(ps))) as at from (select doc_id, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') as ps from d)),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as ws from p),
runs as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
         from w, (select unnest([1, 2, 3]) as k) where len(ws) >= k),
f as materialized (select lang, k, phrase, count(*) as f from runs group by lang, k, phrase),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
halves as materialized (select lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') as one, array_to_string(ws[j + 1:k], ' ') as two
  from (select *, unnest(range(1, k)) as j from c)),
cuts as (select h.lang, h.k, h.phrase, h.a, h.j, x.f as l, y.f as r, (1000000 * h.a::hugeint * h.a::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from halves h join f x on x.lang = h.lang and x.phrase = h.one join f y on y.lang = h.lang and y.phrase = h.two),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_parts as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, a from c where k = 3),
longer as (select lang, phrase, max(a) as most from inner_parts group by lang, phrase),
kept as (select w.* from worst w left join longer g on w.lang = g.lang and w.phrase = g.phrase and w.k = 2 where g.most is null or 100 * g.most < 50 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, r.rank::bigint as rank, r.phrase, r.a, r.l, r.r, n.n::bigint as n, r.score::bigint as score from ranked r join n on r.lang = n.lang where r.rank <= 2000
"""


def codes_sql(rounds: int = 4) -> str:
    """Product quantisation in whole numbers, one pair of tables per round."""
    steps = [
        "v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as q from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0)",
        "parts as materialized (select vec_id, p, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] as q from v, (select unnest(range(4)) as p))",
        "b0 as materialized (select p, place - 1 as e, q as c from (select *, row_number() over (partition by p order by vec_id) as place from parts) where place <= 256)",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"a{k} as materialized (select vec_id, parts.p as p, arg_min(e, d * 256 + e) as e, min(d) as d from (select vec_id, parts.p, parts.q, b.e, "
            f"list_sum(list_transform(list_zip(parts.q, b.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from parts join b{k} b on b.p = parts.p) parts group by vec_id, parts.p)"
        )
        if k < rounds:
            steps.append(
                f"s{k} as (select p, e, list(s order by i) as c from (select a.p, a.e, i, floor(sum(q[i]) / count(*)::double)::bigint as s "
                f"from a{k} a join parts on parts.vec_id = a.vec_id and parts.p = a.p, (select unnest(range(1, 1 + (select max(len(q)) from parts))) as i) group by a.p, a.e, i) group by p, e)"
            )
            steps.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(s.c, b.c) as c from b{k} b left join s{k} s on s.p = b.p and s.e = b.e)")
    return (
        f"with {', '.join(steps)}, "
        f"digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as h from b{rounds}), "
        f"codes as (select vec_id, string_agg(lower(printf('%02x', e)), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id) "
        "select c.vec_id, c.code, c.error, (sum(c.error) over (partition by v.label))::bigint as label_error, digest.h as codebooks_sha256 from codes c join v on v.vec_id = c.vec_id, digest"
    )


#: The other operators have no SQL; tests/llm compares them with brute force or held-out rows.
ORACLES: dict[str, str] = {"op4_line_dedup": LINES_SQL, "op9_embeddings": VECTORS_SQL, "op11_collocations": PHRASES_SQL, "op12_vector_codes": codes_sql()}
