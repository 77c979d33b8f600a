"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of five-word shingles.  Equal sets are one class.  Class
representatives are banded by MinHash; in a bucket, members are compared with a few
pivots, and connected members are not compared again.  A pair's signatures are compared
batch by batch; it is given up as soon as the posterior probability that its similarity
reaches the threshold falls below ``miss``.  Survivors are verified on the full sets.
In buckets whose members are then not one component, the others are compared in blocks
with all members, signatures first, so that every pair that is not connected otherwise
has been compared.

Definitions
* ``A-Z`` are lower-cased; a word is a run without ASCII white space.
* A text of fewer words than a shingle is one shingle; one without words, or null, is
  the empty set, linked with nothing.
* Rows that agree in id and text are one document, and each gets its row.  If an id has
  several texts, it links with the copies of any of them, and by near copies of the one
  whose set has the least digest.  A row with null id is in the result with null
  component and is kept; it links nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm import tokens as T
from colophon.llm.graph import components
from colophon.workspace import store

WORDS = 5
BANDS, BAND_ROWS = 24, 5
HASHES = BANDS * BAND_ROWS
BATCH = 24
#: Similarity of a link where the caller names none, in hundredths: 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 85
#: Chance at each batch of giving up a pair that is similar enough.
MISS = 1e-6
#: Pivots per bucket, by round; what they leave open is compared in blocks.
PIVOTS = (1, 4)
#: Members of a block, and shingles in their sets (16 MB), on average.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
#: Ids of texts to verify are broadcast up to so many (16 MB); beyond, texts are shuffled.
MOST_BROADCAST = 1_000_000
#: Bytes of text whose words are hashed at once, whole documents only.
PIECE = 1 << 18
#: Bytes of a block's sets from which on a worker returns what it has freed.
LARGE_BLOCK = 4 << 20
_CHUNK = 1024
_PAIRS = 1 << 16

_random = np.random.default_rng(20240501)
_FACTORS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first, end, data, offsets in T.pieces(column, PIECE):
        data = T.LOWER[data]
        starts, ends, firsts = T.word_bounds(data, offsets, T.PLAIN_WORD)
        words = T.span_hashes(data, starts, ends)
        for k in range(end - first):
            yield np.unique(T.shingle_hashes(words[firsts[k] : firsts[k + 1]], size))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _CHUNK):
        part = short[at : at + _CHUNK]
        least = np.minimum(least, (part[None, :] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1))
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, same, signature): set size, digest of the set, MinHash signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for found in shingle_sets(batch.column(1)):
                sizes.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "same", "signature"],
            )
        T.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "id long, n_shingles long, same binary, signature binary")


def least_matches(percent: int = PERCENT, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """Matches needed after each batch, under a uniform prior of the similarity s.

    P(s >= t | m of n match) is the probability of at most m successes in n + 1
    draws at t; fewer matches than returned leave it below ``miss``.
    """
    t, need = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, 0
        while m <= n and (below := below + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        need.append(m)
    return need


def likely(pairs: DataFrame, sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (u, v) whose signatures leave the threshold possible."""
    need = least_matches(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(n, HASHES) for k in (2, 3))
            alive, matches = np.arange(n), np.zeros(n, dtype=np.int64)
            for k, least in enumerate(need):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            kept = pa.array(alive, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["u", "v"])
            del a, b
        T.give_back()

    one = sketch.select(F.col("id").alias("u"), F.col("signature").alias("a"))
    two = sketch.select(F.col("id").alias("v"), F.col("signature").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def similar(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets are similar enough, by their exact sizes."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (u, v) whose full shingle sets are similar enough; ``texts`` is (id, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            before, mine = None, None
            for k in range(batch.num_rows):
                u = batch.column(0)[k].as_py()
                if u != before:
                    before, mine = u, next(shingle_sets(batch.column(2).slice(k, 1)))
                other = next(shingle_sets(batch.column(3).slice(k, 1)))
                if similar(mine, other, percent):
                    kept.append(k)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])
        T.give_back()

    one = texts.select(F.col("id").alias("u"), F.col("text").alias("a"))
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("b"))
    return pairs.join(two, "v").join(one, "u").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def buckets(sketch: DataFrame) -> DataFrame:
    """(bucket, band, id, rank) of buckets with two members at least.

    ``rank`` is greater the more company an id has over all its buckets: in a group of
    copies with random changes the least changed text stands near the others, and so
    makes the best pivot.
    """
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 1 + 4 * BAND_ROWS * k, 4 * BAND_ROWS)) for k in range(BANDS)])
    members = sketch.select("id", F.posexplode(bands).alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = store(members.join(shared, "bucket").select("bucket", "band", "id", "n"), "minhash-members")
    # Company first; of equal company any order does, as long as it is the same in all buckets.
    company = members.groupBy("id").agg((F.least(F.sum("n"), F.lit(1 << 42)) * (1 << 20) + F.pmod(F.xxhash64(F.first("id")), F.lit(1 << 20))).alias("rank"))
    return members.join(company, "id").select("bucket", "band", "id", "rank")


def pivots(members: DataFrame, count: int) -> DataFrame:
    """(bucket, pivot, d): the ``count`` members of each bucket of highest rank, and their component."""
    ranked = members.selectExpr("bucket", "id AS pivot", "c AS d", "row_number() OVER (PARTITION BY bucket ORDER BY rank DESC, id) AS place")
    return ranked.where(F.col("place") <= count).select("bucket", "pivot", "d")


def alive(x: np.ndarray, y: np.ndarray, apart: np.ndarray, band: int, need: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, matches) of the pairs of two tables of signatures that may be similar enough.

    Only pairs that are ``apart``, and of those the ones whose first common band is ``band``.
    """
    matches = np.zeros((len(x), len(y)), dtype=np.int16)
    for k in range(BATCH):
        matches += x[:, k, None] == y[None, :, k]
    u, v = np.nonzero((matches >= need[0]) & apart)
    found = matches[u, v].astype(np.int64)
    for k, least in enumerate(need[1:], start=1):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        for at in range(0, len(u), _PAIRS):
            part = slice(at, at + _PAIRS)
            found[part] += (x[u[part], cut] == y[v[part], cut]).sum(axis=1)
        left = found >= least
        u, v, found = u[left], v[left], found[left]
    here = np.zeros(len(u), dtype=bool)
    for at in range(0, len(u), _PAIRS):
        part = slice(at, at + _PAIRS)
        shared = (x[u[part]].reshape(-1, BANDS, BAND_ROWS) == y[v[part]].reshape(-1, BANDS, BAND_ROWS)).all(axis=2)
        here[part] = shared.argmax(axis=1) == band
    return u[here], v[here], found[here]


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Both blocks of a task, their signatures, and which pairs are of different components."""
    a, b = frame[frame["outer"]], frame[~frame["outer"]]
    x, y = (np.frombuffer(b"".join(f["signature"]), dtype=np.uint32).reshape(len(f), HASHES) for f in (a, b))
    return a, b, x, y, a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None, :]


def rest_links(members: DataFrame, sketch: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) that connect what is similar among members of a bucket that are not of one component.

    Members outside the component of the bucket's first member by rank are compared with
    all members, in blocks of bounded size.  First only signatures are dealt, and a block
    gives the members that are left with a partner.  Then the sets of those are dealt
    to the same blocks; there the likeliest pairs are verified first, and pairs that links
    of the block have connected are not.  A pair is looked at in the first band it shares.
    """
    need = least_matches(percent)
    first = members.groupBy("bucket").agg(F.max_by("c", "rank").alias("d"))
    sizes = sketch.select("id", "n_shingles", "signature")
    told = members.join(first, "bucket").join(sizes.select("id", "n_shingles"), "id").withColumn("outer", F.col("c") != F.col("d"))
    blocks = lambda x: F.ceil(F.greatest(F.sum(x) / BLOCK, F.sum(x * F.col("n_shingles")) / BLOCK_SHINGLES)).cast("int")
    counted = told.groupBy("bucket").agg(blocks(F.lit(1)).alias("blocks"), blocks(F.col("outer").cast("int")).alias("outer_blocks"))
    told = told.drop("n_shingles").join(counted.where("outer_blocks > 0"), "bucket")
    one, two = F.pmod(F.xxhash64("id"), "outer_blocks").cast("int"), F.pmod(F.xxhash64("id"), "blocks").cast("int")
    columns = ("band", "id", "c")
    left = told.where("outer").select("bucket", one.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("outer"), *columns)
    right = told.select("bucket", F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("i"), two.alias("j"), F.lit(False).alias("outer"), *columns)
    dealt = left.union(right)

    def partnered(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y, apart = _sides(frame)
        if not len(a) or not len(b):
            return frame.iloc[:0].drop(columns="signature")
        u, v, _ = alive(x, y, apart, int(frame["band"].iloc[0]), need)
        return pd.concat([a.iloc[np.unique(u)], b.iloc[np.unique(v)]]).drop(columns="signature")

    schema = "bucket long, i int, j int, outer boolean, band int, id long, c long"
    signed = dealt.join(sizes.select("id", "signature"), "id").select("bucket", "i", "j", "outer", *columns, "signature")
    kept = store(signed.groupBy("bucket", "i", "j").applyInPandas(partnered, schema), "minhash-partnered")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1))], pa.binary())], ["id", "shingles"])
        T.give_back()

    def connect(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y, apart = _sides(frame)
        links: list[tuple[int, int]] = []
        if len(a) and len(b):
            u, v, matches = alive(x, y, apart, int(frame["band"].iloc[0]), need)
            p, q, c, d = (f[k].tolist() for k, f in (("id", a), ("id", b), ("c", a), ("c", b)))
            ours, theirs = ([np.frombuffer(w, dtype=np.uint64) for w in f["shingles"]] for f in (a, b))
            up: dict[int, int] = {}

            def top(node: int) -> int:
                while (above := up.get(node, node)) != node:
                    up[node] = up.get(above, above)
                    node = above
                return node

            order = np.argsort(-matches, kind="stable")
            for i, j in zip(u[order].tolist(), v[order].tolist(), strict=True):
                m, n = top(c[i]), top(d[j])
                if m != n and similar(ours[i], theirs[j], percent):
                    up[max(m, n)] = min(m, n)
                    links.append((min(p[i], q[j]), max(p[i], q[j])))
            large = sum(map(len, ours)) + sum(map(len, theirs)) > LARGE_BLOCK // 8
            del ours, theirs
            if large:
                T.give_back()
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    ids = kept.select(F.col("id").alias("u"), F.col("id").alias("v"))
    sets = texts_of(ids, texts).select("id", "text").mapInArrow(to_sets, "id long, shingles binary").dropDuplicates(["id"])
    known = store(sizes.join(sets, "id").drop("n_shingles"), "minhash-sets")
    return kept.join(known, "id").groupBy("bucket", "i", "j").applyInPandas(connect, "u long, v long").distinct()


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (id, text) that ``pairs`` name; their ids are broadcast up to MOST_BROADCAST."""
    asked = store(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "minhash-asked")
    return texts.join(F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked, "id", "left_semi")


def linked(sketch: DataFrame, texts: DataFrame, percent: int = PERCENT) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (u, v) that connect all class representatives of a component, and their components; or None."""
    active, links, groups = store(buckets(sketch), "minhash-buckets"), None, None
    for count in (*PIVOTS, None):
        if groups is None:
            told = active.withColumn("c", F.col("id"))
        else:
            told = active.join(groups.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", "rank", F.coalesce("component", "id").alias("c"))
        mixed = told.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
        told = store(told.join(mixed, "bucket", "left_semi"), "minhash-open")
        if told.isEmpty():
            break
        if count:
            tops = store(pivots(told, count), "minhash-pivots")
            pairs = told.join(tops, "bucket").where("c <> d").select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct()
            pairs = likely(pairs, sketch, percent)
            # Pivots have been compared with all of their bucket.
            active = told.select("bucket", "band", "id", "rank").join(tops.select("bucket", F.col("pivot").alias("id")), ["bucket", "id"], "left_anti")
            survivors = store(pairs, "minhash-likely")
            if survivors.isEmpty():
                continue
            found = store(verified(survivors, texts_of(survivors, texts), percent), "minhash-links")
        else:
            found = store(rest_links(told, sketch, texts, percent), "minhash-links")
            if found.isEmpty():
                continue
        links = found if links is None else links.union(found)
        groups = components(links)
    return links, groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; sets of ``percent`` similarity or more are linked."""
    sketch = store(sketches(docs, id_col, text_col), "minhash-sketches")
    known = sketch.where(F.col("id").isNotNull())
    classes = store(known.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("id").alias("rep")), "minhash-classes")
    one_each = classes.groupBy("rep").agg(F.min("same").alias("same")).select(F.col("rep").alias("id"), "same")
    reps = known.join(one_each, ["id", "same"]).groupBy("id").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    reps = store(reps, "minhash-reps")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    links, groups = linked(reps, texts, percent)
    named = sketch.join(classes, "same", "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
    if not known.select("id", "same").distinct().groupBy("id").count().where("count > 1").isEmpty():
        of_class = named.select(F.col("id").alias("u"), F.col("rep").alias("v")).where("u IS NOT NULL")
        groups = components(of_class if links is None else of_class.union(links.select("u", "v")))
    # The least id of a component is that of one of its classes.
    out = named.withColumn("component", F.lit(None).cast("long")) if groups is None else named.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose component is named after their id, one row per id; rows with null id stay.

    Of rows that share a kept id, the one of least text hash stays.
    """
    found = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(found, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
    again = left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("n"), F.min(F.xxhash64(text_col)).alias("_body")).where("n > 1")
    again = store(again.select("_again", "_body"), "minhash-again")
    if again.isEmpty():
        return left
    single = left.join(again, F.col(id_col) == F.col("_again"), "left_anti")
    first = left.join(again, (F.col(id_col) == F.col("_again")) & (F.xxhash64(text_col) == F.col("_body")), "left_semi").dropDuplicates([id_col])
    return single.unionByName(first)
