"""Lexical and vector retrieval."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import SEARCH_STOP, rolling_hash, signed32, terms
from millrace.sources.staging import staged

#: BM25's saturation and length weight, width of the hashed term vectors.
K1, B, WIDTH = 1.2, 0.75, 128


def term_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, first) with the term's first place; NULL and empty texts have no row."""
    words = docs.select(F.col(key), F.posexplode(terms(F.col(text))).alias("pos", "term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(query: str) -> list[str]:
    return re.findall(r"(?<![0-9A-Za-z_])[a-z]{3,}(?![0-9A-Za-z_])", query.lower())


def _equals(word: str):
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, 0 without a match; repeated query words count repeatedly; NULL texts count as empty.

    One pass of the texts: matches of the query's few words are counted as columns, so nothing is exploded or shuffled;
    the corpus statistics are one aggregate row.
    """
    asked = query_terms(query)
    words = sorted(set(asked))
    # the word list is bound once by a generator: it is used once a query word
    split = docs.select(F.col(key), F.inline(F.array(F.struct(F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("w")))))
    counted = split.select(key, F.size("w").alias("dl"), *[F.size(F.filter("w", _equals(t))).alias(f"t{i}") for i, t in enumerate(words)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(words))]).first()
    n, average = stats["n"], max(stats["avg"] or 0.0, 1e-9)
    score = F.lit(0.0)
    for i, t in enumerate(words):
        df = stats[f"d{i}"] or 0
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        tf = F.col(f"t{i}")
        one = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / average))
        score = score + F.when(tf > 0, one * asked.count(t)).otherwise(0.0)
    return counted.select(key, score.alias("score"))


def bucket_of(term: Column) -> Column:
    return (F.abs(rolling_hash(term)) % WIDTH).cast("int")


def hashed_vectors(tf: DataFrame, key: str) -> DataFrame:
    """(key, bucket, val): sparse hashed term vectors of unit length; of terms that share a bucket the last to appear first wins."""
    total = tf.groupBy(key).agg(F.sum("tf").alias("len"))
    vocabulary = tf.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
    cell = tf.join(vocabulary, "term").groupBy(key, "bucket").agg(F.max_by("tf", "first").alias("tf")).join(total, key)
    raw = cell.select(key, "bucket", F.least(F.lit(1.0), F.col("tf") / F.col("len")).alias("val"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return raw.join(norm, key).select(key, "bucket", (F.col("val") / F.col("norm")).alias("val"))


def query_vector(query: str) -> dict[int, float]:
    """The hashed vector of a query, on the driver: queries are short."""
    words = query_terms(query)
    cells: dict[int, int] = {}
    for w in dict.fromkeys(words):
        h = 0
        for c in w:
            h = (h * 31 + ord(c)) % 2**32
        cells[abs(h - 2**32 if h >= 2**31 else h) % WIDTH] = words.count(w)
    norm = math.sqrt(sum((n / len(words)) ** 2 for n in cells.values())) or 1.0
    return {b: n / len(words) / norm for b, n in cells.items()}


def term_cosine(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, similarity) of the rows that share a bucket with the query."""
    q = query_vector(query)
    vectors = hashed_vectors(term_frequency(docs, key, text), key).where(F.col("bucket").isin(list(q) or [-1]))
    weight = F.create_map(*[F.lit(x) for kv in (q or {-1: 0.0}).items() for x in kv])
    return vectors.groupBy(key).agg(F.sum(F.col("val") * weight[F.col("bucket")]).alias("similarity"))


def hybrid(docs: DataFrame, query: str, alpha: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bm25, cosine, score): both scores scaled by their maximum, which counts as 1 at least, and blended by ``alpha`` within 0 and 1."""
    a = max(0.0, min(1.0, alpha))
    both = bm25(docs, query, key, text).withColumnRenamed("score", "bm25").join(term_cosine(docs, query, key, text), key, "left").withColumn("cosine", F.coalesce("similarity", F.lit(0.0)))
    both = staged(both.select(key, "bm25", "cosine"), "hybrid")
    most = both.agg(F.max("bm25").alias("b"), F.max("cosine").alias("c")).first()
    mb, mc = max(most["b"] or 0.0, 1.0), max(most["c"] or 0.0, 1.0)
    return both.select(key, "bm25", "cosine", (a * F.col("bm25") / mb + (1 - a) * F.col("cosine") / mc).alias("score"))


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """ARRAY<DOUBLE>: slot i holds (i + 1) times the text's 32-bit hash, wrapped, its last three digits over 1000, scaled to unit length; zeros for an empty text, NULL for NULL.

    Hash, slots and length are each bound once, so the cost is linear in the text and in ``dim``.
    """
    h = rolling_hash(F.regexp_replace(F.lower(text), r"[\s\u00A0\uFEFF]+", " "))
    slots = _bound(h, lambda x: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (signed32(F.pmod(x * i, F.lit(2**32))) % 1000) / 1000.0))
    measured = _bound(slots, lambda r: F.struct(r.alias("r"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return _bound(measured, lambda m: F.transform(m["r"], lambda x: F.when(m["n"] > 0, x / m["n"]).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


#: Rows of a packed matrix, and bytes of packed queries that are broadcast at most.
PACK, SHARED = 2048, 64 << 20


def _packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, ids BINARY, v BINARY): rows of one length packed into matrices of unit vectors, made where the rows lie; NULL vectors are left out."""

    def run(batches):
        for b in batches:
            lengths = b.v.map(len)
            for n in sorted(set(lengths.tolist())):
                part = b[lengths == n]
                x = np.stack(part.v.to_numpy()).astype(np.float64).reshape(len(part), n)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for a in range(0, len(part), PACK):
                    yield pd.DataFrame({"dim": [n], "ids": [part.k.to_numpy(np.int64)[a : a + PACK].tobytes()], "v": [x[a : a + PACK].tobytes()]})

    given = rows.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0 and k is not null")
    return given.mapInPandas(run, "dim int, ids binary, v binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, place): for each row of ``queries`` its ``k`` nearest other rows, exact, ties to the smaller key.

    For stated query sets. Both sides are packed into matrices where they lie; matrices of one length meet by an equi-join, the
    queries broadcast only if all of them take at most ``SHARED`` bytes. A product keeps ``k`` a query, found by partition and not by sorting, so what
    moves is ``k`` rows a query and matrix. NULL vectors and those of another length than a query's are no neighbours.
    """
    asked = staged(_packed(queries, key, vector).select("dim", F.col("ids").alias("q_ids"), F.col("v").alias("q")), "queries")
    size = asked.agg(F.sum(F.length("q"))).first()[0] or 0
    met = _packed(vectors, key, vector).join(F.broadcast(asked) if size <= SHARED else asked.hint("shuffle_hash"), "dim")

    def run(batches):
        for b in batches:
            for n, ids, v, q_ids, q in zip(b.dim, b.ids, b.v, b.q_ids, b.q, strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                s = np.round(np.frombuffer(q).reshape(-1, n) @ np.frombuffer(v).reshape(-1, n).T, 12)
                s[q_ids[:, None] == ids[None, :]] = -9.0
                m = min(k, len(ids))
                least = np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m]
                row, col = np.nonzero((s >= least[:, None]) & (s > -9.0))
                order = np.lexsort((ids[col], -s[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < k
                yield pd.DataFrame({"query": q_ids[row[kept]], key: ids[col[kept]], "similarity": s[row[kept], col[kept]]})

    found = met.mapInPandas(run, f"query bigint, {key} bigint, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def contains_all(text: Column, query: str) -> Column:
    """Every search word of ``query`` occurs in ``text``; False if ``query`` has none."""
    asked = sorted({w for w in query_terms(query) if w not in SEARCH_STOP})
    words = terms(text)
    return F.coalesce(F.forall(F.array(*[F.lit(w) for w in asked]), lambda w: F.array_contains(words, w)), F.lit(False)) if asked else F.lit(False)


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def stem(word: str) -> str:
    """A light English suffix stemmer (plural, -ed, -ing and common derivations), for search only."""
    w = word.lower()
    if len(w) <= 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    for end in ("ing", "ed"):
        if w.endswith(end) and _VOWEL.search(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 2 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            break
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for end, new in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ation", "ate"), ("ement", ""), ("ment", ""), ("ness", ""), ("ence", ""), ("ance", ""), ("able", ""), ("ible", "")):
        if w.endswith(end) and len(w) - len(end) > 2:
            w = w[: len(w) - len(end)] + new
            break
    return w[:-1] if w.endswith("e") and len(w) > 4 else w


def contains_all_stemmed(text: Column, query: str) -> Column:
    """``contains_all`` on stems, in a vectorised UDF that stems each different word once a batch."""
    asked = {stem(w) for w in query_terms(query) if w not in SEARCH_STOP}

    @F.pandas_udf("boolean")
    def match(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return lists.map(lambda ws: bool(asked) and asked <= {known[w] if w in known else known.setdefault(w, stem(w)) for w in (ws if ws is not None else [])})

    return match(terms(text))
