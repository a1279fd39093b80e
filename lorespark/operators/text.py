"""Lexical retrieval: terms, postings, BM25 and its fielded form, TF-IDF, chunking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words a query is searched without.
STOPWORDS = [
    "the", "and", "for", "are", "was", "were", "what", "when", "where", "who", "whom", "which", "how", "why", "did", "does",
    "do", "is", "of", "to", "in", "on", "at", "by", "an", "a", "it", "its", "this", "that", "these", "those", "with", "from",
    "as", "be", "or", "if", "about", "into", "over", "than", "then", "they", "them", "their", "you", "your", "we", "our", "i",
]
WORD = r"[\p{L}\p{N}]+"
HARNESS_WORD = r"[a-z0-9]+"


@dataclass(frozen=True)
class Bm25:
    """k1 and b, and how rare terms are weighed: ``plus_one`` is ln(1 + x), ``floored`` is ln(x) but at least 1e-6."""

    k1: float = 1.2
    b: float = 0.75
    idf: str = "floored"

    def weight(self, n: int) -> Column:
        x = (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)
        return F.ln(1 + x) if self.idf == "plus_one" else F.greatest(F.ln(x), F.lit(1e-6))


ENGINE, HARNESS = Bm25(), Bm25(1.5, 0.75, "plus_one")


def words(text: Column, pattern: str = WORD, least: int = 1) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return found if least == 1 else F.filter(found, lambda t: F.octet_length(t) >= least)


def content_terms(query: Column) -> Column:
    """Distinct words of three bytes and more that are no stop-words, in order; if none, the raw words."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    kept = F.array_distinct(F.filter(words(query, least=3), lambda t: ~F.array_contains(stop, t)))
    raw = F.array_distinct(F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda t: t != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def term_frequencies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of the wanted terms. docs: id, terms (array). Other terms are dropped before any shuffle."""
    terms = docs.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("id", "dl", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def bm25(docs: DataFrame, queries: DataFrame, model: Bm25 = ENGINE, digits: int = 9) -> DataFrame:
    """(qid, id, score, matched) of every document that has a term of the query.

    docs: id, terms. queries: qid, terms. Documents' lengths count all their terms; their number and
    mean length are two numbers taken first. Scores are rounded so that ranks do not depend on the
    order of summation.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    return scored(term_frequencies(docs, asked), queries, n, mean, model, digits)


def scored(tf: DataFrame, queries: DataFrame, n: int, mean: float, model: Bm25 = ENGINE, digits: int = 9) -> DataFrame:
    """(qid, id, score, matched) by BM25 from postings (id, dl, term, tf) of the queries' terms, of n documents of mean length."""
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    norm = model.k1 * (1 - model.b + model.b * F.col("dl") / F.lit(mean))
    part = model.weight(n) * F.col("tf") * (model.k1 + 1) / (F.col("tf") + norm)
    return (
        asked.join(df, "term")
        .join(tf, "term")
        .groupBy("qid", "id")
        .agg(F.round(F.sum(part), digits).alias("score"), F.count(F.lit(1)).alias("matched"))
    )


def bm25f(docs: DataFrame, fields: dict[str, float], queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, score): fielded BM25. docs: id and one array of terms per field; weights of 0 recall but do not score."""
    means = docs.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.size(f)).alias(f) for f in fields)).first()
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))

    def weighed(f: str, w: float) -> Column:
        each = F.lit(w) / (1 - b + b * F.size(f) / F.lit(float(means[f] or 1.0)))
        return F.transform(f, lambda t: F.struct(t.alias("term"), each.alias("w")))

    occurrences = F.flatten(F.array(*(weighed(f, w) for f, w in fields.items())))
    tf = (
        docs.select("id", F.explode(occurrences).alias("o"))
        .select("id", "o.term", "o.w")
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("id", "term")
        .agg(F.sum("w").alias("tf"))
    )
    return fielded(tf, queries, means["n"], k1)


def fielded(tf: DataFrame, queries: DataFrame, n: int, k1: float = 1.2) -> DataFrame:
    """(qid, id, score) by fielded BM25 from (id, term, tf), tf being the weighed sum over the fields, of n documents."""
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = Bm25().weight(n) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)
    return asked.join(df, "term").join(tf, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 9).alias("score"))


def tfidf_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score): cosine of TF-IDF vectors, idf = ln(N / df) + 1, over all documents with a common term."""
    n = docs.count()
    tf = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.ln(F.lit(float(n)) / F.col("df")) + 1).alias("idf"))
    weighted = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = asked.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qnorm = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = asked.join(weighted, "term").groupBy("qid", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norm, "id").join(qnorm, "qid").select("qid", "id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 9).alias("score"))


def top(scored: DataFrame, k: int, group: str = "qid", order: tuple[Column, ...] | None = None) -> DataFrame:
    """The first k of each query with their rank; by default by score, then id. Partial lists are cut before the shuffle."""
    order = order or (F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def paragraph_chunks(text: Column, limit: int = 6_000) -> Column:
    """Paragraphs packed into chunks of at most ``limit`` characters; a longer paragraph is cut hard."""
    paragraphs = F.split(text, r"\n\n")
    pieces = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / limit) - 1, F.lit(0)).cast("int")),
                lambda i: F.substring(p, i * limit + 1, F.lit(limit)),
            ),
        )
    )
    empty = F.array().cast("array<string>")
    packed = F.aggregate(
        pieces,
        F.struct(empty.alias("done"), F.lit(None).cast("string").alias("open")),
        lambda a, p: F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), p.alias("open")))
        .when(F.length(a["open"]) + F.length(p) + 2 <= limit, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit("\n\n"), p).alias("open")))
        .otherwise(F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), p.alias("open"))),
        lambda a: F.concat(a["done"], F.array(a["open"])),
    )
    return F.filter(packed, lambda x: F.length(F.trim(x)) > 0)


def word_windows(text: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` words every ``stride`` words, joined by single spaces; a short text is one window."""
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    last = F.greatest(F.ceil((F.size(found) - size) / stride), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(found, i * stride + 1, F.lit(size)), " "))


def hashed_words(df: DataFrame, key: str, terms: str, dim: int) -> DataFrame:
    """(key, dim, value): unit-length counts of words hashed by SHA-1 to ``dim`` places, zero places left out."""
    place = F.pmod(F.conv(F.substring(F.sha1(F.col("t")), 33, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    counts = df.select(key, F.explode(terms).alias("t")).groupBy(key, place.alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "dim", (F.col("n") / norm).alias("value"))
