"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.fuse import fuse_scores, leaders_by_place
from lorespark.llm.language import find_languages, fit_languages, wrongly_labelled
from lorespark.llm.mix import Mix, Target, mix_sources
from lorespark.llm.split import holding_versions, split_oversized
from lorespark.llm.tokens import Tokenizer, decode_corpus, encode_corpus
from lorespark.llm.topn import top_n_per_group
from lorespark.runtime import prepare, written


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = top_n_per_group(
        _read(spark, sf, "pool"), "query_id", "doc_id", "ce_norm", 10, groups=_read(spark, sf, "gold_records")
    )
    return found.select("query_id", "doc_id")


def p1_top10(spark: SparkSession, sf: str, **thresholds: int) -> DataFrame:
    return top_n_per_group(
        _read(spark, sf, "pool"), "query_id", "doc_id", "ce_norm", 10, groups=_read(spark, sf, "gold_records"), **thresholds
    )


def p1_top10_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same with so low a threshold that groups of 60 rows take the hot path."""
    return p1_top10(spark, sf, hot_rows=60, salt_rows=25)


def _fused(spark: SparkSession, sf: str, **thresholds: int):
    return fuse_scores(_read(spark, sf, "pool"), "query_id", "doc_id", {"base_score": 1.0, "ce_norm": 1.0}, **thresholds)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaders_by_place(_fused(spark, sf), "query_id", "doc_id")


def p4_ranking(spark: SparkSession, sf: str, **thresholds: int) -> DataFrame:
    return _fused(spark, sf, **thresholds).table().select("query_id", "doc_id", F.round("fused", 9).alias("fused"), "position")


def p4_ranking_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same with so low a threshold that groups of 60 rows take the hot path."""
    return p4_ranking(spark, sf, hot_rows=60)


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(holding_versions(_read(spark, sf, "corpus_docs"), "doc_id", "body", "modified_at", over=6_000))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).where("piece = 0").select("doc_id", "boundary")


def _split_check(spark: SparkSession, sf: str, limit: int, overlap: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, chars, md5, too_large, wrong_repeats) of each body put together again from its pieces, or as it is if it has none."""
    bodies = written(holding_versions(_read(spark, sf, "corpus_docs"), "doc_id", "body", "modified_at"), "bodies")
    pieces = split_oversized(bodies, limit=limit, overlap=overlap, tokenizer=tokenizer)
    fresh = F.expr("substr(text, repeated + 1)")
    joined = pieces.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", fresh.alias("t")))), lambda x: x["t"]), "").alias("again"),
        F.count_if(F.col("size") > limit).alias("too_large"),
        F.count_if((F.col("repeated") > overlap * (40 if tokenizer else 1)) | ((F.col("piece") == 0) & (F.col("repeated") > 0))).alias("wrong_repeats"),
    )
    text = F.coalesce("again", "body", F.lit(""))
    return bodies.join(joined, "doc_id", "left").select(
        "doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("md5"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("too_large", "wrong_repeats")),
    )


def p3_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    return _split_check(spark, sf, 6_000, 200)


def p3_rejoined_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The same with sizes in tokens: pieces of at most 512, repeating up to 64."""
    return _split_check(spark, sf, 512, 64, Tokenizer.load())


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_read(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The texts read back from their ids."""
    return decode_corpus(p6_ids(spark, sf))


def _mix(spark: SparkSession, sf: str) -> Mix:
    rows = _read(spark, sf, "mix_targets").collect()  # a fixed table
    targets = [Target(r.source, r.target_share, r.max_repeats) for r in rows]
    documents = _read(spark, sf, "documents").withColumn("sources", F.array(F.lower(F.trim("source"))))
    return mix_sources(documents, targets)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).documents


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: rows of a document that is not of the source, uses beyond the limit, repeated rows, and whether the tokens
    miss the target by a document or more (a short source: whether less than all it may give was used)."""
    mix = _mix(spark, sf)
    own = _read(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("own"))
    limits = _read(spark, sf, "mix_targets").select("source", "max_repeats")
    used = mix.documents.join(own, "doc_id").join(limits, "source").groupBy("source").agg(
        F.count_if(F.col("own") != F.col("source")).alias("foreign"),
        F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") < 1)).alias("over_used"),
        (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated"),
        F.max("tokens").alias("largest"),
    )
    meant = F.when(F.col("status") == "short", F.col("available_tokens") * F.col("max_repeats")).otherwise(F.col("target_tokens"))
    return mix.report.join(used, "source", "left").select(
        "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("foreign", "over_used", "repeated")),
        (F.abs(F.col("actual_tokens") - meant) > F.coalesce("largest", F.lit(0))).alias("off_target"),
    )


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents")
    return find_languages(documents, fit_languages(documents, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = p8_languages(spark, sf).select("doc_id", "label", "seg", "lang")
    return wrongly_labelled(written(found, "languages"))


_TOP10 = """
WITH best AS (
  SELECT query_id, doc_id, max(ce_norm) AS ce_norm FROM pool
  WHERE ce_norm IS NOT NULL AND NOT isnan(ce_norm) AND query_id IN (SELECT query_id FROM gold_records)
  GROUP BY query_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_norm DESC, doc_id) AS rank FROM best)
"""

_PLACES = """
WITH best AS (
  SELECT query_id, doc_id,
         max(CASE WHEN NOT isnan(base_score) THEN base_score END) AS b,
         max(CASE WHEN NOT isnan(ce_norm) THEN ce_norm END) AS c
  FROM pool WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY query_id, doc_id),
placed AS (
  SELECT *, CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) END AS pb,
         CASE WHEN c IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) END AS pc,
         count(*) OVER (PARTITION BY query_id) AS items FROM best),
counted AS (
  SELECT *, count(*) FILTER (WHERE pb <= 20 AND pc <= 20) OVER (PARTITION BY query_id) AS rivals FROM placed)
SELECT query_id, doc_id FROM counted WHERE pb <= 3 AND pc <= 3 AND rivals = 1 AND items >= 30
"""

_HOLDING = """
WITH held AS (
  SELECT doc_id, body FROM corpus_docs WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY try_cast(modified_at AS TIMESTAMPTZ) DESC NULLS LAST, body IS NULL, body DESC) = 1)
"""
_REJOINED = _HOLDING + "SELECT doc_id, length(coalesce(body, '')) AS chars, md5(coalesce(body, '')) AS md5, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS wrong_repeats FROM held"
_WHITE = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\v]"
_MARK = "chr(1)"


def _boundary_sql() -> str:
    """The first kind of boundary that leaves no unit over 5,800 characters: marks go where units part, and the units between are measured."""
    longest = lambda t: f"list_max(list_transform(string_split({t}, {_MARK}), lambda u: length(u)))"
    blank = _WHITE.replace("\\s", " \\t\\f\\r").replace("\\v", "\\x0b")
    return _HOLDING + f"""
, large AS (SELECT doc_id, body AS b FROM held WHERE length(body) > 6000),
p AS (SELECT doc_id, regexp_replace(b, '(^|\\r?\\n)({blank}*\\n)+({blank}+$)?|(^|\\r?\\n){blank}+$', {_MARK}, 'g') AS t FROM large),
l AS (SELECT doc_id, t, regexp_replace(t, '\\r?\\n', {_MARK}, 'g') AS t2 FROM p),
s AS (SELECT doc_id, t, t2, regexp_replace(regexp_replace(t2, '([.!?…]){_WHITE}+', '\\1' || {_MARK}, 'g'), '([。！？])', '\\1' || {_MARK}, 'g') AS t3 FROM l),
w AS (SELECT *, regexp_replace(t3, '{_WHITE}+', {_MARK}, 'g') AS t4 FROM s)
SELECT doc_id, CASE WHEN {longest('t')} <= 5800 THEN 'paragraph' WHEN {longest('t2')} <= 5800 THEN 'line'
  WHEN {longest('t3')} <= 5800 THEN 'sentence' WHEN {longest('t4')} <= 5800 THEN 'word' ELSE 'character' END AS boundary FROM w
"""


def _standard_sql(x: str) -> str:
    """Columns of one score: its value, lowest, NEAR-th and FAR-th highest in robust deviations."""
    z = lambda v: f"CASE WHEN d{x} IS NULL THEN 0.0 ELSE ({v} - m{x}) / d{x} END"
    return f"{x}, {z(x)} AS z{x}, {z('l' + x)} AS zl{x}, {z('n' + x)} AS zn{x}, {z('f' + x)} AS zf{x}"


def _edge_sql(x: str) -> str:
    return f"""CASE WHEN {x} IS NOT NULL THEN z{x} ELSE least(-3.0, coalesce(zl{x}, -3.0)) END AS z{x},
  coalesce(zf{x}, least(0.0, coalesce(zn{x}, zl{x}, 0.0))) AS e{x}, zn{x}, {x}"""


def _above_sql(x: str) -> str:
    top = f"greatest(coalesce(zn{x}, e{x}), e{x})"
    return f"z{x}, e{x}, {x} IS NOT NULL AND z{x} >= e{x} AS o{x}, CASE WHEN {top} > e{x} THEN (z{x} - e{x}) / ({top} - e{x}) ELSE 1 + z{x} - e{x} END AS y{x}"


def _bounded_sql(x: str) -> str:
    log = lambda z: f"-(ln(1 + exp(-abs({z}))) + greatest(-({z}), 0))"
    above = f"CASE WHEN y{x} > 1 THEN 1 + ln(greatest(y{x}, 1.0)) ELSE y{x} END"
    return f"""CASE WHEN o{x} THEN {log(f"2.9444389791664403 * ({above})")} ELSE {log(f'z{x}')} - ({log(f'e{x}')}) - ln(2.0) END AS log{x},
  CASE WHEN o{x} THEN {above} ELSE z{x} - e{x} END AS plain{x}"""


_RANKING = f"""
WITH best AS (
  SELECT query_id, doc_id,
         max(CASE WHEN NOT isnan(base_score) THEN base_score END) AS b,
         max(CASE WHEN NOT isnan(ce_norm) THEN ce_norm END) AS c
  FROM pool WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY query_id, doc_id),
centre AS (
  SELECT query_id, quantile_disc(b, 0.5) AS mb, quantile_disc(c, 0.5) AS mc, min(b) AS lb, min(c) AS lc,
         list_sort(list(b) FILTER (b IS NOT NULL), 'DESC')[3] AS nb, list_sort(list(c) FILTER (c IS NOT NULL), 'DESC')[3] AS nc,
         list_sort(list(b) FILTER (b IS NOT NULL), 'DESC')[20] AS fb, list_sort(list(c) FILTER (c IS NOT NULL), 'DESC')[20] AS fc
  FROM best GROUP BY query_id),
spread AS (
  SELECT query_id, quantile_disc(abs(b - mb), 0.5) AS ab, quantile_disc(abs(c - mc), 0.5) AS ac,
         avg(abs(b - mb)) AS eb, avg(abs(c - mc)) AS ec
  FROM best JOIN centre USING (query_id) GROUP BY query_id),
scale AS (
  SELECT centre.*, CASE WHEN ab > 0 THEN ab * 1.4826 WHEN eb > 0 THEN eb * 1.2533 END AS db,
         CASE WHEN ac > 0 THEN ac * 1.4826 WHEN ec > 0 THEN ec * 1.2533 END AS dc
  FROM centre JOIN spread USING (query_id)),
standard AS (SELECT query_id, doc_id, {_standard_sql('b')}, {_standard_sql('c')} FROM best JOIN scale USING (query_id)),
edges AS (SELECT query_id, doc_id, {_edge_sql('b')}, {_edge_sql('c')} FROM standard),
above AS (SELECT query_id, doc_id, {_above_sql('b')}, {_above_sql('c')} FROM edges),
bounded AS (SELECT query_id, doc_id, {_bounded_sql('b')}, {_bounded_sql('c')} FROM above),
fused AS (SELECT query_id, doc_id, round((plainb + plainc) / 2, 9) AS plain, round((logb + logc) / 2, 12) AS log FROM bounded)
SELECT query_id, doc_id, round(exp(log), 9) AS fused,
       row_number() OVER (PARTITION BY query_id ORDER BY log DESC, plain DESC, doc_id) AS position
FROM fused
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_top10": p1_top10,
        "p1_top10_hot": p1_top10_hot,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p3_rejoined": p3_rejoined,
        "p3_rejoined_tokens": p3_rejoined_tokens,
        "p4_found": p4_found,
        "p4_ranking": p4_ranking,
        "p4_ranking_hot": p4_ranking_hot,
        "p6_ids": p6_ids,
        "p6_roundtrip": p6_roundtrip,
        "p7_mix": p7_mix,
        "p7_report": p7_report,
        "p7_invariants": p7_invariants,
        "p8_found": p8_found,
        "p8_languages": p8_languages,
    }


def oracle_sql() -> dict[str, str]:
    top10 = _TOP10 + "SELECT query_id, doc_id, ce_norm, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"
    return {
        "p1_found": _TOP10 + "SELECT query_id, doc_id FROM ranked WHERE rank <= 10",
        "p1_top10": top10,
        "p1_top10_hot": top10,
        "p3_found": _boundary_sql(),
        "p3_rejoined": _REJOINED,
        "p3_rejoined_tokens": _REJOINED,
        "p4_found": _PLACES,
        "p4_ranking": _RANKING,
        "p4_ranking_hot": _RANKING,
        "p7_invariants": 'SELECT source, CAST(0 AS BIGINT) AS "foreign", CAST(0 AS BIGINT) AS over_used, CAST(0 AS BIGINT) AS repeated, false AS off_target FROM mix_targets',
        "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
