"""Rank fusion, reweighting and rerank blending."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The engine's constant and the weights of its arms; the evaluation harness uses 60 and no weights.
RRF_K = 30.0
ARM_WEIGHTS = {"vector": 1.0, "text": 3.0, "graph": 1.0}
HARNESS_K = 60.0
RECENCY_WEIGHT = 0.002


@dataclass(frozen=True)
class Arm:
    """One ranked list per query: qid, key (what is fused: the body), id, rank."""

    name: str
    rows: DataFrame
    weight: float = 1.0


def rrf(arms: list[Arm], k: float = RRF_K) -> DataFrame:
    """(qid, key, id, score, rank, <arm>_rank...): reciprocal ranks summed over the arms.

    A key counts once per arm, with its best rank. The id shown is that of the first arm that has the
    key; order is score, then that arm, then that arm's rank, then id.
    """
    parts = None
    for place, arm in enumerate(arms):
        rows = arm.rows.groupBy("qid", "key").agg(F.min(F.struct("rank", "id")).alias("b"))
        rows = rows.select("qid", "key", F.lit(place).alias("arm"), F.col("b.rank").alias("r"), F.col("b.id").alias("id"), F.lit(arm.weight).alias("w"))
        parts = rows if parts is None else parts.unionByName(rows)
    fused = parts.groupBy("qid", "key").agg(
        F.round(F.sum(F.col("w") / (k + F.col("r"))), 9).alias("score"),
        F.min(F.struct("arm", "r", "id")).alias("shown"),
        *(F.min(F.when(F.col("arm") == p, F.col("r"))).alias(f"{a.name}_rank") for p, a in enumerate(arms)),
    )
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "shown.arm", "shown.r", "shown.id")
    return fused.withColumn("rank", F.row_number().over(order)).select(
        "qid", "key", F.col("shown.id").alias("id"), "score", "rank", *(f"{a.name}_rank" for a in arms)
    )


def _again(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank")
    return df.withColumn("rank", F.row_number().over(order))


def recency(hits: DataFrame, cursor: str = "write_cursor", weight: float = RECENCY_WEIGHT) -> DataFrame:
    """Adds weight times the cursor's place between the query's oldest and newest hit; one cursor alone adds nothing."""
    w = Window.partitionBy("qid")
    low, high = F.min(cursor).over(w), F.max(cursor).over(w)
    part = F.when(high > low, (F.col(cursor) - low) / (high - low)).otherwise(0.0)
    return _again(hits.withColumn("score", F.round(F.col("score") + weight * part, 9)))


def importance(hits: DataFrame, node: str = "importance", edge: str = "confidence") -> DataFrame:
    """Multiplies by importance and confidence; NULL is neutral, 0 is the floor."""
    factor = F.coalesce(F.col(node), F.lit(1.0)) * F.coalesce(F.col(edge), F.lit(1.0))
    return _again(hits.withColumn("score", F.round(F.col("score") * factor, 9)))


def rerank_blend(hits: DataFrame, logit: str, depth: int, alpha: float = 0.3, pool: int | None = None) -> DataFrame:
    """Blends the first hits' fused score with a reranker's: alpha * sigmoid + (1 - alpha) * min-max.

    alpha is kept within 0..1; of equal fused scores all count 1; hits beyond the pool follow in
    their order with a NULL ce_score; depth 0 changes nothing.
    """
    size = min(pool if pool is not None else depth, 10**9)
    if depth == 0:
        return hits.withColumn("ce_score", F.lit(None).cast("double"))
    alpha = min(1.0, max(0.0, alpha))
    inside = F.col("rank") <= size
    w = Window.partitionBy("qid")
    low = F.min(F.when(inside, F.col("score"))).over(w)
    high = F.max(F.when(inside, F.col("score"))).over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    ce = 1 / (1 + F.exp(-F.col(logit)))
    blended = hits.withColumn("ce_score", F.when(inside, F.round(alpha * ce + (1 - alpha) * scaled, 9)))
    order = w.orderBy(F.when(inside, 0).otherwise(1), F.col("ce_score").desc_nulls_last(), "rank")
    return blended.withColumn("rank", F.row_number().over(order))


def fused_rerank(arms: list[Arm], reranker: Callable[[DataFrame], DataFrame], depth: int, alpha: float = 0.3) -> DataFrame:
    """The evaluation harness's pool, fused without weights, whose first ``depth`` a reranker puts in order; the others follow as they
    were. reranker adds a column logit. Columns of rrf, with rank the new and fused_rank the old place."""
    pool = reranker(rrf(arms, HARNESS_K)).withColumn("fused_rank", F.col("rank"))
    return rerank_blend(pool, "logit", depth, alpha)


def pooled(passages: DataFrame, how: str) -> DataFrame:
    """(qid, doc, score, rank): a document's score from its passages' (qid, doc, score): max, mean or mean of two best."""
    score = {
        "max": F.max("score"),
        "mean": F.avg("score"),
        "top2": (F.col("t")[0] + F.coalesce(F.get(F.col("t"), F.lit(1)), F.col("t")[0])) / 2,
    }
    if how == "top2":
        best = passages.withColumn("n", F.row_number().over(Window.partitionBy("qid", "doc").orderBy(F.col("score").desc()))).where("n <= 2")
        docs = best.groupBy("qid", "doc").agg(F.sort_array(F.collect_list("score"), False).alias("t")).select("qid", "doc", score["top2"].alias("score"))
    else:
        docs = passages.groupBy("qid", "doc").agg(score[how].alias("score"))
    docs = docs.withColumn("score", F.round("score", 9))
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")))
