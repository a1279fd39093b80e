"""Evaluation analytics: retrieval metrics, paired statistics, classifiers, drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LADDER = (5, 10, 20, 50)
#: A ratio is a regression beyond these.
LATENCY_RISE, RECALL_DROP, HISTORY = 0.15, 0.03, 10
#: Questions a class must have for a verdict, and what the low end of its gain must exceed.
LEAST_QUESTIONS, SUFFICIENT_GAIN = 30, 0.04


def recall_ladder(ranked: DataFrame, gold: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(qid, k, recall, all_found): share of a query's distinct gold ids within its first k, for each k.

    ranked: qid, id, rank. gold: qid, id. A query without gold has no row; one without hits has 0.
    """
    wanted = gold.select("qid", "id").distinct()
    best = ranked.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    met = wanted.join(best, ["qid", "id"], "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in ladder))))
    hit = F.count_if(F.col("rank") <= F.col("k"))
    return met.groupBy("qid", "k").agg(
        F.round(hit / F.count(F.lit(1)), 6).alias("recall"), (hit == F.count(F.lit(1))).alias("all_found")
    )


def evidence_recall(ranked: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(qid, strict, graded, supporting): recall of a query's required evidence within its first k ranks, and of the supporting one.

    ranked: qid, id, rank; repeated ids use up ranks. evidence: qid, id, necessity (required or supporting), per distinct
    document. strict is 1 if everything required is there. A query without required evidence has strict and graded
    1; without supporting evidence, supporting NULL.
    """
    wanted = evidence.groupBy("qid", "id").agg(F.bool_or(F.col("necessity") == "required").alias("req"), F.bool_or(F.col("necessity") == "supporting").alias("sup"))
    hits = ranked.where(F.col("rank") <= k).select("qid", "id", F.lit(True).alias("hit")).distinct()
    hit = F.coalesce("hit", F.lit(False))
    sums = wanted.join(hits, ["qid", "id"], "left").groupBy("qid").agg(
        F.count_if("req").alias("r"), F.count_if(F.col("req") & hit).alias("rh"), F.count_if("sup").alias("s"), F.count_if(F.col("sup") & hit).alias("sh")
    )
    return sums.select(
        "qid",
        F.when(F.col("rh") == F.col("r"), 1.0).otherwise(0.0).alias("strict"),
        F.round(F.when(F.col("r") == 0, 1.0).otherwise(F.col("rh") / F.col("r")), 6).alias("graded"),
        F.round(F.when(F.col("s") > 0, F.col("sh") / F.col("s")), 6).alias("supporting"),
    )


def normal_interval(df: DataFrame, group: str, value: str, z: float = 1.96) -> DataFrame:
    """(group, n, mean, low, high): each group's mean and its interval of z standard errors (of the sample); of one value, the value."""
    spread = F.coalesce(F.stddev_samp(value), F.lit(0.0)) * z / F.sqrt(F.count(value))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), spread.alias("w")).select(
        group, "n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.col("w"), 6).alias("low"), F.round(F.col("mean") + F.col("w"), 6).alias("high")
    )


def clears_floor(high: Column, floor: float) -> Column:
    """The recall gate: a measured recall fails only if the upper end of its interval lies below the floor."""
    return F.coalesce(high >= floor, F.lit(False))


def sufficiency(classes: DataFrame, least: int = LEAST_QUESTIONS, threshold: float = SUFFICIENT_GAIN) -> DataFrame:
    """classes (class, n, low) with a verdict each, and a row with a NULL class for all of them.

    A class of fewer than ``least`` questions is UNDERPOWERED, one without an interval NO_DATA; it is SUFFICIENT if the low end of
    its gain's interval is above the threshold, else CEILING_ABSORBED. Overall one sufficient class is enough;
    without one it is CEILING_ABSORBED if any class was, else INCONCLUSIVE.
    """
    verdict = (
        F.when(F.col("n") < least, "UNDERPOWERED").when(F.col("low").isNull(), "NO_DATA").when(F.col("low") > threshold, "SUFFICIENT").otherwise("CEILING_ABSORBED")
    )
    each = classes.select("class", verdict.alias("verdict"))
    any_of = lambda v: F.count_if(F.col("verdict") == v) > 0
    overall = F.when(any_of("SUFFICIENT"), "SUFFICIENT").when(any_of("CEILING_ABSORBED"), "CEILING_ABSORBED").otherwise("INCONCLUSIVE")
    return each.unionByName(each.agg(overall.alias("verdict")).withColumn("class", F.lit(None).cast(classes.schema["class"].dataType)))


def measurable(k: Column, limit: Column, most: int = 100) -> Column:
    """Whether recall at depth k can be measured under a result limit: yes, raise the limit, or never (beyond what any search gives)."""
    return F.when(k <= limit, "yes").when(k > most, "never").otherwise("raise the limit")


def graph_coverage(mentions: DataFrame, least: float = 1.0) -> DataFrame:
    """One row on how well a mention graph covers its questions. mentions: question, names (array), one row per question.

    questions, covered (with at least one name), coverage, entities, edges (pairs of names that meet in a question), the medians
    of both per question, and ok: something is covered, enough is, and there are edges.
    """
    names = F.array_distinct(F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    n = mentions.select(F.size(names).alias("n")).withColumn("e", F.expr("n * (n - 1) div 2"))
    out = n.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("n") > 0).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("edges"), F.percentile("n", 0.5).alias("median_entities"), F.percentile("e", 0.5).alias("median_edges"),
    )
    share = F.when(F.col("questions") > 0, F.col("covered") / F.col("questions")).otherwise(0.0)
    return out.withColumn("coverage", F.round(share, 6)).withColumn(
        "ok", (F.col("questions") > 0) & (share >= least) & (F.col("entities") > 0) & (F.col("edges") > 0)
    )


def build_gold(rows: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, dropped) of question rows (qa_id, question, negative, evidence) against the ids of a corpus (doc_id).

    gold: query_id, query, negative, required (the evidence that the corpus has, in its order; none for a negative). dropped:
    qa_id, reason: no id, an empty question, or evidence of which nothing is in the corpus.
    """
    asked = rows.select("qa_id", F.trim("question").alias("query"), F.coalesce("negative", F.lit(False)).alias("negative"), "evidence")
    reason = F.when(F.coalesce("qa_id", F.lit("")) == "", "missing qa_id").when(F.coalesce("query", F.lit("")) == "", "empty question")
    asked = asked.withColumn("reason", reason)
    at = asked.where("reason IS NULL AND NOT negative").select("qa_id", F.posexplode("evidence").alias("p", "doc_id"))
    there = at.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("qa_id").agg(F.sort_array(F.collect_set(F.struct("p", "doc_id"))).alias("x"))
    both = asked.join(there, "qa_id", "left").withColumn("required", F.array_distinct(F.transform("x", lambda e: e["doc_id"])))
    both = both.withColumn("reason", F.coalesce("reason", F.when(~F.col("negative") & F.col("required").isNull(), "no evidence in the corpus")))
    none = F.array().cast(rows.schema["evidence"].dataType)
    gold = both.where("reason IS NULL").select(F.col("qa_id").alias("query_id"), "query", "negative", F.coalesce(F.when(~F.col("negative"), F.col("required")), none).alias("required"))
    return gold, both.where("reason IS NOT NULL").select("qa_id", "reason")


def mrr_ndcg(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, hit, rr, ndcg): whether a gold id is within k, 1 / its first rank, and nDCG with gains of 1 and 1 / log2(rank + 1)."""
    wanted = gold.select("qid", "id").distinct()
    best = ranked.where(F.col("rank") <= k).groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    met = wanted.join(best, ["qid", "id"], "left").groupBy("qid").agg(
        F.min("rank").alias("first"),
        F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"),
        F.count(F.lit(1)).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return met.select(
        "qid",
        F.col("first").isNotNull().alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def by_class(metrics: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Mean of each metric per class and over all (a NULL class)."""
    return metrics.rollup(group).agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(v), 4).alias(v) for v in values))


def answer_form(text: Column) -> Column:
    """The words of an answer: lower case, without ASCII punctuation, without the articles a, an and the."""
    words = F.split(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\s+")
    return F.filter(words, lambda w: ~w.isin("", "a", "an", "the"))


def em_f1(df: DataFrame, key: str, answer: str, gold: str) -> DataFrame:
    """(key, em, f1): exact match and multiset word overlap of two texts; two empty texts match."""
    rows = df.select(F.col(key).alias("k"), answer_form(F.col(answer)).alias("a"), answer_form(F.col(gold)).alias("g"))
    rows = rows.select("k", "a", "g", (F.col("a") == F.col("g")).alias("em"))
    common = F.aggregate(
        F.array_distinct("a"),
        F.lit(0),
        lambda s, w: s + F.least(F.size(F.filter("a", lambda x: x == w)), F.size(F.filter("g", lambda x: x == w))),
    )
    rows = rows.withColumn("c", common)
    f1 = F.when(F.col("em"), 1.0).when(F.col("c") > 0, 2.0 * F.col("c") / (F.size("a") + F.size("g"))).otherwise(0.0)
    return rows.select(F.col("k").alias(key), F.col("em").cast("int").alias("em"), F.round(f1, 6).alias("f1"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, mean_delta, variance, ols_slope) of b - a over the keys both have, and the slope of b on a."""
    both = a.select(key, F.col(value).cast("double").alias("x")).join(b.select(key, F.col(value).cast("double").alias("y")), key)
    d = F.col("y") - F.col("x")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.var_pop(d), 6).alias("variance"),
        F.round(F.regr_slope("y", "x"), 6).alias("ols_slope"),
    )


def splitmix64(seed: int, n: int) -> np.ndarray:
    """n values of the published splitmix64 stream."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bootstrap_interval(values: np.ndarray, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Bounds of the mean by order statistics at truncated places of the resampled means."""
    n = len(values)
    picks = (splitmix64(seed, resamples * n) % np.uint64(n)).astype(np.int64).reshape(resamples, n)
    means = np.sort(values[picks].mean(axis=1))
    tail = (1 - level) / 2
    return float(means[int(tail * resamples)]), float(means[min(resamples - 1, int((1 - tail) * resamples))])


def bootstrap(df: DataFrame, group: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(group, n, mean, low, high): each group's mean with its bootstrap interval.

    Only a group's distinct values and their counts meet in a task, so its size is that of its
    distinct metric values, not of its queries: draws are multinomial over those.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    kind = df.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, c = pdf["v"].to_numpy(), pdf["c"].to_numpy()
        n = int(c.sum())
        draws = np.random.Generator(np.random.PCG64(seed)).multinomial(n, c / n, size=resamples)
        means = np.sort(draws @ v / n)
        low, high = means[int(0.025 * resamples)], means[min(resamples - 1, int(0.975 * resamples))]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [n], "mean": [float((v * c).sum() / n)], "low": [low], "high": [high]})

    return counted.groupBy(group).applyInPandas(one, f"`{group}` {kind}, n bigint, mean double, low double, high double")


def paired_mde(sd: float, rho: float, n: int, z_alpha: float = 1.959964, z_beta: float = 0.841621) -> float:
    """The least difference a paired comparison of n queries can show, rounded up to 0.01."""
    return float(np.ceil((z_alpha + z_beta) * sd * np.sqrt(2 * (1 - rho)) / np.sqrt(n) * 100 - 1e-9) / 100)


def decision(n: int, least: int, low: float, floor: float) -> str:
    """underpowered below ``least`` queries, else pass or fail by the lower bound against the floor."""
    return "underpowered" if n < least else ("pass" if low >= floor else "fail")


def kendall_tau(df: DataFrame, group: str, a: str, b: str, item: str) -> DataFrame:
    """(group, pairs, tau): rank correlation of two ranks within each group.

    Concordant pairs are counted by merging sorted runs in each group's task, in n log n, so pairs
    are never listed. Groups are ranked lists of bounded depth.
    """
    kind = df.schema[group].dataType.simpleString()

    def inversions(x: np.ndarray) -> int:
        if len(x) < 2:
            return 0
        left, right = x[: len(x) // 2], x[len(x) // 2 :]
        count = inversions(left) + inversions(right)
        left, right = np.sort(left), np.sort(right)
        return count + int((len(left) - np.searchsorted(left, right, side="right")).sum())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values([a, item])[b].to_numpy()
        n = len(y)
        total = n * (n - 1) // 2
        tau = 1 - 2 * inversions(y) / total if total else 1.0
        return pd.DataFrame({group: [pdf[group].iloc[0]], "pairs": [total], "tau": [round(tau, 6)]})

    rows = df.select(group, a, b, item).dropna()
    return rows.groupBy(group).applyInPandas(one, f"`{group}` {kind}, pairs bigint, tau double")


def nearest_centroid(docs: DataFrame, smooth: bool = True) -> DataFrame:
    """(id, label, predicted): TF-IDF vectors to the class centroid of greatest cosine; ties go to the first class.

    docs: id, terms, label; rows without label are not classified. idf is ln((1 + N) / (1 + df)) + 1.
    """
    n = docs.count()
    tf = docs.select("id", "label", F.explode("terms").alias("term")).groupBy("id", "label", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, "term").select("id", "label", "term", (F.col("tf") * (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "id").select("id", "label", "term", (F.col("w") / F.col("norm")).alias("w"))
    sizes = docs.where(F.size("terms") > 0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    centre = w.groupBy("label", "term").agg(F.sum("w").alias("s")).join(sizes, "label").select("label", "term", (F.col("s") / F.col("n")).alias("c"))
    length = centre.groupBy("label").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
    centre = centre.join(length, "label").select(F.col("label").alias("predicted"), "term", (F.col("c") / F.col("length")).alias("c"))
    scored = w.join(centre, "term").groupBy("id", "label", "predicted").agg(F.round(F.sum(F.col("w") * F.col("c")), 9).alias("score"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "predicted"))
    return scored.withColumn("r", best).where("r = 1").select("id", "label", "predicted")


def perf_drift(runs: DataFrame, history: int = HISTORY, recall: bool = False) -> DataFrame:
    """(series, latest, median, change, verdict): each series' latest value against the median of up to ``history`` before it.

    runs: series, at, sha, value: a latency, which regresses by a share of the median, or a ``recall``, which does by a
    drop of more than RECALL_DROP (change is the difference then). Fewer than two runs are insufficient. Latest is by time, then sha.
    """
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.col("at").desc(), F.col("sha").desc()))
    recent = runs.where("value IS NOT NULL").withColumn("r", place).where(F.col("r") <= history + 1)
    per = recent.groupBy("series").agg(
        F.max(F.when(F.col("r") == 1, F.col("value"))).alias("latest"), F.percentile(F.when(F.col("r") > 1, F.col("value")), 0.5).alias("median")
    )
    change = F.col("latest") - F.col("median") if recall else F.col("latest") / F.col("median") - 1
    worse = -change > RECALL_DROP if recall else change > LATENCY_RISE
    verdict = F.when(F.col("median").isNull(), "insufficient").when(worse, "regression").otherwise("ok")
    return per.select("series", F.round("latest", 6).alias("latest"), F.round("median", 6).alias("median"), F.round(change, 6).alias("change"), verdict.alias("verdict"))


def ceil_percentile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, value): the element at place ceil(q * n) of each group's sorted values."""
    return df.groupBy(group).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(value))


def folds(df: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """(key, label, fold): rows of each label dealt in turn, in an order fixed by the seed and the key."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(label).orderBy(order, key))
    return df.select(key, label).withColumn("fold", ((place - 1) % n).cast("int"))
