"""Bounded traversal, graph-arm candidates and personalised PageRank."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.errors import InvalidLimitError
from lorespark.operators.predicates import checked_limit
from lorespark.operators.skew import positions
from lorespark.runtime import filesystem, scratch_path, written

CAP = 50
MOST_HOPS = 3


def live_edges(edges: DataFrame, now: int, fallback: bool = True) -> DataFrame:
    """Current edges that have not expired; without those of uncertain time if ``fallback`` is False."""
    rows = edges.where(F.col("superseded_at").isNull() & (F.col("t_invalid").isNull() | (F.col("t_invalid") > F.lit(now))))
    return rows if fallback else rows.where(~F.coalesce("temporal_fallback", F.lit(False)))


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): from where to where an edge leads in the given direction (outgoing, incoming, both)."""
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction {direction}")
    found = {"outgoing": out, "incoming": back, "both": out.unionAll(back)}[direction]
    return found.where("a IS NOT NULL AND b IS NOT NULL").distinct()


def neighbours(
    edges: DataFrame, roots: DataFrame, depth: int, direction: str = "outgoing", allowed: DataFrame | None = None, cap: int | None = CAP
) -> DataFrame:
    """(root, id, hop): what each root reaches within ``depth`` hops, with its least hop; the root itself is left out.

    ``allowed`` (id) lists the nodes that may be on a path; others block. Per root at most ``cap``
    ids come back, nearest first, then by id; with None all of them. What was reached is not walked from
    again, so cycles end. Roots: a table with a column root.
    """
    if isinstance(depth, bool) or not isinstance(depth, int) or not 1 <= depth <= MOST_HOPS:
        raise InvalidLimitError(f"depth must be 1..{MOST_HOPS}")
    step = steps(edges, direction)
    if allowed is not None:
        ids = allowed.select(F.col("id").alias("b")).distinct()
        step = step.join(ids, "b", "left_semi")
        roots = roots.join(allowed.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    step, roots = written(step.select("a", "b"), "graph-steps"), roots.select("root").distinct()
    return _all_reached(step, roots, depth) if cap is None else _nearest_reached(step, roots, depth, cap)


def _nearest_reached(step: DataFrame, roots: DataFrame, depth: int, cap: int) -> DataFrame:
    """The first ``cap`` of each root by hop, then id.

    A root that still wants m ids has seen cap + 1 - m, itself with them, so the first cap + 1 neighbours of any node
    hold all that it can take from there. A root with cap ids walks no further. No hub is expanded in full.
    """
    place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    step = step.withColumn("__p", place).where(F.col("__p") <= cap + 1).drop("__p")
    if depth > 1:
        step = written(step, "graph-steps-first")
    seen = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("hop"))
    for hop in range(1, depth + 1):
        ahead = seen.where(F.col("hop") == hop - 1)
        if hop > 1:
            wanting = seen.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select("root")
            ahead = ahead.join(wanting, "root", "left_semi")
        came = ahead.join(step, ahead["id"] == step["a"]).select("root", F.col("b").alias("id")).distinct().withColumn("hop", F.lit(hop))
        both = seen.unionByName(came).groupBy("root", "id").agg(F.min("hop").alias("hop"))
        order = F.row_number().over(Window.partitionBy("root").orderBy("hop", "id"))
        seen = both.withColumn("__p", order).where(F.col("__p") <= cap + 1).drop("__p")
        if hop < depth:
            seen = written(seen, "graph-seen")
    return seen.where("hop > 0")


def _all_reached(step: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """All that each root reaches. 64 roots are the bits of a number, so an edge is walked once for 64 of them."""
    numbered = written(roots.withColumn("n", F.monotonically_increasing_id()), "graph-roots")
    seen = numbered.groupBy(F.col("root").alias("id"), F.shiftright("n", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(n & 63 AS INT))")).alias("bits"))
    seen = seen.select("id", "word", "bits", F.col("bits").alias("new"))
    found = None
    for hop in range(1, depth + 1):
        ahead = seen.where("new <> 0")
        came = ahead.join(step, ahead["id"] == step["a"]).groupBy(F.col("b").alias("id"), "word").agg(F.bit_or("new").alias("came"))
        both = seen.select("id", "word", "bits").join(came, ["id", "word"], "full")
        had, got = F.coalesce("bits", F.lit(0).cast("bigint")), F.coalesce("came", F.lit(0).cast("bigint"))
        seen = written(both.select("id", "word", had.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(had)).alias("new")), "graph-bits")
        each = seen.where("new <> 0").select("id", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(new, i) & 1 = 1)")).alias("i"), "word")
        each = each.select("id", (F.shiftleft("word", 6) + F.col("i")).alias("n"), F.lit(hop).alias("hop"))
        found = each if found is None else found.unionByName(each)
    return found.join(numbered, "n").select("root", "id", "hop")


def search_expand(hits: DataFrame, edges: DataFrame, depth: int, limit: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, rank, hop): a query's first hits (hop 0) and what they reach both ways; a hit wins over a reached node.

    hits: qid, id, rank. depth 0 gives the hits alone. ``allowed`` (id): the nodes that may be on a path.
    """
    kept = hits.where(F.col("rank") <= checked_limit(limit)).select("qid", "id", "rank")
    first = kept.withColumn("hop", F.lit(0))
    if depth == 0:
        return first
    reached = neighbours(edges, kept.select(F.col("id").alias("root")).distinct(), depth, "both", allowed)
    more = kept.join(reached.withColumnRenamed("id", "to"), kept["id"] == reached["root"]).groupBy("qid", F.col("to").alias("id")).agg(
        F.min("rank").alias("rank"), F.min("hop").alias("hop")
    )
    return first.unionByName(more.join(kept.select("qid", "id"), ["qid", "id"], "left_anti"))


def graph_arm(
    edges: DataFrame, seeds: DataFrame, kinds: DataFrame, now: int, depth: int = 3, most_seeds: int = 10, allowed: DataFrame | None = None
) -> DataFrame:
    """(qid, id, weight, rank): candidates of the graph arm.

    seeds: qid, id, place; the first ``most_seeds`` of a query count. Edges of uncertain time are
    not walked. A node at hop h weighs 1 / (1 + h), times 0.3 if its kind (kinds: id, kind) is
    'unknown'; order is weight, then id. ``allowed`` (id): the nodes that may be on a path.
    """
    first = seeds.where(F.col("place") <= most_seeds)
    found = neighbours(live_edges(edges, now, fallback=False), first.select(F.col("id").alias("root")).distinct(), depth, "both", allowed)
    hops = first.join(found.withColumnRenamed("id", "to"), first["id"] == found["root"]).groupBy("qid", F.col("to").alias("id")).agg(F.min("hop").alias("hop"))
    kinds = kinds.groupBy("id").agg(F.max("kind").alias("kind"))
    weight = (1 / (1 + F.col("hop"))) * F.when(F.col("kind") == "unknown", 0.3).otherwise(1.0)
    scored = hops.join(kinds, "id", "left").withColumn("weight", F.round(weight, 9))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("weight").desc(), "id"))
    return scored.withColumn("rank", place).select("qid", "id", "weight", "rank")


def entity_graph(mentions: DataFrame) -> DataFrame:
    """(a, b, n), a < b: names that occur in one document, by how many documents. mentions: doc, names (array).

    Names are compared in lower case without blanks at their ends; a name does not meet itself.
    """
    names = F.array_sort(F.array_distinct(F.filter(F.transform("names", lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    listed = mentions.select("doc", names.alias("n")).where(F.size("n") > 1)
    # Each name meets the later ones of its own document; a document names few.
    met = listed.select("doc", "n", F.posexplode("n").alias("i", "a"))
    met = met.select("doc", "a", F.explode(F.slice("n", F.col("i") + 2, F.size("n"))).alias("b"))
    return met.groupBy("a", "b").agg(F.countDistinct("doc").alias("n"))


def seed_weights(members: DataFrame, passages: int, best: DataFrame) -> DataFrame:
    """(qid, id, weight): the names in a query's best passages, weighed by how few passages have them.

    members: doc, id (name), distinct. best: qid, doc.
    """
    df = members.groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.greatest(F.ln(F.lit(passages + 1) / (F.col("df") + 0.5)), F.lit(1e-6))
    return best.join(members, "doc").select("qid", "id").distinct().join(df, "id").select("qid", "id", weight.alias("weight"))


def passage_fusion(members: DataFrame, together: DataFrame, passages: int, lexical: DataFrame, seeds: int = 10, k: int = 60) -> DataFrame:
    """(qid, id, score, rank): passages by reciprocal rank of their lexical score and of the PageRank mass of the names in them.

    members: doc, id (name), distinct. together: a, b, names that meet, each pair once. lexical: qid,
    id (passage), score. The restart is the names of the first ``seeds`` passages. A passage without
    a score has no place in that ranking. Ties go to the smaller id.
    """
    lexical = written(positions(lexical.select("qid", "id", "score"), "qid", [F.col("score").desc(), F.col("id")], "rank"), "passages-lexical")
    best = lexical.where(F.col("rank") <= seeds).select("qid", F.col("id").alias("doc"))
    both = together.select("a", "b", F.lit(1.0).alias("w")).unionAll(together.select("b", "a", F.lit(1.0)))
    mass = pagerank_by_query(both, seed_weights(members, passages, best), 1_000, tolerance=1e-6)
    scores = mass.join(members, "id").groupBy("qid", F.col("doc").alias("id")).agg(F.round(F.sum("score"), 9).alias("score")).where("score > 0")
    placed = positions(written(scores, "passages-mass"), "qid", [F.col("score").desc(), F.col("id")], "rank")
    parts = lexical.select("qid", "id", "rank").unionByName(placed.select("qid", "id", "rank"))
    fused = parts.groupBy("qid", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))
    return positions(written(fused, "passages-fused"), "qid", [F.col("score").desc(), F.col("id")], "rank")


def pagerank(edges: DataFrame, restart: DataFrame, rounds: int = 20, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(id, score): personalised PageRank over directed (a, b, w) from restart (id, weight), with the nodes of score 0."""
    found = pagerank_by_query(edges, restart.withColumn("qid", F.lit(0)), rounds, alpha, tolerance)
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).union(restart.select("id")).distinct()
    return ids.join(found.drop("qid"), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def pagerank_by_query(edges: DataFrame, restart: DataFrame, rounds: int = 20, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(qid, id, score): personalised PageRank over directed (a, b, w) of each query from its own restart (qid, id, weight).

    Weights leaving a node share its score; a node nothing leaves gives its score back to the
    restart nodes. It stops after ``rounds``, or when the scores of no query move by ``tolerance``
    or more in total; if ``tolerance`` is not met by then, it warns. Nodes not reached have no row.
    Scores are written every round, which keeps the plan short and survives lost executors; those of
    the round before are removed.
    """
    spark = edges.sparkSession
    total = restart.groupBy("qid").agg(F.sum("weight").alias("total"))
    start = restart.groupBy("qid", "id").agg(F.sum("weight").alias("weight")).join(total, "qid")
    start = written(start.select("qid", "id", (F.col("weight") / F.col("total")).alias("p")), "pagerank-start")
    out = edges.groupBy("a").agg(F.sum("w").alias("out"))
    shares = written(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("out")).alias("share")), "pagerank-edges")
    scores, last = start.select("qid", "id", F.col("p").alias("score")), None
    for _ in range(rounds):
        came = scores.join(shares, scores["id"] == shares["a"]).groupBy("qid", F.col("b").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("c"))
        led = came.groupBy("qid").agg(F.sum("c").alias("led"))  # a query's scores sum to 1: what was not led on goes back
        back = start.join(led, "qid", "left").select("qid", "id", (F.col("p") * (1 - alpha * F.coalesce("led", F.lit(0.0)))).alias("score"), F.lit(0.0).alias("old"))
        nxt = came.select("qid", "id", (alpha * F.col("c")).alias("score"), F.lit(0.0).alias("old")).unionByName(back)
        nxt = nxt.unionByName(scores.select("qid", "id", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        path = scratch_path(spark, "pagerank")
        nxt.groupBy("qid", "id").agg(F.sum("score").alias("score"), F.sum("old").alias("old")).write.parquet(path)
        nxt = spark.read.parquet(path)
        scores = nxt.select("qid", "id", "score")
        if last is not None:
            fs, place = filesystem(spark, last)
            fs.delete(place, True)
        last = path
        if tolerance is not None:
            moved = nxt.groupBy("qid").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("m")).agg(F.max("m")).first()[0]
            if (moved or 0.0) < tolerance:
                return scores
    if tolerance is not None:
        warnings.warn(f"PageRank has not converged to {tolerance} in {rounds} rounds", stacklevel=2)
    return scores
