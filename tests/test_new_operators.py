import json

import pytest
from pyspark.sql import functions as F

from lorespark.functions.stem import index_tokens
from lorespark.operators import evals as E
from lorespark.operators import vector as V
from lorespark.sources.corpus import corpus_items, read_chains, read_history


def test_history_is_read_strictly(spark, tmp_path):
    good = {"commit_sha": "c1", "ac_id": "AC-1", "n": 10, "p50_ms": 5.0, "recall": 0.9, "timestamp": "2026-02-28T10:00:00Z"}
    bad = [
        good | {"timestamp": "2026-02-30T10:00:00Z"}, good | {"timestamp": "2026-02-28"}, good | {"timestamp": "2026-02-28T10:00:00+24:00"},
        {k: v for k, v in good.items() if k not in ("p50_ms", "recall")}, {k: v for k, v in good.items() if k != "n"},
    ]
    for i, x in enumerate([good, good | {"commit_sha": "c2", "timestamp": "2026-03-01T00:00:00.5+01:00", "p50_ms": 9.0, "recall": 0.86}, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    runs, rejected = read_history(spark, str(tmp_path))
    assert sorted(r.reason for r in rejected.collect()) == ["incomplete", "no metric", "timestamp", "timestamp", "timestamp"]
    latency = E.perf_drift(runs.where("metric = 'p50_ms'")).first()
    assert (latency.series, latency.latest, latency.median, latency.verdict) == ("AC-1/10", 9.0, 5.0, "regression")
    assert E.perf_drift(runs.where("metric = 'recall'"), recall=True).first().verdict == "regression"


def test_gold_and_evidence(spark):
    rows = spark.createDataFrame(
        [("q1", " one ", False, ["a", "x", "b", "a"]), ("q2", "two", True, ["a"]), ("q3", "three", False, ["x"]), (None, "n", False, ["a"]), ("q5", " ", False, ["a"]), ("q6", "six", None, None)],
        "qa_id string, question string, negative boolean, evidence array<string>",
    )
    gold, dropped = E.build_gold(rows, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "doc_id string"))
    assert {(r.query_id, r.query, r.negative, tuple(r.required)) for r in gold.collect()} == {("q1", "one", False, ("a", "b")), ("q2", "two", True, ())}
    assert {(r.qa_id, r.reason) for r in dropped.collect()} == {
        ("q3", "no evidence in the corpus"), (None, "missing qa_id"), ("q5", "empty question"), ("q6", "no evidence in the corpus")
    }
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "qid string, id string, rank int")
    evidence = spark.createDataFrame([("q", "a", "required"), ("q", "b", "required"), ("q", "c", "supporting"), ("none", "c", "supporting")], "qid string, id string, necessity string")
    got = {r.qid: (r.strict, r.graded, r.supporting) for r in E.evidence_recall(ranked, evidence, 2).collect()}
    assert got == {"q": (0.0, 0.5, 0.0), "none": (1.0, 1.0, 0.0)}  # the repeated id uses up the second place


def test_verdicts(spark):
    c = spark.createDataFrame([("a", 30, 0.05), ("b", 30, 0.04), ("c", 29, 0.9), ("d", 50, None)], "class string, n bigint, low double")
    got = {r["class"]: r.verdict for r in E.sufficiency(c).collect()}
    assert got == {"a": "SUFFICIENT", "b": "CEILING_ABSORBED", "c": "UNDERPOWERED", "d": "NO_DATA", None: "SUFFICIENT"}
    assert {r["class"]: r.verdict for r in E.sufficiency(c.where("class = 'c'")).collect()}[None] == "INCONCLUSIVE"
    rows = spark.createDataFrame([(0.88,), (0.9,), (0.925,), (None,)], "h double").select(E.clears_floor(F.col("h"), 0.9).alias("ok")).collect()
    assert [r.ok for r in rows] == [False, True, True, False]
    k = spark.createDataFrame([(10, 10), (11, 10), (101, 100)], "k int, l int").select(E.measurable(F.col("k"), F.col("l")).alias("m")).collect()
    assert [r.m for r in k] == ["yes", "raise the limit", "never"]


def test_chains_become_edges(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chain_id": "c", "doc_ids": ["d1", "d2", "d3"], "relation_type": "replies_to"}))
    (tmp_path / "e.json").write_text(json.dumps({"chain_id": "e", "doc_ids": ["d1"]}))
    docs = spark.createDataFrame([("d1", "note", "t", "b", "2026", "p"), ("d1", "note", "t", "new", "2027", "p"), (None, "x", "", "", None, None), ("d2", "email", None, None, None, None)],
                                 "doc_id string, source_type string, title string, body string, modified_at string, provenance string")
    nodes, edges = corpus_items(docs, read_chains(spark, str(tmp_path)))
    assert {(r.logical_id, r.kind, r.source_id) for r in nodes.collect()} == {("d1", "note", "corpus:p"), ("d2", "email", "corpus:unknown")}
    assert json.loads(nodes.where("logical_id = 'd1'").first().body)["body"] == "new"
    assert {(r.from_id, r.to_id, r.kind) for r in edges.collect()} == {("d2", "d1", "replies_to"), ("d3", "d2", "replies_to")}


def test_stemming_does_not_lower_recall():
    """Every text that shares a plain word with a query still shares an index term with it, and inflected forms come in."""
    texts = ["The budgets were reviewed", "running plans", "Crème brûlée recipes", "meetings and travelling"]
    plain = lambda t: set(t.lower().split())
    for query, more in (("budgets", "budget"), ("plans", "plan"), ("recipes", "recipe"), ("meetings", "meeting"), ("travelling", "travelled")):
        before = {t for t in texts if plain(t) & plain(query)}
        for form in (query, more):
            after = {t for t in texts if set(index_tokens(t)) & set(index_tokens(form))}
            assert before <= after


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_measured_candidates_reach_the_floor(spark, table):
    v = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    size = V.candidates_for(v, v.where("id % 100 = 50").select(F.col("id").alias("qid"), "v"), 10)
    both = V.nearest(v, q, 10).select("qid", "id").join(V.two_phase(v, q, 10, candidates=size).select("qid", "id"), ["qid", "id"], "left_semi").count()
    assert both >= 0.9 * 10 * q.count()
