"""Rows that pass a shuffle where every query or root meets every document or node, and the results there against SQL."""

import math
import random
import sys
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import connect, rows  # noqa: E402

from lorespark.operators import passages  # noqa: E402
from lorespark.plans import catalog  # noqa: E402

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
ODD = ["bm25_harness", "bm25_b_sweep", "projected_text", "bm25f_fielded", "tfidf_cosine", "bm25_body", "match_all_terms"]


def shuffled(spark, name, sf):
    """(rows of the query, rows written to shuffles meanwhile)."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (listed.apply(k) for k in range(listed.size()))}

    before = stages()
    got = QUERIES[name](spark, sf).toPandas()
    return got, sum(n for s, n in stages().items() if s not in before)


def same_as_sql(got, name, sf):
    assert rows(got) == rows(connect(sf).execute(SQL[name]).df())


@pytest.fixture(scope="module")
def hubs(tmp_path_factory):
    """2,200 users, 200 of them roots, who all share five topics."""
    folder, start = tmp_path_factory.mktemp("hubs"), datetime(2024, 1, 1)
    users = [q * 100 + k for q in range(200) for k in range(11)]
    rows = [(u, k) for u in users for k in range(5)]
    table = {
        "event_id": pa.array(range(len(rows))),
        "ts": pa.array([start + timedelta(seconds=i) for i in range(len(rows))], pa.timestamp("us")),
        "user_id": pa.array([u for u, _ in rows]),
        "event_type": pa.array(["view"] * len(rows)),
        "props": pa.array([f'{{"k": {k}}}' for _, k in rows]),
    }
    pq.write_table(pa.table(table), folder / "events.parquet")
    return str(folder)


def few_rows_for_hubs(spark, name, hubs, most):
    got, n = shuffled(spark, name, hubs)
    assert n < most
    same_as_sql(got, name, hubs)


def test_bfs_depth2_both_does_not_expand_hubs(spark, hubs):
    few_rows_for_hubs(spark, "bfs_depth2_both", hubs, 150_000)


def test_bfs_depth3_both_does_not_expand_hubs(spark, hubs):
    few_rows_for_hubs(spark, "bfs_depth3_both", hubs, 200_000)


def test_bfs_min_hop_walks_an_edge_once_for_many_roots(spark, hubs):
    few_rows_for_hubs(spark, "bfs_min_hop", hubs, 200_000)


def test_graph_arm_does_not_expand_hubs(spark, hubs):
    few_rows_for_hubs(spark, "graph_arm", hubs, 1_500_000)


def text_tables(folder, ids, owners):
    """Documents, nodes and attributes of few words, so that nearly every document has a term of every query; embeddings of some."""
    dice = random.Random(7)
    words = [f"{a}{b}" for a in ("bor", "cal", "dim", "fen", "gor", "hul", "jas", "kel") for b in ("an", "eth", "ion", "o7", "ur")]
    say = lambda n: " ".join(dice.choices(words, k=n))
    texts = [None if k % 97 == 5 else say(30) for k in range(len(ids))]
    titles = [None if k % 101 == 7 else say(6) for k in range(len(ids))]
    whole = [i for i in ids if i is not None]
    tables = {
        "documents": {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "title": pa.array(titles)},
        "embeddings": {
            "vec_id": pa.array(sorted(set(whole))[:40], pa.int64()),
            "embedding": pa.array([[dice.gauss(0, 1) for _ in range(4)] for _ in sorted(set(whole))[:40]], pa.list_(pa.float32())),
            "label": pa.array([k % 5 for k in range(len(sorted(set(whole))[:40]))], pa.int32()),
        },
        "canonical_nodes": {
            "write_cursor": pa.array(ids, pa.int64()),
            "kind": pa.array([dice.choice(["task", "note", None]) for _ in ids]),
            "body": pa.array([f'{{"title":"{say(6)}","note":"{say(20)}","status":"{dice.choice(["done", "open"])}"}}' for _ in ids]),
            "superseded_at": pa.array([None] * len(ids), pa.int64()),
            "state": pa.array(["active"] * len(ids)),
            "importance": pa.array([dice.random() for _ in ids]),
        },
        "canonical_attributes": {
            "write_cursor": pa.array(ids, pa.int64()),
            "attr_name": pa.array(["owner"] * len(ids)),
            "attr_value": pa.array([dice.choice(owners) for _ in ids]),
            "landed_at": pa.array([datetime(2026, 1, 1) + timedelta(seconds=k) for k in range(len(ids))], pa.timestamp("us")),
        },
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    """1,000 documents, each of which is a query."""
    return text_tables(tmp_path_factory.mktemp("texts"), [k * 100 for k in range(1, 1_001)], ["mira holt", "ansel holt", "mira brand", "holt brand"])


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Ids that come more than once, with the same or another text, and NULL ids."""
    ids = [100, 100, 200, 200, 200, None, None, *range(300, 360), 300, 300, 400, 500, 500]
    return text_tables(tmp_path_factory.mktemp("odd"), ids, ["mira holt", "ansel"])


def few_rows_for_texts(spark, name, texts, most):
    got, n = shuffled(spark, name, texts)
    assert n < most
    same_as_sql(got, name, texts)


def most_rows(df):
    """The most rows that one operator of df, which ran, put out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_bm25_harness_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "bm25_harness", texts, 200_000)


@pytest.mark.parametrize("name", ODD)
def test_repeated_and_null_ids(spark, odd, name):
    same_as_sql(QUERIES[name](spark, odd).toPandas(), name, odd)


def test_bm25_b_sweep_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "bm25_b_sweep", texts, 200_000)


def test_bm25f_fielded_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "bm25f_fielded", texts, 200_000)


def test_projected_text_has_no_row_for_each_pair(spark, texts):
    df = QUERIES["projected_text"](spark, texts)
    assert len(df.collect()) == most_rows(df) == 100_000
    same_as_sql(df.toPandas(), "projected_text", texts)


def test_tfidf_cosine_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "tfidf_cosine", texts, 200_000)


def test_bm25_body_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "bm25_body", texts, 200_000)


def test_match_all_terms_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "match_all_terms", texts, 200_000)


def test_fused_rerank_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "fused_rerank", texts, 500_000)


def test_hybrid_search_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "hybrid_search", texts, 500_000)


def test_rrf_harness_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "rrf_harness", texts, 500_000)


def test_importance_reweight_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "importance_reweight", texts, 500_000)


def test_rrf_three_arm_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "rrf_three_arm", texts, 500_000)


def test_ce_blend_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "ce_blend", texts, 500_000)


def test_recency_reweight_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "recency_reweight", texts, 500_000)


def test_rrf_two_arm_shuffles_the_best_only(spark, texts):
    few_rows_for_texts(spark, "rrf_two_arm", texts, 500_000)


def plain_passages(docs, asked, seeds=10, k=60):
    """docs: id -> (words, names); asked: qid -> words. The rows of ppr_passages, worked out pair by pair."""
    n, mean = len(docs), sum(len(w) for w, _ in docs.values()) / len(docs)
    count = lambda t: sum(t in w for w, _ in docs.values())
    linked = defaultdict(set)
    for _, names in docs.values():
        for a in names:
            linked[a] |= names - {a}
    places = lambda score: {d: p for p, d in enumerate(sorted(score, key=lambda d: (-score[d], d)), 1)}
    out = []
    for qid, terms in asked.items():
        idf = {t: math.log(1 + (n - count(t) + 0.5) / (count(t) + 0.5)) for t in set(terms)}
        lexical = {
            d: round(sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in idf if t in w), 9)
            for d, (w, _) in docs.items() if set(w) & set(idf)
        }
        text = places(lexical)
        first = set().union(*(docs[d][1] for d in text if text[d] <= seeds))
        start = {m: max(math.log((n + 1) / (sum(m in x for _, x in docs.values()) + 0.5)), 1e-6) for m in first}
        start = {m: w / sum(start.values()) for m, w in start.items()}
        mass = dict(start)
        for _ in range(200):
            came = defaultdict(float)
            for a, x in mass.items():
                for b in linked[a]:
                    came[b] += 0.85 * x / len(linked[a])
            mass = {m: came[m] + start.get(m, 0) * (1 - sum(came.values())) for m in came.keys() | start.keys()}
        named = {d: round(sum(mass.get(m, 0) for m in names), 6) for d, (_, names) in docs.items()}
        graph = places({d: x for d, x in named.items() if x > 0})
        fused = {d: round(sum(1 / (k + p[d]) for p in (text, graph) if d in p), 9) for d in text.keys() | graph.keys()}
        out += [(qid, d, fused[d], p) for d, p in places(fused).items()]
    return sorted(out)


def test_ppr_passages_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    """150 titles, in several tasks, meet nearly all of 120 passages; one passage is blank, one name is alone, and bodies repeat."""
    monkeypatch.setattr(passages, "SETS", 20)
    rng = random.Random(4)
    words, people = [f"word{k}" for k in range(12)], [f"name{k}" for k in range(9)]
    bodies = {f"{k:03x}": [rng.choice(words) for _ in range(rng.randrange(1, 12))] for k in range(117)}
    bodies |= {"0ff": bodies["001"], "1ff": [], "2ff": ["word1"]}
    named = {d: set(rng.sample(people, rng.randrange(3))) for d in bodies} | {"2ff": {"alone"}}
    titles = {100 * (q + 1): [rng.choice(words) for _ in range(3)] for q in range(148)} | {20_000: ["word1"], 20_100: ["unheard"]}
    texts = {
        "doc_id": pa.array(list(bodies)), "body": pa.array([" ".join(w) for w in bodies.values()]),
        "modified_at": pa.array(["2024"] * len(bodies)), "people_mentions": pa.array([sorted(named[d]) for d in bodies], pa.list_(pa.string())),
    }
    pq.write_table(pa.table(texts), tmp_path / "corpus_docs.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(list(titles)), "title": pa.array([" ".join(w) for w in titles.values()])}), tmp_path / "documents.parquet")
    assert len(QUERIES["ppr_passages"](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().collect()) > 3
    got, n = shuffled(spark, "ppr_passages", str(tmp_path))
    wanted = plain_passages({d: (w, named[d]) for d, w in bodies.items()}, titles)
    assert len(wanted) > 10_000
    assert n < 5_000
    assert sorted(got[["qid", "id", "score", "rank"]].itertuples(index=False, name=None)) == wanted
