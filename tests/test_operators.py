import random
from itertools import combinations

import numpy as np
import pytest

from lorespark.errors import InvalidLimitError
from lorespark.functions.payload import check_schema, violations
from lorespark.functions.stem import index_tokens, stem
from lorespark.operators import evals, fusion, graph, records, text, vector
from lorespark.operators.skew import lower_medians, positions
from pyspark.sql import functions as F


def test_positions_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(6)
    got = {(r.g, r.i): r.p for r in positions(df, "g", [F.col("x").desc(), F.col("i")], "p").collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in order] == list(range(1, len(order) + 1))


def test_lower_medians(spark):
    rng = random.Random(7)
    rows = [("a", rng.gauss(0, 1), None) for _ in range(3001)] + [("b", float(i % 3), 1.0) for i in range(30_000)] + [("c", None, 2.0), ("d", 4.0, 5.0), ("d", 3.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {r.g: (r.x, r.y) for r in lower_medians(df, "g", ["x", "y"]).collect()}
    for g in "abcd":
        for k in (0, 1):
            have = sorted(r[k + 1] for r in rows if r[0] == g and r[k + 1] is not None)
            assert got[g][k] == (have[(len(have) - 1) // 2] if have else None)


def test_supersede_and_retention_with_hot_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, write_cursor bigint")
    want = {}
    for k, c in rows:
        later = [d for q, d in rows if q == k and d > c] if k else []
        want[c] = min(later, default=None)
    for hot in (10**9, 100):
        got = {r.write_cursor: r.superseded_at for r in records.supersede(df, ["k"], hot_rows=hot).collect()}
        assert got == want
        kept = {r.write_cursor for r in records.retention_sweep(df, "k", "write_cursor", 5, hot_rows=hot).collect()}
        assert kept == {c for k, c in rows if k is None or sum(q == k and d > c for q, d in rows) < 5}


def test_stems():
    cases = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good",
        "revival": "reviv", "adoption": "adopt", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener",
    }
    assert {w: stem(w) for w in cases} == cases
    assert index_tokens("Déjà vu: running_RUNS, 日本語!") == ["deja", "vu", "run", "run", "日本語"]
    assert index_tokens(None) == []


def test_query_terms(spark):
    asked = ["status of the alpha", 'alpha* AND "beta" NEAR(gamma)', "who are we", "", None, "a'; DROP TABLE x --", "Ab ab AB"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = {r.i: r.t for r in df.select("i", text.content_terms(F.col("q")).alias("t")).collect()}
    assert got[0] == ["status", "alpha"] and got[1] == ["alpha", "beta", "near", "gamma"] and got[2] == ["who", "are", "we"]
    assert got[3] == [] and got[4] == [] and got[5] == ["drop", "table"] and got[6] == ["Ab", "ab", "AB"]


def test_paragraph_chunks(spark):
    rows = [(0, "a" * 10 + "\n\n" + "b" * 10 + "\n\n" + "c" * 30), (1, ""), (2, "x" * 65), (3, "a\n\n\n\nb"), (4, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.paragraph_chunks(F.col("t"), 25).alias("c")).collect()}
    assert got[0] == ["a" * 10 + "\n\n" + "b" * 10, "c" * 25, "c" * 5]
    assert got[1] == [] and got[2] == ["x" * 25, "x" * 25, "x" * 15] and got[4] is None
    assert all(len(c) <= 25 for c in got[3])


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "id bigint, terms array<string>")
    asked = spark.createDataFrame([(1, ["x"])], "qid int, terms array<string>")
    assert text.bm25(docs, asked).collect() == []


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[5] = m[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(999, None)], "id bigint, v array<double>").repartition(5)
    asked = df.where("id % 10 = 0").select(F.col("id").alias("qid"), "v")
    got = {}
    for r in vector.nearest(df, asked, 7, block=4).collect():
        got.setdefault(r.qid, {})[r.rank] = r.id
    for q in range(0, 300, 10):
        d = np.round(np.sqrt(((m - m[q]) ** 2).sum(1)), 9)
        assert [got[q][k] for k in range(1, 8)] == sorted(range(300), key=lambda i: (d[i], i))[:7]
    assert vector.nearest(df, asked.where("false"), 3).collect() == []
    assert vector.nearest(df.where("false"), asked, 3).collect() == []


def test_fusion_rules(spark):
    arm = "qid int, key string, id bigint, rank int"
    v = spark.createDataFrame([(0, "agree", 1, 1), (0, "vonly", 2, 2), (0, "agree", 9, 3)], arm)
    t = spark.createDataFrame([(0, "agree", 3, 2), (0, "tonly", 4, 1)], arm)
    got = [r.key for r in fusion.rrf([fusion.Arm("vector", v, 1.0), fusion.Arm("text", t, 3.0)]).orderBy("rank").collect()]
    assert got == ["agree", "tonly", "vonly"]
    tie = fusion.rrf([fusion.Arm("vector", v.where("key = 'vonly'").withColumn("rank", F.lit(1))), fusion.Arm("text", t.where("key = 'tonly'"))])
    assert [r.key for r in tie.orderBy("rank").collect()] == ["vonly", "tonly"]  # an exact tie goes to the first arm
    hits = spark.createDataFrame([(0, 1, 0.01, 1), (0, 2, 0.01, 2)], "qid int, write_cursor bigint, score double, rank int")
    assert [r.write_cursor for r in fusion.recency(hits).orderBy("rank").collect()] == [2, 1]
    strong = spark.createDataFrame([(0, 9, 0.01, 2), (0, 1, 0.02, 1)], hits.schema)
    assert [r.write_cursor for r in fusion.recency(strong).orderBy("rank").collect()] == [1, 9]
    same = fusion.rerank_blend(hits.withColumn("logit", F.lit(0.0)), "logit", 0)
    assert [r.rank for r in same.orderBy("write_cursor").collect()] == [1, 2]


def test_cycles_caps_and_expiry(spark):
    rows = [("a", "b", None), ("b", "c", None), ("c", "a", None), ("a", "a", None), ("a", "gone", 5)] + [("hub", f"n{i:02d}", None) for i in range(60)]
    edges = spark.createDataFrame([(f, t, None, x, False) for f, t, x in rows], "from_id string, to_id string, superseded_at bigint, t_invalid bigint, temporal_fallback boolean")
    live = graph.live_edges(edges, 10)
    roots = spark.createDataFrame([("a",), ("hub",), ("nowhere",)], "root string")
    got = {}
    for r in graph.neighbours(live, roots, 3).collect():
        got.setdefault(r.root, {})[r.id] = r.hop
    assert got["a"] == {"b": 1, "c": 2} and len(got["hub"]) == 50 and "n59" not in got["hub"] and "nowhere" not in got
    for bad in (0, 4, True):
        with pytest.raises(InvalidLimitError):
            graph.neighbours(live, roots, bad)


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0)], "a string, b string, w double")
    restart = spark.createDataFrame([("a", 3.0), ("z", 1.0)], "id string, weight double")
    got = {r.id: r.score for r in graph.pagerank(edges, restart, 60, tolerance=1e-9).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["a"] > got["b"] > got["c"] > 0


def exact_pagerank(edges, restart, alpha=0.85):
    """Scores by solving the linear system, apart from the rounds."""
    ids = sorted({x for a, b, _ in edges for x in (a, b)} | set(restart))
    at, n = {x: i for i, x in enumerate(ids)}, len(ids)
    step, p = np.zeros((n, n)), np.zeros(n)
    for a, b, w in edges:
        step[at[b], at[a]] += w
    for x, w in restart.items():
        p[at[x]] = w / sum(restart.values())
    out = step.sum(0)
    step = np.where(out > 0, step / np.where(out > 0, out, 1), p[:, None])
    return dict(zip(ids, np.linalg.solve(np.eye(n) - alpha * step, (1 - alpha) * p), strict=True))


def test_pagerank_of_several_queries_converges(spark):
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "end", 1.0), ("a", "end", 3.0), ("other", "c", 1.0)]
    starts = {1: {"a": 3.0, "z": 1.0}, 2: {"c": 1.0, "other": 1.0}}
    restart = spark.createDataFrame([(q, i, w) for q, x in starts.items() for i, w in x.items()], "qid int, id string, weight double")
    got = graph.pagerank_by_query(spark.createDataFrame(rows, "a string, b string, w double"), restart, 200, tolerance=1e-6).collect()
    for q, x in starts.items():
        want, mine = exact_pagerank(rows, x), {r.id: r.score for r in got if r.qid == q}
        assert all(abs(mine.get(i, 0.0) - v) < 1e-5 for i, v in want.items())


def test_passages_by_the_mass_of_their_names(spark):
    names = {"p1": "ab", "p2": "bc", "p3": "c", "p4": "d", "p5": ""}
    lexical = {1: {"p1": 3.0, "p5": 2.0, "p4": 1.0}, 2: {"p3": 1.0}}
    pairs = [("a", "b"), ("b", "c"), ("a", "c")]
    members = spark.createDataFrame([(d, n) for d, x in names.items() for n in x], "doc string, id string")
    scored = spark.createDataFrame([(q, d, s) for q, x in lexical.items() for d, s in x.items()], "qid int, id string, score double")
    got = {}
    for r in graph.passage_fusion(members, spark.createDataFrame(pairs, "a string, b string"), 5, scored, seeds=2).orderBy("rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    for q, x in lexical.items():
        first = sorted(x, key=lambda d: (-x[d], d))
        seeds = {n for d in first[:2] for n in names[d]}
        weights = {n: max(np.log(6 / (sum(n in y for y in names.values()) + 0.5)), 1e-6) for n in seeds}
        mass = exact_pagerank([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], weights)
        own = {d: sum(mass.get(n, 0) for n in y) for d, y in names.items()}
        second = sorted((d for d in own if own[d] > 0), key=lambda d: (-own[d], d))
        want = {d: sum(1 / (60 + r.index(d) + 1) for r in (first, second) if d in r) for d in {*first, *second}}
        want = sorted(want.items(), key=lambda w: (-round(w[1], 9), w[0]))
        assert [d for d, _ in got[q]] == [d for d, _ in want] and all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got[q], want, strict=True))


def test_registered_pagerank_is_converged(spark, sf):
    from lorespark.plans.graph_queries import Q, _ppr

    edges, restart = (x.collect() for x in _ppr(spark, sf))
    want = exact_pagerank([(r.a, r.b, r.w) for r in edges], {r.id: r.weight for r in restart})
    got = {r.id: r.score for r in Q["ppr_converged"](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-5
    short = {r.id: r.score for r in Q["ppr_rounds"](spark, sf).collect()}
    topics = [sum(v for i, v in x.items() if i.startswith("t:")) for x in (short, got, want)]
    print("mass of topics after 4 rounds, converged, exact", topics)
    assert abs(topics[1] - topics[2]) < 1e-5 < abs(topics[0] - topics[2])


def test_kendall_and_bootstrap(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randrange(1000), rng.random()) for g in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, a int, b double")
    for r in evals.kendall_tau(df, "g", "a", "b", "i").collect():
        mine = sorted((a, i, b) for g, i, a, b in rows if g == r.g)
        good = sum((x[2] < y[2]) - (x[2] > y[2]) for x, y in combinations(mine, 2))
        assert abs(r.tau - good / r.pairs) < 1e-6
    boot = evals.bootstrap(df, "g", "b", 500).collect()
    assert all(r.low < r["mean"] < r.high and r.n == 40 for r in boot)
    assert list(evals.splitmix64(0, 2)) == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    low, high = evals.bootstrap_interval(np.arange(30.0), 200)
    assert low < 14.5 < high
    assert evals.decision(5, 10, 0.9, 0.5) == "underpowered" and evals.decision(50, 10, 0.6, 0.5) == "pass"
    assert evals.paired_mde(0.4, 0.5, 100) == 0.12


def test_payload_schema():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 3}}, "additionalProperties": False}
    assert violations({"a": 2}, schema) == []
    assert len(violations({"a": 9, "b": 1}, schema)) == 2 and violations([], schema) and violations({"a": True}, schema)
    for bad in ({"pattern": "(a+)+"}, {"$ref": "#/x"}, []):
        with pytest.raises(ValueError):
            check_schema(bad)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_exact_arm(spark, scale):
    """The arm that Engine.search uses finds at least 0.9 of the true ten, however many rows there are."""
    rows = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    got = {}
    for r in vector.nearest(rows, rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), 10).collect():
        got.setdefault(r.qid, set()).add(r.id)
    m = {r.id: np.array(r.v) for r in rows.collect()}
    for q, found in got.items():
        d = {i: round(float(np.linalg.norm(x - m[q])), 9) for i, x in m.items()}
        assert len(found & set(sorted(d, key=lambda i: (d[i], i))[:10])) >= 9
