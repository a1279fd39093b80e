import random
import time

import pytest

from lorespark.llm.mix import Target, mix_sources, route
from lorespark.llm.tokens import encode_corpus

SCHEMA = "doc_id bigint, text string, sources array<string>"


def test_flow_fills_overlapping_quotas_evenly():
    targets = [Target("a", 0.5, 2), Target("b", 0.5, 1)]
    # Sending what only a can use to a leaves the shared documents for b.
    got = route({("a",): 60, ("a", "b"): 50, ("b",): 10}, targets, 120)
    assert got[("a",), "a"] + got[("a", "b"), "a"] == 60
    assert got[("b",), "b"] + got[("a", "b"), "b"] == 60
    assert got[("a",), "a"] == 60 and got[("a", "b"), "a"] == 0  # nothing is repeated


def test_short_source_gets_all_it_may():
    got = route({("a",): 10, ("b",): 100}, [Target("a", 0.5, 3), Target("b", 0.5, 1), ], 200)
    assert got == {(("a",), "a"): 30, (("b",), "b"): 100}


def test_many_overlapping_sources_are_quick_and_optimal():
    """Every pattern of 11 sources occurs; quotas are filled and nothing is repeated while something is unused."""
    names = [f"s{k:02}" for k in range(11)]
    rng = random.Random(1)
    patterns = {tuple(n for k, n in enumerate(names) if m >> k & 1): rng.randrange(1, 1_000) for m in range(1, 1 << 11)}
    targets = [Target(n, 1 / 11, 3) for n in names]
    total = sum(patterns.values())
    start = time.perf_counter()
    got = route(patterns, targets, total)
    assert time.perf_counter() - start < 30
    for n in names:
        assert sum(v for (_, s), v in got.items() if s == n) == round(total / 11)
    used = {}
    for (p, _), v in got.items():
        used[p] = used.get(p, 0) + v
    assert all(used[p] <= patterns[p] + 11 for p in patterns)


def brute_cost(patterns, targets, total):
    """(flow, cost) by enlarging the best flow one token at a time over all ways, by Bellman-Ford."""
    by = {t.source: t for t in targets}
    arcs = []
    for p, size in patterns.items():
        for copy in range(max(by[s].max_repeats for s in p)):
            arcs.append(["S", p, size, copy])
        for s in p:
            arcs.append([p, s, size * by[s].max_repeats, 0])
    for t in targets:
        arcs.append([t.source, "T", round(t.share * total), 0])
    arcs = [a for x, y, c, w in arcs for a in ([x, y, c, w], [y, x, 0, -w])]
    flow = cost = 0
    while True:
        far, came = {"S": 0}, {}
        for _ in range(len(arcs)):
            moved = False
            for k, (x, y, c, w) in enumerate(arcs):
                if c and x in far and far[x] + w < far.get(y, 10**9):
                    far[y], came[y], moved = far[x] + w, k, True
            if not moved:
                break
        if "T" not in far:
            return flow, cost
        y = "T"
        while y != "S":
            k = came[y]
            arcs[k][2] -= 1
            arcs[k ^ 1][2] += 1
            y = arcs[k][0]
        flow, cost = flow + 1, cost + far["T"]


def test_flow_is_of_least_cost():
    rng = random.Random(7)
    for _ in range(12):
        targets = [Target(n, rng.choice([0.2, 0.4, 0.7]), rng.randrange(1, 4)) for n in "abc"]
        patterns = {p: rng.randrange(1, 7) for p in [("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")] if rng.random() < 0.8}
        if not patterns:
            continue
        got = route(patterns, targets, 15)
        cost = 0
        for p, size in patterns.items():
            left, copy = sum(v for (q, _), v in got.items() if q == p), 0
            while left > 0:
                cost, left, copy = cost + min(left, size) * copy, left - size, copy + 1
        assert (sum(got.values()), cost) == brute_cost(patterns, targets, 15)


def documents(n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        src = rng.choice([["big"], ["big"], ["big"], ["mid"], ["small"], ["big", "mid"], ["other"], None, [None], []])
        rows.append((i, rng.choice([None, "", "word " * rng.randrange(1, 60)]) if i % 9 == 0 else "word " * rng.randrange(1, 60), src))
    return rows


def test_shares_repeats_and_report(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    targets = [Target("big", 0.5, 1), Target("mid", 0.25, 3), Target("small", 0.2, 2), Target("absent", 0.05, 9)]
    mix = mix_sources(df, targets)
    size = {r.doc_id: r.tokens for r in encode_corpus(df, count_only=True).collect()}
    of = {r[0]: r[2] or [] for r in rows}
    got = mix.documents.collect()
    assert all(r.source in of[r.doc_id] and r.tokens == size[r.doc_id] > 0 for r in got)
    limit = {t.source: t.max_repeats for t in targets}
    assert all(1 <= r.uses <= limit[r.source] for r in got)
    assert len({(r.doc_id, r.source) for r in got}) == len(got)
    together = {}
    for r in got:
        together[r.doc_id] = together.get(r.doc_id, 0) + r.uses
    assert all(n <= max(limit[s] for s in of[d] if s in limit) + 1 for d, n in together.items())
    report = {r.source: r for r in mix.report.collect()}
    for t in targets:
        mine = sum(r.tokens * r.uses for r in got if r.source == t.source)
        assert report[t.source].actual_tokens == mine
        if report[t.source].status == "reached":
            assert abs(mine - report[t.source].target_tokens) <= 2 * max(size.values())
        else:
            assert mine < report[t.source].target_tokens + 2 * max(size.values())
    assert report["absent"].status == "short" and report["absent"].actual_share == 0.0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4


def test_seed_fixes_the_choice(spark):
    df = spark.createDataFrame(documents(200), SCHEMA)
    targets = [Target("big", 0.2, 1), Target("mid", 0.8, 2)]
    a, b, c = (sorted(map(tuple, mix_sources(df.repartition(p), targets, seed=s).documents.collect())) for p, s in ((2, 1), (5, 1), (3, 2)))
    assert a == b != c


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    mix = mix_sources(df, [Target("a", 1.0, 1)])
    assert mix.documents.collect() == []
    assert [(r.source, r.status, r.actual_tokens) for r in mix.report.collect()] == [("a", "short", 0)]
    with pytest.raises(ValueError):
        mix_sources(df, [Target("a", 0.5, 1), Target("a", 0.5, 1)])


def test_clashing_columns_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c", ["s"]), (1, "d e f", ["s", "s"]), (1, "d e f", ["s"]), (2, None, ["s"]), (3, "x", ["t"])]
    df = spark.createDataFrame([(*r, 1, "z", 2, 3) for r in rows], SCHEMA + ", k int, p string, n int, source int")
    mix = mix_sources(df, [Target("s", 0.5, 2), Target("t", 0.5, 1)])
    got = [(r.doc_id, r.source, r.uses) for r in mix.documents.collect()]
    assert {d for d, *_ in got} <= {None, 1, 3} and all(u <= 2 for *_, u in got)
    assert {r.source: r.status for r in mix.report.collect()}["t"] == "short"


def test_hot_source_keeps_its_share(spark):
    rows = [(i, "word " * (1 + i % 7), ["hot"] if i % 3 else [f"s{i % 5}"]) for i in range(3000)]
    targets = [Target("hot", 0.2, 1)] + [Target(f"s{k}", 0.16, 9) for k in range(5)]
    report = {r.source: r for r in mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(8), targets).report.collect()}
    assert abs(report["hot"].actual_share - 0.2) < 0.005 and report["hot"].most_uses == 1
    assert all(abs(report[f"s{k}"].actual_share - 0.16) < 0.005 for k in range(5))
