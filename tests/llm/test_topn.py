import random

from lorespark.llm.topn import top_n_per_group

SCHEMA = "q string, d bigint, s double"


def brute(rows, n, wanted=None):
    best = {}
    for q, d, s in rows:
        if q is None or d is None or s is None or s != s or (wanted is not None and q not in wanted):
            continue
        best.setdefault(q, {})
        best[q][d] = max(s, best[q].get(d, s))
    out = []
    for q, items in best.items():
        for r, (d, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out.append((q, d, s, r))
    return sorted(out)


def sample(n=4000):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"q{rng.randrange(60)}", rng.randrange(900), rng.choice([0.0, 0.5, rng.random()])) for _ in range(n)]
    rows += [("q1", 3, None), ("q1", 4, float("nan")), (None, 5, 0.9), ("q2", None, 0.9), ("only_null", 1, None)]
    return rows + rows[:200]


def test_light_and_hot_paths_agree_with_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = brute(rows, 10)
    for hot_rows, salt in ((10**9, 10), (500, 100), (1, 50)):
        got = sorted(map(tuple, top_n_per_group(df, "q", "d", "s", 10, hot_rows=hot_rows, salt_rows=salt).collect()))
        assert got == want


def test_wanted_groups_and_clashing_columns(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", g string, i int, r int")
    wanted = spark.createDataFrame([("hot", 1), ("hot", 2), ("q7", 3), (None, 4)], "q string, salt int")
    for hot_rows in (10**9, 500):
        got = sorted(map(tuple, top_n_per_group(df, "q", "d", "s", 5, groups=wanted, hot_rows=hot_rows).collect()))
        assert got == brute(rows, 5, {"hot", "q7"})


def test_more_heavy_groups_than_a_list_would_hold(spark):
    """1,300 groups of two items each are heavy at this threshold; none is left to the ordinary windows, whichever join is used."""
    rows = [(f"g{k}", d, (k * 7 + d * 3) % 11 / 11) for k in range(1_300) for d in (1, 2)] + [("alone", 1, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(f"g{k}",) for k in range(0, 1_300, 2)] + [("alone",)], "q string")
    for limit in (8 << 20, 0):
        got = sorted(map(tuple, top_n_per_group(df, "q", "d", "s", 1, hot_rows=2, salt_rows=1, broadcast_bytes=limit).collect()))
        assert got == brute(rows, 1)
        got = sorted(map(tuple, top_n_per_group(df, "q", "d", "s", 1, groups=wanted, hot_rows=2, salt_rows=1, broadcast_bytes=limit).collect()))
        assert got == brute(rows, 1, {f"g{k}" for k in range(0, 1_300, 2)} | {"alone"})


def test_all_tied_hot_group(spark):
    rows = [("a", d, 1.0) for d in range(3000)] * 2 + [("b", 1, -0.0), ("b", 0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, top_n_per_group(df, "q", "d", "s", 3, hot_rows=100, salt_rows=64).collect()))
    assert got == [("a", 0, 1.0, 1), ("a", 1, 1.0, 2), ("a", 2, 1.0, 3), ("b", 0, 0.0, 1), ("b", 1, 0.0, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(df, "q", "d", "s").collect() == []
    assert top_n_per_group(df, "q", "d", "s", groups=df).collect() == []
