import math
import random
import statistics

from lorespark.llm.fuse import fuse_scores, leaders_by_place

SCHEMA = "q string, d bigint, b double, c double"


def sample(seed=3, hot=1500):
    rng = random.Random(seed)
    rows = []
    for q, size in [("hot", hot)] + [(f"q{k}", rng.choice([1, 2, 12, 40, 80])) for k in range(40)]:
        scale = 10 ** rng.uniform(-3, 3)
        for d in range(size):
            b = None if rng.random() < 0.1 else rng.lognormvariate(0, 2) * scale
            c = None if rng.random() < 0.2 else round(rng.random(), 2)
            rows.append((q, d, b, c))
        if size >= 12:
            rows.append((q, 10_000, scale * 1e5, 1.0 + rng.random() / 10))
    rows += [("q0", 1, float("nan"), None), (None, 1, 1.0, 1.0), ("q0", None, 1.0, 1.0), ("gone", 7, None, None)]
    return rows + rows[::9]


def lower_median(values):
    return sorted(values)[(len(values) - 1) // 2]


def log_logistic(z):
    return -math.log1p(math.exp(-abs(z))) - max(-z, 0)


def squash(have):
    """The two values (log, tie) of a score, given all values that are not missing."""
    if not have:
        return lambda x: (log_logistic(-3.0) - log_logistic(0.0) - math.log(2), -3.0)
    med = lower_median(have)
    dev = [abs(x - med) for x in have]
    sd = lower_median(dev) * 1.4826 or statistics.fmean(dev) * 1.2533
    z = (lambda x: (x - med) / sd) if sd else (lambda x: 0.0)
    down = sorted(have, reverse=True)
    near = z(down[2]) if len(down) >= 3 else None
    edge = z(down[19]) if len(down) >= 20 else min(0.0, near if near is not None else z(min(have)))
    top = max(edge, near if near is not None else edge)

    def value(x):
        at = min(-3.0, z(min(have))) if x is None else z(x)
        if x is None or at < edge:
            return log_logistic(at) - log_logistic(edge) - math.log(2), at - edge
        y = (at - edge) / (top - edge) if top > edge else 1 + at - edge
        y = 1 + math.log(y) if y > 1 else y
        return log_logistic(math.log(19) * y), y

    return value


def brute(rows):
    best = {}
    for q, d, *scores in rows:
        if q is None or d is None:
            continue
        item = best.setdefault(q, {}).setdefault(d, [None, None])
        for k, s in enumerate(scores):
            if s is not None and s == s and (item[k] is None or s > item[k]):
                item[k] = s
    out = {}
    for q, items in best.items():
        maps = [squash([v[k] for v in items.values() if v[k] is not None]) for k in (0, 1)]
        logs = {}
        for d, v in items.items():
            pairs = [m(x) for m, x in zip(maps, v)]
            logs[d] = tuple(round(sum(p[k] for p in pairs) / 2, digits) for k, digits in ((0, 12), (1, 9)))
        order = sorted(items, key=lambda d: (-logs[d][0], -logs[d][1], d))
        out[q] = (order, logs, items)
    return out


def places(values, d, k):
    x = values[d][k]
    return None if x is None else 1 + sum(v[k] is not None and v[k] > x for v in values.values())


def test_ranking_matches_brute_force_on_both_paths(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for hot_rows in (10**9, 300):
        got = {}
        for r in fuse_scores(df, "q", "d", {"b": 1.0, "c": 1.0}, hot_rows=hot_rows).table().collect():
            got.setdefault(r.q, {})[r.position] = (r.d, r.fused)
        assert set(got) == set(want)
        for q, (order, logs, _) in want.items():
            assert sorted(got[q]) == list(range(1, len(order) + 1))
            assert [got[q][p][0] for p in sorted(got[q])] == order
            assert all(abs(got[q][p][1] - math.exp(logs[d][0])) < 1e-9 for p, d in enumerate(order, 1))


def test_scale_of_a_score_does_not_matter(spark):
    rows = [(q, d, b, c) for q, d, b, c in sample(hot=60) if q]
    scaled = [(q, d, None if b is None else b * 1024.0, c) for q, d, b, c in rows]
    ranks = [
        sorted((r.q, r.position, r.d) for r in fuse_scores(spark.createDataFrame(x, SCHEMA), "q", "d", {"b": 1.0, "c": 1.0}).table().collect())
        for x in (rows, scaled)
    ]
    assert ranks[0] == ranks[1]


def test_leaders_match_brute_force_on_both_paths(spark):
    rows = sample(8)
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for q, (_, _, items) in brute(rows).items():
        both = {d: [places(items, d, k) for k in (0, 1)] for d in items}
        near = [d for d, p in both.items() if None not in p and max(p) <= 3]
        far = [d for d, p in both.items() if None not in p and max(p) <= 20]
        if len(near) == 1 and far == near and len(items) >= 30:
            want.add((q, near[0]))
    assert want
    for hot_rows, limit in ((10**9, 8 << 20), (300, 8 << 20), (30, 0)):
        fused = fuse_scores(df, "q", "d", {"b": 1.0, "c": 1.0}, hot_rows=hot_rows, broadcast_bytes=limit)
        assert set(map(tuple, leaders_by_place(fused, "q", "d").collect())) == want


def test_who_is_near_the_top_in_both_scores_comes_before_who_is_far_in_one(spark):
    """However unlike the tails: item 0 is third in a score of huge range and third in one whose best are nearly equal."""
    rows = [("q", 0, 1e3, 0.997), ("q", 1, 1e12, 0.98), ("q", 2, 1e9, 0.1), ("q", 3, 5.0, 0.999), ("q", 4, 4.0, 0.998)]
    rows += [("q", 10 + k, 10.0 + k, 0.2 + k / 1000) for k in range(40)] + [("q", 60 + k, 1.0 + k / 100, 0.981 + k / 10000) for k in range(20)]
    rows += [("few", k, float(k) if k < 3 else None, 0.5 + k / 100) for k in range(31)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot_rows in (10**9, 10):
        fused = fuse_scores(df, "q", "d", {"b": 1.0, "c": 1.0}, hot_rows=hot_rows)
        first = {r.q: r.d for r in fused.table().where("position = 1").collect()}
        assert first["q"] == 0
        assert [tuple(r) for r in leaders_by_place(fused, "q", "d").collect()] == [("q", 0)]


def test_empty(spark):
    fused = fuse_scores(spark.createDataFrame([], SCHEMA), "q", "d", {"b": 1.0, "c": 2.0})
    assert fused.table().collect() == []
    assert leaders_by_place(fused, "q", "d").collect() == []
