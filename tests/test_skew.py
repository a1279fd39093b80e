import random

from pyspark.sql import functions as F

from lorespark.operators.skew import heavy_groups, joined, lower_medians, positions, split_heavy
from lorespark.runtime import written


def test_more_heavy_groups_than_any_list_would_hold(spark):
    """1,200 groups are heavy: all of them are split off, with either kind of join, and no row is lost."""
    df = spark.range(1_200 * 20 + 500).select((F.col("id") % 1_200).alias("g"), "id").unionAll(spark.range(3).select(F.lit(None).cast("bigint"), "id"))
    df = df.unionAll(spark.range(7).select(F.lit(5_000).cast("bigint"), "id"))
    heavy = heavy_groups(df, "g", 20)
    assert heavy.keys == 1_200 == heavy.table.count()
    for limit in (8 << 20, 0):
        light, hot = split_heavy(df, "g", heavy, limit)
        assert sorted(r.id for r in light.collect()) == sorted([*range(3), *range(7)])
        counts = {r.g: (r.n, r.m) for r in hot.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("__rows").alias("m")).collect()}
        assert set(counts) == set(range(1_200)) and all(n == m >= 20 for n, m in counts.values())


def test_no_heavy_groups(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("g"))
    light, hot = split_heavy(df, "g", heavy_groups(df, "g", 20))
    assert hot is None and light.count() == 10
    assert heavy_groups(df.where("false"), "g").keys == 0


def test_a_spread_key_is_not_in_one_task(spark):
    """Where the other side is too large to broadcast, a key with all rows meets it in many tasks."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), "id")
    table = written(spark.createDataFrame([(1, "x"), (2, "y")], "g int, v string"), "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in joined(df, table, ["g"], "inner", 0).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000


def test_exact_medians_and_positions(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, rng.gauss(0, 1), 1.5]), rng.lognormvariate(0, 3)) for g in (1, 2, 3) for _ in range([2_001, 500, 1][g - 1])]
    rows += [(4, None, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r.g: (r.a, r.b) for r in lower_medians(df, "g", ["a", "b"]).collect()}

    def median(g, k):
        have = sorted(r[k] for r in rows if r[0] == g and r[k] is not None)
        return have[(len(have) - 1) // 2] if have else None

    assert got == {g: (median(g, 1), median(g, 2)) for g in (1, 2, 3, 4)}
    placed = positions(df.where("b IS NOT NULL"), "g", [F.col("b")], "p").collect()
    for g in (1, 2, 3):
        mine = sorted((r.b, r.p) for r in placed if r.g == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
