"""The N best items of every group, however large the groups are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators.skew import BROADCAST_BYTES, HOT_ROWS, Heavy, heavy_groups, split_heavy
from lorespark.runtime import written


def top_n_per_group(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int = 10,
    groups: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salt_rows: int = 20_000,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(group, item, score, rank): the n items with the highest score of each group, ranks from 1.

    An item's score is its highest in the group; ties go to the smaller item. NULL and NaN are no
    scores, and rows without a score, group or item are left out; 0.0 and -0.0 are equal. Repeated
    rows count once. A group with fewer than n items gives them all; an empty table gives no rows.
    ``groups``, if given, is a table whose column of the group's name says which groups are wanted.
    Other columns of df are ignored, whatever their names.

    Exact row counts split the groups; any number of them may be heavy. The rows of those of ``hot_rows``
    rows and more are first reduced to one per item where they are read, then salted by item,
    range-sorted by (group, salt), cut to n within each salt and merged: no task sees more than about
    ``salt_rows`` items of a group before the merge, and of each earlier task at most n in it. The
    others take one shuffle and an ordinary window.
    """
    rows = df.select(
        F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s")
    ).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    wanted = None if groups is None else groups.select(F.col(group).alias("g")).where("g IS NOT NULL").distinct()
    heavy = heavy_groups(rows, "g", hot_rows)
    light, hot = split_heavy(rows, "g", heavy, broadcast_bytes)
    if wanted is not None and heavy.keys:  # the heavy groups are asked for by their table, not row by row
        table = written(heavy.table.join(wanted.withColumnRenamed("g", "k"), "k", "left_semi"), "heavy-wanted")
        hot = split_heavy(rows, "g", Heavy(table, table.count()), broadcast_bytes)[1]

    light = light.repartition("g") if wanted is None else light.join(wanted, "g", "left_semi")
    best = F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), "i"))
    found = light.groupBy("g", "i").agg(F.max("s").alias("s")).withColumn("r", best).where(F.col("r") <= n)
    if hot is not None:
        in_salt = F.row_number().over(Window.partitionBy("g", "salt").orderBy(F.col("s").desc(), "i"))
        once = hot.groupBy("g", "i").agg(F.max("s").alias("s"), F.max("__rows").alias("m"))
        cut = (
            once.withColumn("salt", F.expr(f"pmod(xxhash64(i), ceil(m / {salt_rows}))"))
            .repartitionByRange("g", "salt")
            .withColumn("r", in_salt)
            .where(F.col("r") <= n)
        )
        merged = cut.select("g", "i", "s").withColumn("r", best).where(F.col("r") <= n)
        found = found.unionByName(merged)
    return found.select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").cast("int").alias("rank")
    )
