"""Splitting off hot groups, joins that no hot key gathers, and exact row positions in groups of any size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.runtime import written

#: A group of so many rows and more is not left to one task.
HOT_ROWS = 50_000
#: A written table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Over how many tasks the rows of one key are spread where the other side is too large to broadcast.
SPREAD = 256


@dataclass(frozen=True)
class Heavy:
    """The groups too large for one task, as a written table (k, n) with their exact row counts, and how many they are."""

    table: DataFrame
    keys: int


def heavy_groups(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> Heavy:
    """All groups of ``min_rows`` rows and more, however many. NULL keys are no group.

    Only the key is read, counts are added up before the shuffle, and the table is written: nothing is
    collected. It has at most one row for every min_rows rows of df.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    table = written(counts.where(F.col("n") >= min_rows).observe(seen, F.count(F.lit(1)).alias("keys")), "heavy")
    return Heavy(table, seen.get["keys"])


def bytes_of(df: DataFrame) -> int:
    """The size the planner knows df by; of a table just written that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def joined(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """df joined with a written table that has one row per key, without one task meeting all rows of a hot key.

    The table is broadcast if its files are no larger than ``limit``. Otherwise each of its rows is repeated SPREAD
    times, and the rows of df meet one of the copies each, by a hash of the whole row. ``how``: inner, left, left_semi, left_anti.
    """
    if bytes_of(table) <= limit:
        return df.join(F.broadcast(table), keys, how)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)).cast("int")
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return df.withColumn("__salt", salt).join(copies, [*keys, "__salt"], how).drop("__salt")


def split_heavy(df: DataFrame, key: str, heavy: Heavy, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(the other rows, the rows of heavy groups with their group's count as __rows, or None if there are none)."""
    if heavy.keys == 0:
        return df, None
    table = heavy.table.select(F.col("k").alias(key), F.col("n").alias("__rows"))
    return joined(df, table.select(key), [key], "left_anti", limit), joined(df, table, [key], "inner", limit)


def positions(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Rows of df with their 1-based position in their group, for groups larger than a task.

    Rows are range-partitioned over (group, order), so one group spreads over many tasks, sorted
    there and written once; a position is the row's place in its partition plus the rows of its
    group in earlier partitions. That table of offsets has one row per group and partition it lies in.
    """
    ordered = (
        df.repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33).cast("int"))
    )
    table = written(ordered, "positions")
    starts = table.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        group, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    return (
        table.join(starts, [group, "__part"])
        .withColumn(out, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("bigint"))
        .drop("__at", "__part", "__first", "__before")
    )


def lower_medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, columns...): the exact lower median of each column's values that are not NULL, per group.

    For groups of any size (the hot ones). A mergeable sketch brackets each median between two values
    whose ranks it knows to one in 10,000; what lies below the bracket is counted with partial sums,
    and only what is inside, some two in a thousand, is range-sorted over all tasks.
    """
    keys = df.select(group).distinct()
    if not columns:
        return keys
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).alias("x")) for k, c in enumerate(columns))))
    rows = df.select(F.col(group).alias("__g"), cells.alias("v")).select(F.struct("__g", "v.c").alias("__k"), F.col("v.x").alias("__x")).where("__x IS NOT NULL")
    ends = rows.groupBy("__k").agg(
        F.percentile_approx("__x", [0.499, 0.501], 10_000).alias("__e"), F.expr("(count(1) + 1) div 2").alias("__want")
    )
    ends = written(ends, "medians-ends")
    near = joined(rows, ends, ["__k"]).where("__x <= __e[1]")
    below = near.groupBy("__k").agg(F.count_if(F.expr("__x < __e[0]")).alias("__below"))
    placed = positions(near.where("__x >= __e[0]").select("__k", "__x"), "__k", [F.col("__x")], "__p")
    wanted = written(ends.join(below, "__k").select("__k", (F.col("__want") - F.col("__below")).alias("__p")), "medians-wanted")
    found = joined(placed, wanted, ["__k", "__p"]).select(F.col("__k.__g").alias(group), F.col("__k.c").alias("c"), "__x")
    wide = found.groupBy(group).agg(*(F.min(F.when(F.col("c") == k, F.col("__x"))).alias(c) for k, c in enumerate(columns)))
    return keys.join(wide, group, "left")
