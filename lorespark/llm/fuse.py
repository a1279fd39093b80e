"""One ranking from several scores on different scales."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.topn import top_n_per_group
from lorespark.operators.skew import BROADCAST_BYTES, HOT_ROWS, heavy_groups, joined, lower_medians, positions, split_heavy
from lorespark.runtime import written

#: Makes the median absolute deviation of a normal sample equal its standard deviation.
MAD_TO_SD = 1.4826
#: The same for the mean absolute deviation, which stands in where the former is zero.
MEAN_AD_TO_SD = 1.2533
#: Where a missing score is put, in robust standard deviations, unless the group has a lower one.
MISSING_Z = -3.0
#: The values above a group's FAR-th highest are its outliers; the NEAR-th highest of them is squashed to 0.95, the FAR-th to 0.5.
NEAR, FAR = 3, 20
#: ln(0.95 / 0.05).
STEEP = 2.9444389791664403


@dataclass
class Fused:
    """One ranking per group, with what the place test needs: whether an item is within NEAR and FAR in every score."""

    marked: DataFrame
    names: list[str]

    def table(self) -> DataFrame:
        return self.marked.drop("within_near", "within_far")


def _scale(mad: Column, mean_ad: Column) -> Column:
    return F.when(mad > 0, mad * MAD_TO_SD).when(mean_ad > 0, mean_ad * MEAN_AD_TO_SD)


def _log_logistic(z: Column) -> Column:
    """ln(1 / (1 + exp(-z))) without overflow, strictly increasing far beyond where the logistic itself is 1."""
    return -(F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0)))


def _ranked(rows: DataFrame, weights: list[float]) -> DataFrame:
    """rows with each score's statistics (m a e l n f of s), plus log, plain and the place flags.

    m: median, a: MAD, e: mean absolute deviation, l: lowest, n: NEAR-th highest, f: FAR-th highest (NULL if there are fewer).
    Each step is a projection of its own, so that no expression is worked out more than once.
    """
    all_k = range(len(weights))
    rows = rows.withColumns({f"sd{k}": _scale(F.col(f"a{k}"), F.col(f"e{k}")) for k in all_k})
    rows = rows.withColumns({f"z{x}{k}": F.expr(f"CASE WHEN sd{k} IS NULL THEN 0D ELSE ({x}{k} - m{k}) / sd{k} END") for k in all_k for x in "slnf"})
    rows = rows.withColumns(
        {f"z{k}": F.expr(f"CASE WHEN s{k} IS NOT NULL THEN zs{k} ELSE least({MISSING_Z}D, coalesce(zl{k}, {MISSING_Z}D)) END") for k in all_k}
        # With fewer than FAR values from the median up, or from the NEAR-th highest, if that is lower.
        | {f"edge{k}": F.expr(f"coalesce(zf{k}, least(0D, coalesce(zn{k}, zl{k}, 0D)))") for k in all_k}
    )
    rows = rows.withColumns(
        {f"top{k}": F.expr(f"greatest(coalesce(zn{k}, edge{k}), edge{k})") for k in all_k}
        | {f"out{k}": F.expr(f"s{k} IS NOT NULL AND z{k} >= edge{k}") for k in all_k}
    )
    # How far an outlier reaches beyond the FAR-th value: 1 at the NEAR-th, and growing by logarithm from there.
    rows = rows.withColumns({f"y{k}": F.expr(f"CASE WHEN top{k} > edge{k} THEN (z{k} - edge{k}) / (top{k} - edge{k}) ELSE 1 + z{k} - edge{k} END") for k in all_k})
    rows = rows.withColumns({f"p{k}": F.expr(f"CASE WHEN NOT out{k} THEN z{k} - edge{k} WHEN y{k} > 1 THEN 1 + ln(y{k}) ELSE y{k} END") for k in all_k})
    squashed = {
        f"log{k}": F.when(F.col(f"out{k}"), _log_logistic(STEEP * F.col(f"p{k}"))).otherwise(
            _log_logistic(F.col(f"z{k}")) - _log_logistic(F.col(f"edge{k}")) - F.ln(F.lit(2.0))
        )
        for k in all_k
    }
    total = float(sum(weights))
    near, far = (" AND ".join(f"coalesce(s{k} >= coalesce({x}{k}, l{k}), false)" for k in all_k) for x in "nf")
    return rows.withColumns(squashed).withColumns(
        {
            "log": F.round(sum((F.col(f"log{k}") * w for k, w in enumerate(weights)), F.lit(0.0)) / total, 12),
            "plain": F.round(sum((F.col(f"p{k}") * w for k, w in enumerate(weights)), F.lit(0.0)) / total, 9),
            "within_near": F.expr(near),
            "within_far": F.expr(far),
        }
    )


def _statistics(best: DataFrame, scores: list[str]) -> DataFrame:
    """One row of statistics per group, of groups that fit in a task: everything from one sorted list a score."""
    lists = best.groupBy("g").agg(*(F.sort_array(F.collect_list(s)).alias(f"v{k}") for k, s in enumerate(scores)))
    first = lists.select(
        "g",
        *(f"v{k}" for k in range(len(scores))),
        *(F.get(f"v{k}", F.expr(f"(size(v{k}) + 1) div 2 - 1").cast("int")).alias(f"m{k}") for k in range(len(scores))),
    )
    second = first.select(
        "*",
        *(F.sort_array(F.expr(f"transform(v{k}, x -> abs(x - m{k}))")).alias(f"d{k}") for k in range(len(scores))),
    )
    columns = [F.col("g")]
    for k in range(len(scores)):
        v, d = F.col(f"v{k}"), F.col(f"d{k}")
        columns += [
            F.col(f"m{k}"),
            F.get(d, F.expr(f"(size(v{k}) + 1) div 2 - 1").cast("int")).alias(f"a{k}"),
            F.when(F.size(v) > 0, F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias(f"e{k}"),
            F.get(v, F.lit(0)).alias(f"l{k}"),
            F.when(F.size(v) >= NEAR, F.get(v, F.size(v) - NEAR)).alias(f"n{k}"),
            F.when(F.size(v) >= FAR, F.get(v, F.size(v) - FAR)).alias(f"f{k}"),
        ]
    return second.select(*columns)


def _hot_statistics(items: DataFrame, scores: list[str], limit: int) -> DataFrame:
    """The same for hot groups: medians by selection, the highest values by top_n_per_group; written, a row a group."""
    range_k = range(len(scores))
    centre = lower_medians(items, "g", scores).withColumnsRenamed({s: f"m{k}" for k, s in enumerate(scores)})
    lowest = items.groupBy("g").agg(*(F.min(s).alias(f"l{k}") for k, s in enumerate(scores)))
    for k, s in enumerate(scores):
        top = top_n_per_group(items, "g", "i", s, FAR, broadcast_bytes=limit)
        ends = [F.min(F.when(F.col("rank") == r, F.col(s))).alias(f"{n}{k}") for n, r in (("n", NEAR), ("f", FAR))]
        lowest = lowest.join(top.groupBy("g").agg(*ends), "g", "left")
    first = written(centre.join(lowest, "g"), "fuse-centres")
    spread = {f"d{k}": F.abs(F.col(s) - F.col(f"m{k}")) for k, s in enumerate(scores)}
    centred = joined(items, first.select("g", *(f"m{k}" for k in range_k)), ["g"], limit=limit).withColumns(spread)
    mads = lower_medians(centred, "g", list(spread)).withColumnsRenamed({d: f"a{k}" for k, d in enumerate(spread)})
    means = centred.groupBy("g").agg(*(F.avg(d).alias(f"e{k}") for k, d in enumerate(spread)))
    return written(first.join(mads, "g").join(means, "g"), "fuse-spreads")


def fuse_scores(
    df: DataFrame, group: str, item: str, scores: dict[str, float], hot_rows: int = HOT_ROWS, broadcast_bytes: int = BROADCAST_BYTES
) -> Fused:
    """Rank each group's items by a weighted geometric mean of its scores, made comparable.

    ``scores`` maps score columns to weights. An item has its highest value of each score; NULL and
    NaN are no values. A value becomes z = (value - median) / (1.4826 * MAD) of its score in its group
    (the mean absolute deviation replaces a MAD of zero; a constant score gives 0), a logistic curve
    squashes z into (0, 1), and the weighted geometric mean of the squashed values orders the group.

    One logistic for all would let the score with the longer tail decide among the best, for the same rank
    may be 2 deviations out in one score and 50,000 in another. So the outliers, the values from the
    FAR-th highest of a group up (from the median, if there are fewer), have a logistic of their own spread: 0.5 at
    the FAR-th, 0.95 at the NEAR-th highest, with distances beyond that compressed by logarithm. Below it is the
    logistic of z, scaled to meet 0.5. It follows, with equal weights, that an item within the NEAR
    highest of every score precedes all items that are not within the FAR highest of every score:
    0.95 * 0.95 > 1 * 0.5. The fused value never falls when a score rises.

    A missing value stands low: at z = -3, or with the group's lowest. Medians are exact; of an even number
    of values they are the lower. Logarithms of fused values are compared to 12 decimals, so that the order of
    summing does not matter; ties go to the higher mean of the compressed distances, then to the smaller item. Rows
    without group or item are left out; an empty table gives no rows; other columns of df are ignored.

    ``table()``: group, item, the scores, fused (the geometric mean), position (1 is best). Light groups take one
    shuffle, one sorted list per score and one window. Groups of ``hot_rows`` rows and more are aggregated under
    their full key, their medians selected within a sketch's bracket, their highest values found by salted
    lists, and their positions by a range sort.
    """
    names, weights = list(scores), list(scores.values())
    rows = df.select(
        F.col(group).alias("g"),
        F.col(item).alias("i"),
        *(F.nanvl(F.col(c).cast("double") + F.lit(0.0), F.lit(None).cast("double")).alias(f"s{k}") for k, c in enumerate(names)),
    ).where("g IS NOT NULL AND i IS NOT NULL")
    keep = [f"s{k}" for k in range(len(names))]
    best = [F.max(s).alias(s) for s in keep]
    light, hot = split_heavy(rows, "g", heavy_groups(rows, "g", hot_rows), broadcast_bytes)
    order = [F.col("log").desc(), F.col("plain").desc(), F.col("i")]
    shown = ["g", "i", *keep, "log", "within_near", "within_far"]

    light = light.repartition("g").groupBy("g", "i").agg(*best)
    ranked = _ranked(light.join(_statistics(light, keep).hint("merge"), "g"), weights)  # both sides lie by g: no shuffle
    place = F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint")
    ranked = ranked.withColumn("position", place).select(*shown, "position")
    if hot is not None:
        items = written(hot.groupBy("g", "i").agg(*best), "fuse-hot")
        heavy = _ranked(joined(items, _hot_statistics(items, keep, broadcast_bytes), ["g"], limit=broadcast_bytes), weights)
        ranked = ranked.unionByName(positions(heavy.select(*shown, "plain"), "g", order, "position").select(*shown, "position"))
    return Fused(
        ranked.select(
            F.col("g").alias(group),
            F.col("i").alias(item),
            *(F.col(s).alias(c) for s, c in zip(keep, names)),
            F.exp("log").alias("fused"),
            "position",
            "within_near",
            "within_far",
        ),
        names,
    )


def leaders_by_place(fused: Fused, group: str, item: str, least_items: int = 30) -> DataFrame:
    """(group, item): the first item of each ranking that is at place NEAR or better in every score, where no other item
    of the group is at place FAR or better in every score and the group has ``least_items`` items.

    A place is 1 plus the number of items with a strictly higher value; a missing value has none. Only position 1
    is looked at: an item that passes the test is there (see fuse_scores). One row per group is shuffled.
    """
    first = F.col("position") == 1
    return (
        fused.marked.groupBy(group)
        .agg(
            F.max(F.when(first, F.col(item))).alias(item),
            F.coalesce(F.bool_or(first & F.col("within_near")), F.lit(False)).alias("__leads"),
            F.count_if(F.col("within_far")).alias("__rivals"),
            F.count(F.lit(1)).alias("__items"),
        )
        .where(F.col("__leads") & (F.col("__rivals") == 1) & (F.col("__items") >= least_items))
        .select(group, item)
    )
