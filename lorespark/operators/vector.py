"""Vector retrieval: exact and sign-bit nearest neighbours, means, clustering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidates that the sign-bit phase hands to the exact phase.
CANDIDATES = 192
#: Queries are sent to the executors in blocks of so many.
BLOCK = 4_096


def _signs(matrix: np.ndarray, mean: np.ndarray | None) -> np.ndarray:
    return np.packbits((matrix - mean if mean is not None else matrix) > 0, axis=1)


def _distances(metric: str, q: np.ndarray, m: np.ndarray, mean) -> np.ndarray:
    if metric == "hamming":
        a, b = _signs(q, mean), _signs(m, mean)
        out = np.zeros((len(q), len(m)), dtype=np.float64)
        for byte in range(a.shape[1]):
            out += np.bitwise_count(a[:, byte, None] ^ b[None, :, byte])
        return out
    dot = q @ m.T
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
        return 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)
    square = (q * q).sum(axis=1)[:, None] + (m * m).sum(axis=1)[None, :] - 2 * dot
    return np.sqrt(np.maximum(square, 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", mean: list[float] | None = None, block: int = BLOCK
) -> DataFrame:
    """(qid, id, distance, rank): the k nearest rows of each query, ties to the smaller id.

    vectors: id, v. queries: qid, v. metric: l2, cosine or hamming (of sign bits, after subtracting
    ``mean``). Queries go out in blocks of fixed size against all rows; each task keeps its k best
    of a query, so what is shuffled is k rows per query and task. Filters belong before this call.
    """
    vectors = vectors.select("id", "v").where("v IS NOT NULL")
    centre = None if mean is None else np.array(mean)
    rows, found = queries.select("qid", "v").where("v IS NOT NULL").toLocalIterator(), None
    while part := list(islice(rows, block)):
        sent = vectors.sparkSession.sparkContext.broadcast(
            (np.array([r.qid for r in part]), np.array([r.v for r in part], dtype=np.float64))
        )

        def local(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            ids = np.empty((len(q), 0), dtype=np.int64)
            best = np.empty((len(q), 0))
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                d = np.round(_distances(metric, q, m, centre), 9)
                best = np.hstack([best, d])
                ids = np.hstack([ids, np.broadcast_to(batch.column(0).to_numpy(), d.shape)])
                order = np.lexsort((ids, best), axis=1)[:, :k]
                best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
            if best.shape[1]:
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, n)), pa.array(ids.ravel()), pa.array(best.ravel())], names=["qid", "id", "distance"]
                )

        mine = vectors.mapInArrow(local, "qid bigint, id bigint, distance double")
        found = mine if found is None else found.unionAll(mine)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "qid bigint, id bigint, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def two_phase(vectors: DataFrame, queries: DataFrame, k: int, mean: list[float] | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """(qid, id, distance, rank): sign-bit candidates, reranked by exact distance.

    The number of candidates is fixed, so recall falls as the table grows; ``nearest`` misses none.
    """
    near = nearest(vectors, queries, max(candidates, k), "hamming", mean).select("qid", "id")
    pairs = near.join(vectors.select("id", "v"), "id").join(queries.select("qid", F.col("v").alias("q")), "qid")
    square = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return pairs.select("qid", "id", F.round(F.sqrt(square), 9).alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)


def candidates_for(vectors: DataFrame, sample: DataFrame, k: int, share: float = 0.95, mean: list[float] | None = None, margin: float = 1.25) -> int:
    """How many sign-bit candidates two_phase needs on these rows, measured: for the sampled queries (qid, v; at most BLOCK are
    looked at), the mean number of rows that are no further in sign bits than ``share`` of the k true neighbours, times margin.

    One exact search and one counting pass over all rows; only a number per query comes back.
    """
    sample = sample.select("qid", "v").where("v IS NOT NULL").orderBy(F.xxhash64("qid")).limit(BLOCK)
    near = nearest(vectors, sample, k).select("qid", "id").join(vectors.select("id", F.col("v").alias("w")), "id").join(sample, "qid")
    centre = F.array(*(F.lit(float(x)) for x in mean)) if mean is not None else None

    def bits(v: str):
        return F.transform(v, lambda x: x > 0) if centre is None else F.zip_with(v, centre, lambda x, m: x > m)

    apart = F.aggregate(F.zip_with(bits("v"), bits("w"), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    wanted = max(1, int(np.ceil(share * k)))
    reach = near.select("qid", apart.alias("d")).groupBy("qid").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(wanted - 1)).alias("d"))
    rows = sample.join(reach.where("d IS NOT NULL"), "qid").collect()  # at most BLOCK
    if not rows:
        return CANDIDATES
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r.v for r in rows], dtype=np.float64), np.array([r.d for r in rows])))
    off = None if mean is None else np.array(mean)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, limit = sent.value
        total = np.zeros(len(q), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                m = np.array(batch.column(0).to_pylist(), dtype=np.float64)
                total += (_distances("hamming", q, m, off) <= limit[:, None]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([int(total.sum())])], names=["n"])

    inside = vectors.select("v").where("v IS NOT NULL").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0]
    return max(CANDIDATES, int(np.ceil(margin * inside / len(rows))))


def mean_vector(vectors: DataFrame, first: int | None = None) -> DataFrame:
    """(dim, mean) over all rows, or over the ``first`` rows by id."""
    rows = vectors if first is None else vectors.orderBy("id").limit(first)
    return rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def mean_list(vectors: DataFrame, first: int | None = None) -> list[float]:
    return [r["mean"] for r in mean_vector(vectors, first).orderBy("dim").collect()]  # one row per dimension


def lloyd(vectors: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    """(id, cluster) after ``rounds`` of k-means from given centres (cluster, v); an empty cluster keeps its centre.

    Only the centres travel: k rows of fixed width go out, and each task sends back one sum per
    cluster and dimension. Rows of NULL vectors are left out.
    """
    rows = vectors.select("id", "v").where("v IS NOT NULL")
    current = {r.cluster: r.v for r in centres.collect()}

    def sent():
        names = np.array(list(current))
        return vectors.sparkSession.sparkContext.broadcast((names, np.array([current[c] for c in names.tolist()])))

    def nearest_centre(batch, centre):
        m = np.array(batch.column(1).to_pylist(), dtype=np.float64)
        return m, np.round(_distances("l2", m, centre, None), 9).argmin(axis=1)

    for _ in range(rounds):
        asked = sent()

        def sums(batches, asked=asked):
            names, centre = asked.value
            total, count = np.zeros(centre.shape), np.zeros(len(names), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    m, own = nearest_centre(batch, centre)
                    np.add.at(total, own, m)
                    count += np.bincount(own, minlength=len(names))
            dims = centre.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(names, dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(names))),
                    pa.array(total.ravel()), pa.array(np.repeat(count, dims)),
                ],
                names=["cluster", "dim", "s", "n"],
            )

        moved = rows.mapInArrow(sums, "cluster bigint, dim int, s double, n bigint").groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        for r in moved.where("n > 0").groupBy("cluster").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("v")
        ).collect():
            current[r.cluster] = r.v
    asked = sent()

    def assign(batches, asked=asked):
        names, centre = asked.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[nearest_centre(batch, centre)[1]])], names=["id", "cluster"])

    return rows.mapInArrow(assign, "id bigint, cluster bigint")


def default_clusters(n: int) -> int:
    return max(2, min(n, round(n**0.5)))
