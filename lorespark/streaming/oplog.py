"""Streams of log records: exactly-once appends, running state, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark.schema import MUTATIONS, struct


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of log records to parquet, each batch in a folder of its own number.

    A batch that is tried again overwrites its own folder, so records are neither lost nor repeated.
    """
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(struct(MUTATIONS)).parquet(f"{path}/batch=*")


def latest_state(stream: DataFrame) -> DataFrame:
    """The last record of each (collection, key) so far; for output modes update and complete."""
    last = F.max_by(F.struct("id", "payload_json"), "id")
    return stream.groupBy("collection_name", "record_key").agg(last.alias("x")).select(
        "collection_name", "record_key", "x.id", "x.payload_json"
    )


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records per window and group; a window closes when the watermark has passed it, later records are dropped."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width), by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("window.start").alias("start"), by, "rows")
    )


def merge_changes(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keep a table of the latest row per key up to date from a stream of rows.

    Each batch is joined with the table as it was and written as the next version; the version's
    number is the batch's, so a repeated batch starts from the same version as before.
    """
    columns = stream.columns

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        last = rows.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in columns if c not in (order, *keys)))).alias("x"))
        out = last.select(*keys, "x.*").select(*columns)
        out.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
