"""The stored tables as derived from the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.records import supersede
from lorespark.runtime import prepare

#: The fixed clock of the catalogue's queries.
NOW = 1_773_000_000
EDGE_NOW = 1_704_500_000


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "canonical_nodes")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as facts (user, event type, topic), later ones ending earlier ones."""
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")  # whatever the session's zone
    topic = F.get_json_object("props", "$.k")
    df = read(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("write_cursor"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("u:"), F.col("user_id")).alias("from_id"),
        F.concat(F.lit("t:"), topic).alias("to_id"),
        F.concat(F.lit("src:"), F.col("event_id") % 7).alias("source_id"),
        F.concat(F.lit("e:"), F.col("user_id"), F.lit(":"), topic).alias("logical_id"),
        F.concat(F.lit("the "), F.col("event_type"), F.lit(" event of user "), F.col("user_id"), F.lit(" on topic "), topic).alias("body"),
        at.alias("t_valid"),
        F.when(F.col("event_id") % 10 == 3, at + 86_400).alias("t_invalid"),
        ((F.col("event_id") % 10) / 10.0).cast("double").alias("confidence"),
        (F.col("event_id") % 17 == 0).alias("temporal_fallback"),
    )
    return supersede(df, ["from_id", "kind", "to_id"])


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("id"),
        F.col("event_type").alias("collection_name"),
        F.col("user_id").cast("string").alias("record_key"),
        F.col("props").alias("payload_json"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("write_cursor"), F.col("embedding").cast("array<double>").alias("v"), F.col("label")
    )


EDGES_SQL = """edges AS (
  SELECT *, lead(write_cursor) OVER (PARTITION BY from_id, kind, to_id ORDER BY write_cursor) AS superseded_at FROM (
    SELECT event_id + 1 AS write_cursor, event_type AS kind, 'u:' || user_id AS from_id,
           't:' || json_extract_string(props, '$.k') AS to_id, 'src:' || (event_id % 7) AS source_id,
           'e:' || user_id || ':' || json_extract_string(props, '$.k') AS logical_id,
           'the ' || event_type || ' event of user ' || user_id || ' on topic ' || json_extract_string(props, '$.k') AS body,
           CAST(floor(epoch(ts)) AS BIGINT) AS t_valid,
           CASE WHEN event_id % 10 = 3 THEN CAST(floor(epoch(ts)) AS BIGINT) + 86400 END AS t_invalid,
           (event_id % 10) / 10.0 AS confidence, event_id % 17 = 0 AS temporal_fallback
    FROM events))"""
OPLOG_SQL = """oplog AS (SELECT event_id + 1 AS id, event_type AS collection_name, CAST(user_id AS VARCHAR) AS record_key,
  props AS payload_json FROM events)"""
VECTORS_SQL = "vectors AS (SELECT vec_id AS write_cursor, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
