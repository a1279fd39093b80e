from pyspark.sql import functions as F

from lorespark.operators import records
from lorespark.plans.canonical import oplog
from lorespark.runtime import scratch_path
from lorespark.schema import MUTATIONS, struct
from lorespark.streaming import oplog as S


def source(spark, sf):
    path = scratch_path(spark, "stream-in")
    df = oplog(spark, sf).withColumns({"op_kind": F.lit("append"), "schema_id": F.lit(None).cast("string"), "write_cursor": F.col("id")})
    df.select(*(f.name for f in struct(MUTATIONS))).repartition(5).write.parquet(path)
    return df, path


def run(q):
    q.processAllAvailable() if q.isActive else None
    q.awaitTermination(60)


def test_append_is_exactly_once(spark, sf):
    df, path = source(spark, sf)
    out, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "mark")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(struct(MUTATIONS)).option("maxFilesPerTrigger", 2).parquet(path)
        run(S.append_log(stream, out, mark))
    back = S.read_log(spark, out)
    assert back.count() == df.count() == back.select("id").distinct().count()


def test_merged_table_is_the_latest_state(spark, sf):
    df, path = source(spark, sf)
    out, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "mark")
    stream = spark.readStream.schema(struct(MUTATIONS)).option("maxFilesPerTrigger", 2).parquet(path)
    run(S.merge_changes(stream, out, mark, ["collection_name", "record_key"], "id"))
    fs_versions = [2, 1, 0]
    last = next(v for v in fs_versions if _exists(spark, f"{out}/version={v}"))
    got = spark.read.parquet(f"{out}/version={last}").select("collection_name", "record_key", "id", "payload_json")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.latest_state(df).collect()))


def _exists(spark, path):
    try:
        spark.read.parquet(path)
        return True
    except Exception:
        return False


def test_windowed_counts_and_state_in_memory(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = S.windowed_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run(q)
    assert spark.table("counts").agg(F.sum("rows")).first()[0] == events.count()
    _, log = source(spark, sf)
    q = S.latest_state(spark.readStream.schema(struct(MUTATIONS)).parquet(log)).writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    run(q)
    assert spark.table("state").count() == records.latest_state(oplog(spark, sf)).count()
