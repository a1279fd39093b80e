"""Session set-up, the shared folder for written intermediates, and shipping code to workers."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lorespark

# Workers get our functions by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(lorespark)

_temporary: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine, with the settings the queries expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the bytes of an Arrow batch, so that long texts never pile up in a Python worker.

    Settings the session already carries are left alone.
    """
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"),
    ):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else a folder of this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lorespark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        _temporary.append((spark, folder))
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    return path


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table written to the shared folder and read back: later passes read it, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem for path, and path as its Path."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_temporary):
        try:
            fs, place = filesystem(spark, path)
            fs.delete(place, True)
        except Exception:  # the session may be gone
            return


def worker_cache() -> dict:
    """What a Python worker keeps between tasks, such as a loaded tokenizer."""
    return sys.__dict__.setdefault("_lorespark_worker_cache", {})
