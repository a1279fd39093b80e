"""Tables as immutable parquet parts, with one manifest that is swapped at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lorespark.runtime import filesystem
from lorespark.schema import struct


class Store:
    """A folder of parts and a manifest saying which parts make up each table.

    A batch adds its parts first and then publishes a new manifest by one rename, so readers see
    all of it or nothing; what a failed batch left behind is named nowhere and ``vacuum`` removes it.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def manifest(self) -> dict:
        fs, place = filesystem(self.spark, f"{self.path}/MANIFEST")
        if not fs.exists(place):
            return {"cursor": 0, "tables": {}, "meta": {}}
        stream = fs.open(place)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, staged = filesystem(self.spark, f"{self.path}/MANIFEST.{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), conf).rename(
            staged, jvm.org.apache.hadoop.fs.Path(f"{self.path}/MANIFEST"), options
        )

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        parts = (manifest or self.manifest())["tables"].get(name, [])
        schema = struct(self.schemas[name])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts))

    def read_part(self, name: str, part: str) -> DataFrame:
        return self.spark.read.schema(struct(self.schemas[name])).parquet(f"{self.path}/{part}")

    def add(self, manifest: dict, name: str, df: DataFrame) -> str:
        """Write a part and name it in a manifest that is not yet published; returns the part."""
        part = f"{name}/{uuid.uuid4().hex}"
        columns = struct(self.schemas[name])
        df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in columns)).write.parquet(f"{self.path}/{part}")
        manifest["tables"].setdefault(name, []).append(part)
        return part

    def replace(self, manifest: dict, name: str, df: DataFrame) -> None:
        """Write the table anew; the old parts stay until vacuum."""
        manifest["tables"][name] = []
        self.add(manifest, name, df)

    def vacuum(self) -> int:
        """Remove parts that the manifest does not name; returns how many."""
        named = {p for parts in self.manifest()["tables"].values() for p in parts}
        gone = 0
        for name in self.schemas:
            fs, place = filesystem(self.spark, f"{self.path}/{name}")
            if fs.exists(place):
                for status in fs.listStatus(place):
                    if f"{name}/{status.getPath().getName()}" not in named:
                        fs.delete(status.getPath(), True)
                        gone += 1
        return gone
