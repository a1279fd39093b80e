"""Only new or changed records: a Merkle tree over key ranges, published together with the output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.skew import joined
from lorespark.operators.widen import latest
from lorespark.runtime import filesystem, written

#: Keys of 2 ** 8 consecutive cursors share a leaf range.
RANGE_BITS = 8
#: Each range has 2 ** 4 leaves, by a hash of the rest of the key: one cursor with very many records spreads.
SPLIT_BITS = 4
#: An inner node has the leaves of 2 ** 4 ranges.
NODE_BITS = 4
#: A block, the unit of writing, has 2 ** 16 cursors by default.
BLOCK_BITS = 16
#: The leaf range of NULL cursors, below that of any bigint.
NULL_RANGE = -(2**58)
#: When the current state lies in more versions than this, the next run writes all of it anew.
MOST_VERSIONS = 16
_DIGEST = "digest bigint, check bigint, records bigint"


class IncrementalStore:
    """State, tree and output of each successful run, in one folder, with one pointer to the current version.

    A version's folder holds an index (one row per block: digest and the version that holds it), the
    tree and the state of the blocks it wrote, and the output of its run. Blocks that did not change are
    referenced where they are. A run publishes output, tree and state by renaming one small pointer
    file: whatever fails before that leaves the earlier version current, so the next run finds the same
    changes, and what is published once is never handed out again. One run at a time is assumed.

    Keys are a whole number (cursor) and a text (rest). ``block_bits`` is fixed when the store is made.
    """

    def __init__(self, spark: SparkSession, path: str, cursor: str, rest: str, value: str, order: str, block_bits: int = BLOCK_BITS):
        self.spark, self.path = spark, path.rstrip("/")
        self.cursor, self.rest, self.value, self.order = cursor, rest, value, order
        self.block_shift = block_bits - RANGE_BITS
        if self.block_shift < NODE_BITS:
            raise ValueError(f"a block has at least {1 << (RANGE_BITS + NODE_BITS)} cursors")

    # -- versions ---------------------------------------------------------------------------

    def manifest(self) -> dict:
        """The current version's name, or None, and the versions whose output is published, in order."""
        fs, pointer = filesystem(self.spark, f"{self.path}/CURRENT")
        if not fs.exists(pointer):
            return {"version": None, "outputs": []}
        stream = fs.open(pointer)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> str | None:
        return self.manifest()["version"]

    def publish(self, manifest: dict) -> None:
        """Make a staged version the current one: the only step that other runs can see."""
        fs, staged = filesystem(self.spark, f"{self.path}/CURRENT.{manifest['version']}")
        out = fs.create(staged, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            staged.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        context.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT"), options)

    def vacuum(self) -> int:
        """Remove the folders of failed runs, and of earlier ones that hold no current block and no output; returns how many."""
        manifest = self.manifest()
        keep = {manifest["version"], *manifest["outputs"], *self._holders(manifest["version"])}
        fs, place = filesystem(self.spark, self.path)
        gone = 0
        for status in fs.listStatus(place) if fs.exists(place) else []:
            name = status.getPath().getName()
            if name != "CURRENT" and name not in keep:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def output(self, version: str | None = None) -> DataFrame:
        """The output of one published run, or of all of them: every record change exactly once."""
        versions = self.manifest()["outputs"] if version is None else [version]
        return self.spark.read.parquet(*(f"{self.path}/{v}/output" for v in versions))

    # -- state and tree ---------------------------------------------------------------------

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with the block, leaf range and split of their key; NULL cursors have a range of their own."""
        span = F.coalesce(F.shiftright(F.col(self.cursor).cast("bigint"), RANGE_BITS), F.lit(NULL_RANGE))
        return rows.select(
            F.col(self.cursor).cast("bigint").alias(self.cursor), self.rest, self.value, self.order,
            F.shiftright(span, self.block_shift).alias("__block"), span.alias("__range"),
            F.expr(f"pmod(xxhash64(`{self.rest}`), {1 << SPLIT_BITS})").cast("int").alias("__split"),
        )

    def _latest(self, placed: DataFrame) -> DataFrame:
        return latest(placed, [self.cursor, self.rest, "__block", "__range", "__split"], self.value, self.order)

    def _leaves(self, state: DataFrame) -> DataFrame:
        """(__block, leaf, node, d, c, n): two digests of each leaf's records, with different seeds, and their count."""
        # NULL and the text 'null' differ in the flag.
        record = [F.col(self.cursor), F.col(self.rest), F.col(self.value), F.isnull(self.cursor), F.isnull(self.rest), F.isnull(self.value)]
        leaves = state.groupBy("__block", "__range", "__split").agg(
            F.bit_xor(F.xxhash64(*record)).alias("d"),
            F.bit_xor(F.xxhash64(F.lit(17), *reversed(record))).alias("c"),
            F.count(F.lit(1)).alias("n"),
        )
        leaf = F.shiftleft("__range", SPLIT_BITS) + F.col("__split")
        return leaves.select("__block", leaf.alias("leaf"), F.shiftright("__range", NODE_BITS).alias("node"), "d", "c", "n")

    @staticmethod
    def _digests(leaves: DataFrame, *by: str) -> DataFrame:
        """Inner nodes hash the leaves below them."""
        return leaves.groupBy(*by).agg(
            F.bit_xor(F.xxhash64("leaf", "d", "n")).alias("digest"),
            F.bit_xor(F.xxhash64(F.lit(17), "c", "n", "leaf")).alias("check"),
            F.sum("n").alias("records"),
        )

    def _index(self, version: str | None) -> DataFrame:
        """(__block, digest, check, records, version) of all blocks of a version."""
        kinds = f"__block bigint, {_DIGEST}, version string"
        if version is None:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{version}/index")

    def _holders(self, version: str | None) -> list[str]:
        """The versions that hold the blocks of a version: at most MOST_VERSIONS and itself."""
        return sorted(r.version for r in self._index(version).select("version").distinct().collect())

    def _held(self, what: str, owned: DataFrame, holders: list[str]) -> DataFrame:
        """Rows of the tree or the state of the blocks in owned (__block, version), from wherever they lie.

        Folders are by block, so other blocks' files are not read.
        """
        parts = [joined(self._part(what, v), owned.where(F.col("version") == v).select("__block"), ["__block"], "left_semi") for v in holders]
        return reduce(DataFrame.unionByName, parts)

    def _part(self, what: str, version: str) -> DataFrame:
        kinds = {
            "state": f"`{self.cursor}` bigint, `{self.rest}` string, `{self.value}` string, __range bigint, __split int",
            "tree": f"level int, parent bigint, node bigint, {_DIGEST}",
        }[what]
        return self.spark.read.schema(f"{kinds}, __block bigint").parquet(f"{self.path}/{version}/{what}")

    def state(self, version: str) -> DataFrame:
        """All current records of a version: cursor, rest, value, __range, __split, __block."""
        return self._held("state", self._index(version), self._holders(version))

    # -- one run ----------------------------------------------------------------------------

    @staticmethod
    def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        """(key) of the rows that only one side has, or whose digests differ."""
        sums = ("digest", "check", "records")
        both = a.select(key, *sums).unionAll(b.select(key, *sums))
        found = both.groupBy(key).agg(F.count(F.lit(1)).alias("sides"), *(f(c).alias(f"{f.__name__}_{c}") for c in sums for f in (F.min, F.max)))
        differs = F.col("sides") == 1
        for c in sums:
            differs = differs | (F.col(f"min_{c}") != F.col(f"max_{c}"))
        return found.where(differs).select(key)

    def _write_blocks(self, rows: DataFrame, version: str) -> DataFrame:
        """Write the state and the tree of the blocks of rows; returns their index rows."""
        base = f"{self.path}/{version}"
        state = self._latest(rows)
        by = ("__block", "__range", "__split", self.rest)
        state.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("__block").parquet(f"{base}/state")
        leaves = written(self._leaves(self._part("state", version)), "leaves")
        nodes = self._digests(leaves, "__block", "node").withColumns({"level": F.lit(1), "parent": F.col("__block")})
        lowest = self._digests(leaves, "__block", "node", "leaf").withColumns({"level": F.lit(0), "parent": F.col("node"), "node": F.col("leaf")}).drop("leaf")
        tree = lowest.unionByName(nodes).repartitionByRange("__block", "level", "node")
        tree.write.partitionBy("__block").parquet(f"{base}/tree")
        return self._digests(leaves, "__block").withColumn("version", F.lit(version))

    def _changes(self, owned: DataFrame, holders: list[str], version: str) -> DataFrame:
        """(cursor, rest, value, change) between the blocks in owned and those a run wrote, by descent from nodes to leaves to records."""
        sides = [lambda what: self._held(what, owned, holders), lambda what: self._part(what, version)]
        if not holders:
            rows = self._part("state", version)
            return rows.select(self.cursor, self.rest, self.value, F.lit("new").alias("change"))
        a, b = (side("tree") for side in sides)
        nodes = self._differing(a.where("level = 1"), b.where("level = 1"), "node").select(F.col("node").alias("parent"))
        below = [t.where("level = 0").join(nodes, "parent", "left_semi") for t in (a, b)]
        leaves = self._differing(*below, "node").select(
            F.shiftright("node", SPLIT_BITS).alias("__range"), F.expr(f"pmod(node, {1 << SPLIT_BITS})").cast("int").alias("__split")
        )
        leaves, keys = written(leaves, "changed-leaves"), [self.cursor, self.rest]

        def part(side, name: str) -> DataFrame:
            rows = joined(side("state"), leaves, ["__range", "__split"], "left_semi")
            return rows.select(*(F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)), F.struct(self.value).alias(name))

        both = part(sides[0], "a").join(part(sides[1], "b"), F.col("a0").eqNullSafe(F.col("b0")) & F.col("a1").eqNullSafe(F.col("b1")), "full_outer")
        change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").otherwise("changed")
        return both.where(F.col("a").isNull() | F.col("b").isNull() | ~F.col(f"a.{self.value}").eqNullSafe(F.col(f"b.{self.value}"))).select(
            *(F.when(F.col("b").isNull(), F.col(f"a{i}")).otherwise(F.col(f"b{i}")).alias(k) for i, k in enumerate(keys)),
            F.col(f"b.{self.value}").alias(self.value),
            change.alias("change"),
        )

    def run(self, rows: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None, output: bool = True) -> DataFrame | None:
        """One run over all rows: find what changed since the current version, write the output, publish. Returns the output.

        The changes are (cursor, rest, value, change): change is ``new``, ``changed`` or ``removed``; NULL equals NULL, in
        keys and in values. The output is ``transform(changes)``, or the changes as they are; it may be worked out more
        than once, as any Spark job, but is published once, together with the tree that says it is done. ``output=False``
        takes the rows as done (what an earlier run of another kind has processed).

        Rows are reduced to block digests first; only blocks whose digests differ are read again, compared and written.
        Failed runs' folders are removed by the next run that succeeds.
        """
        manifest, version = self.manifest(), uuid.uuid4().hex
        old, base, placed = manifest["version"], f"{self.path}/{version}", self._placed(rows)
        holders = self._holders(old)
        if old is None or len(holders) > MOST_VERSIONS:
            index = self._write_blocks(placed, version)
            index.write.parquet(f"{base}/index")
            owned = self._index(old).select("__block", "version")
        else:
            digests = self._digests(self._leaves(self._latest(placed)), "__block")
            blocks = written(self._differing(self._index(old), digests, "__block"), "changed-blocks")
            index = self._write_blocks(joined(placed, blocks, ["__block"], "left_semi"), version)
            kept = self._index(old).join(blocks, "__block", "left_anti").select(index.columns)
            kept.unionByName(index).coalesce(8).write.parquet(f"{base}/index")
            owned = self._index(old).join(blocks, "__block", "left_semi").select("__block", "version")
        if output:
            owned = written(owned, "owned-blocks") if holders else owned
            changes = self._changes(owned, holders, version)
            (changes if transform is None else transform(changes)).write.parquet(f"{base}/output")
            manifest["outputs"].append(version)
        self.publish({"version": version, "outputs": manifest["outputs"]})
        self.vacuum()
        return self.output(version) if output else None


def last_successful(runs: DataFrame, projection: str):
    """snapshot_at of the projection's succeeded run with the latest snapshot, or None."""
    done = runs.where((F.col("projection") == projection) & (F.col("status") == "succeeded"))
    return done.agg(F.max("snapshot_at")).first()[0]


def changed_since(rows: DataFrame, snapshot, path: str, cursor: str, rest: str, value: str, order: str) -> DataFrame:
    """(cursor, rest, value, change) of the keys that are new or changed since a run that read order <= snapshot.

    A key's value is that of its latest row by ``order``; a NULL order counts as earliest, and as not
    read by the run. If the store at ``path`` is empty, the tree of that run is built from the rows it read, as it
    would have left it. Then a run takes what changed and publishes it with the new tree. snapshot None: everything is new.
    Repeated rows change nothing; an empty table gives no rows; other columns are ignored.
    """
    store = IncrementalStore(rows.sparkSession, path, cursor, rest, value, order)
    if snapshot is not None and store.current() is None:
        instant = F.lit(snapshot.isoformat(sep=" ")).cast("timestamp_ntz") if dict(rows.dtypes)[order] == "timestamp_ntz" else F.lit(snapshot)
        store.run(rows.where(F.col(order) <= instant), output=False)
    return store.run(rows).where(F.col("change") != "removed")
