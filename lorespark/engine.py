"""The public surface: one engine over one folder."""

from __future__ import annotations

import hashlib
import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from lorespark import schema as S
from lorespark.errors import (
    CollectionError, DenseUnavailableError, IllegalTransitionError, InvalidFilterError, LoreError, NotLifecycleAddressableError,
    ProjectionError, WriteValidationError,
)
from lorespark.functions import payload
from lorespark.functions.stem import index_tokens, index_tokens_udf
from lorespark.operators import fusion, graph, predicates, providers, records, text, vector
from lorespark.operators.predicates import Filter, ReadView, SearchFilter, checked_limit
from lorespark.operators.skew import HOT_ROWS, positions
from lorespark.runtime import prepare, written
from lorespark.sources.store import Store

TABLES = {
    "nodes": S.NODES,
    "edges": S.EDGES,
    "transitions": "logical_id string, write_cursor bigint, state string, reason string",
    "collections": S.COLLECTIONS,
    "mutations": S.MUTATIONS,
    "attributes": S.ATTRIBUTES,
    "vectors": "write_cursor bigint, embedding array<float>, source_type string, kind string, created_at bigint, status string",
    "postings": "write_cursor bigint, field string, term string, tf int, dl int",
    "lengths": "write_cursor bigint, field string, dl int",
    "projection_failures": "write_cursor bigint, failure_code string, recorded_at bigint",
    "telemetry": "session int, seq int, type string, query_id string, query_chars int, result_ids array<bigint>, result_stable_ids array<string>, "
                 "label_source string, labels map<bigint,int>",
    "audit": "write_cursor bigint, action string, subject_sha256 string, at bigint",
}
#: The text arm's candidates, whatever the limit, so that a longer list begins with the shorter one.
TEXT_CANDIDATES = 100
ROLES = ("filterable", "rankable", "searchable")
#: Fixed value: so many first vectors give the mean that is pinned.
MEAN_PIN = 256
#: Seconds to wait before each new try at embedding what failed.
RETRY_WAITS = (1, 4, 16)
#: Telemetry events kept in the session before they are written to the store.
TELEMETRY_BUFFER = 100
#: What hangs on the cursor of a node or an edge and goes with it.
OWNED = ("attributes", "vectors", "postings", "lengths", "projection_failures")


class HashingEmbedder:
    """The default embedder: unit-length counts of hashed words; the same text gives the same vector everywhere."""

    def __init__(self, dim: int = 64):
        self.dim, self.identity = dim, f"hashing-{dim}"

    def embed(self, value: str) -> list[float]:
        out = np.zeros(self.dim)
        for token in index_tokens(value):
            out[int(hashlib.sha1(token.encode()).hexdigest(), 16) % self.dim] += 1
        norm = np.linalg.norm(out)
        return (out / norm if norm else out).tolist()

    def column(self, body: str):
        embed = self.embed

        @F.pandas_udf(ArrayType(FloatType()))
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: embed(t or ""))

        return run(F.col(body))


@dataclass(frozen=True)
class ProjectionSpec:
    """A declared attribute: its roles and where in a body it is found."""

    name: str
    roles: tuple[str, ...] = ("filterable",)
    path: str | None = None
    vector: bool = False


@dataclass
class SearchResult:
    """hits is a DataFrame in order of rank; query() and fallback() run it."""

    hits: DataFrame
    trace: dict = field(default_factory=dict)
    arms: dict[str, DataFrame] = field(default_factory=dict)
    pending: Callable[[], int] = lambda: 0

    def rows(self) -> list:
        return self.hits.orderBy("rank").collect()  # at most the limit, which is 100

    def soft_fallback(self) -> str | None:
        """The arm that gave nothing where the text arm gave something, while rows wait for their vectors; taken before fusion."""
        if "vector" in self.arms and not self.arms["text"].isEmpty() and self.arms["vector"].isEmpty() and self.pending():
            return "vector"
        return None


def _text(item: dict, name: str, empty: bool = False) -> str:
    value = item.get(name)
    if not isinstance(value, str) or (not value and not empty):
        raise WriteValidationError(f"{name} must be a text that is not empty")
    return value


def _whole(item: dict, name: str) -> int | None:
    value = item.get(name)
    if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
        raise WriteValidationError(f"{name} must be a whole number")
    return value


class Engine:
    """Records, facts, logs and their projections in one folder, with the verbs to write and search them."""

    def __init__(self, spark: SparkSession, path: str, embedder=None, clock: Callable[[], int] = lambda: int(time.time())):
        self.spark, self.store, self.embedder, self.clock = prepare(spark), Store(spark, path, TABLES), embedder, clock
        self.counts: Counter = Counter()
        self._telemetry: list[dict] | None = None
        self._session = self._events = 0
        self.read, self.graph, self.admin = _Read(self), _Graph(self), _Admin(self)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, use_default_embedder: bool = True, embedder=None, clock=None) -> Engine:
        if embedder is None and use_default_embedder:
            embedder = HashingEmbedder()
        engine = cls(spark, path, embedder, clock or (lambda: int(time.time())))
        meta = engine.store.manifest()["meta"]
        known = meta.get("embedder")
        if embedder is not None and known not in (None, embedder.identity):
            raise DenseUnavailableError(f"the vectors were made by {known}, not {embedder.identity}")
        return engine

    def report(self) -> dict:
        meta = self.store.manifest()["meta"]
        return {"schema_version": S.SCHEMA_VERSION, "embedder": meta.get("embedder"), "dense_disabled": self.embedder is None}

    def close(self) -> None:
        if self._telemetry is not None:
            self.disable_telemetry()

    def counters(self) -> dict[str, int]:
        return dict(self.counts)

    # -- tables -----------------------------------------------------------------------------

    def nodes(self, manifest: dict | None = None, ids: list[str] | None = None) -> DataFrame:
        """All versions with what later rows did to them: superseded_at from later versions, state from transitions.

        ``ids``: only the versions of these logical ids are read; the condition reaches the scan. Keys are counted for hot
        ones only where the store has enough rows to have any.
        """
        manifest = manifest or self.store.manifest()
        stored, moves = self.store.table("nodes", manifest).drop("superseded_at"), self.store.table("transitions", manifest)
        if ids is not None:
            stored, moves = (t.where(F.col("logical_id").isin(ids)) for t in (stored, moves))
        rows = records.supersede(stored, ["logical_id"], hot_rows=HOT_ROWS if ids is None and manifest["cursor"] >= HOT_ROWS else None)
        last = moves.groupBy("logical_id").agg(
            F.max(F.struct("write_cursor", "state", "reason")).alias("t")
        )
        rows = rows.join(last, "logical_id", "left")
        moved = F.col("t").isNotNull() & (F.col("t.write_cursor") > F.col("write_cursor")) & F.col("superseded_at").isNull()
        rows = rows.withColumns(
            {"state": F.when(moved, F.col("t.state")).otherwise(F.col("state")), "reason": F.when(moved, F.col("t.reason")).otherwise(F.col("reason"))}
        )
        return rows.select(*(f.name for f in S.struct(S.NODES)))

    def edges(self, manifest: dict | None = None) -> DataFrame:
        """All facts; a later one of the same (from, kind, to) ends the earlier."""
        manifest = manifest or self.store.manifest()
        hot = HOT_ROWS if manifest["cursor"] >= HOT_ROWS else None
        rows = records.supersede(self.store.table("edges", manifest).drop("superseded_at"), ["from_id", "kind", "to_id"], hot_rows=hot)
        return rows.select(*(f.name for f in S.struct(S.EDGES)))

    # -- writing ----------------------------------------------------------------------------

    def write(self, batch: list[dict]) -> dict:
        """All items or none, in order, each with a cursor of its own. Returns cursors and the number of dangling edge ends."""
        manifest = self.store.manifest()
        cursor, parts = manifest["cursor"], {n: [] for n in ("nodes", "edges", "mutations", "collections")}
        known = {r.name: r for r in self.store.table("collections", manifest).collect()}  # few, declared by hand
        now, cursors = self.clock(), []
        for item in batch:
            cursor += 1
            cursors.append(cursor)
            kind, row = self._prepared(item, cursor, now, known)
            parts[kind].append(row)
        for name, rows in parts.items():
            if rows:
                frame = self.spark.createDataFrame(rows, S.struct(TABLES[name]))
                self.store.add(manifest, name, frame)
                if name in ("nodes", "edges"):
                    self._project_new(manifest, name, frame)
        manifest["cursor"] = cursor
        self.store.publish(manifest)
        self.counts.update(writes=1, write_rows=len(batch))
        dangling = 0
        if parts["edges"]:
            mine = self.spark.createDataFrame(parts["edges"], S.struct(S.EDGES))
            dangling = records.dangling_endpoints(mine, self.nodes()).count()
        return {"cursors": cursors, "dangling_edge_endpoints": dangling}

    def write_frame(self, table: str, df: DataFrame) -> int:
        """Append nodes or edges in bulk, distributed: the same checks as filters, cursors by position. Returns the rows written."""
        manifest = self.store.manifest()
        total = self._append(manifest, table, df)
        self.store.publish(manifest)
        self.counts.update(writes=1, write_rows=total)
        return total

    def _append(self, manifest: dict, table: str, df: DataFrame) -> int:
        """write_frame into a manifest that is not yet published."""
        if table not in ("nodes", "edges"):
            raise WriteValidationError("nodes and edges are written in bulk")
        needed = ["kind", "source_id"] + (["from_id", "to_id"] if table == "edges" else [])
        bad = F.lit(False)
        for c in needed:
            bad = bad | F.col(c).isNull() | (F.col(c) == "")
        bad = bad | F.col("source_id").startswith(records.RESERVED)
        for f in S.struct(TABLES[table]):
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit("active" if f.name == "state" else "leaf" if f.name == "row_kind" else None).cast(f.dataType))
        whole = ("valid_from", "valid_until") if table == "nodes" else ("t_valid", "t_invalid")
        if wrong := [c for c in whole if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long", "void")]:
            raise WriteValidationError(f"{wrong} must be whole numbers")
        weight = "importance" if table == "nodes" else "confidence"
        if df.schema[weight].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal", "void"):
            raise WriteValidationError(f"{weight} must be a number")
        bad = bad | ~F.coalesce(F.col(weight).cast("double").between(0, 1), F.col(weight).isNull()) | F.coalesce(F.isnan(F.col(weight).cast("double")), F.lit(False))
        if table == "nodes":
            bad = bad | F.coalesce(F.col("valid_from") >= F.col("valid_until"), F.lit(False)) | ~F.col("state").isin("pending", "active")
        if not df.where(F.coalesce(bad, F.lit(True))).isEmpty():
            raise WriteValidationError("the table holds invalid rows")
        # Dense cursors without a global sort: rows are written once with their partition and place, then shifted.
        placed = written(df.withColumn("__at", F.monotonically_increasing_id()), "write")
        part = F.shiftright("__at", 33)
        sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
        offsets = sizes.withColumn("__b", F.coalesce(before, F.lit(0))).select("__p", "__b")
        total = sizes.agg(F.sum("__n")).first()[0] or 0
        cursor = F.lit(manifest["cursor"] + 1) + F.col("__b") + F.col("__at").bitwiseAND((1 << 33) - 1)
        rows = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("write_cursor", cursor)
        part = self.store.add(manifest, table, rows)
        manifest["cursor"] += total
        self._project_new(manifest, table, self.store.read_part(table, part))
        return total

    def _prepared(self, item: dict, cursor: int, now: int, known: dict) -> tuple[str, dict]:
        if not isinstance(item, dict):
            raise WriteValidationError("an item is a dict")
        kind = item.get("type", "node")
        if kind in ("node", "edge"):
            source = _text(item, "source_id")
            if source.startswith(records.RESERVED):
                raise WriteValidationError("source ids that begin with _ are reserved")
        if kind == "node":
            row = {f.name: item.get(f.name) for f in S.struct(S.NODES)}
            begin, end = _whole(item, "valid_from"), _whole(item, "valid_until")
            if begin is not None and end is not None and begin >= end:
                raise WriteValidationError("valid_from must be before valid_until")
            state = item.get("state", "active")
            if state not in ("pending", "active"):
                raise WriteValidationError("a record begins pending or active")
            weight = item.get("importance")
            if weight is not None and (isinstance(weight, bool) or not isinstance(weight, (int, float)) or not 0 <= weight <= 1):
                raise WriteValidationError("importance is a number in 0..1")
            row |= {"write_cursor": cursor, "kind": _text(item, "kind"), "body": item.get("body", "{}"), "source_id": source, "state": state,
                    "row_kind": item.get("row_kind", "leaf"), "superseded_at": None, "importance": None if weight is None else float(weight)}
            if not isinstance(row["body"], str):
                row["body"] = json.dumps(row["body"], ensure_ascii=False)
            return "nodes", row
        if kind == "edge":
            row = {f.name: item.get(f.name) for f in S.struct(S.EDGES)}
            _whole(item, "t_valid"), _whole(item, "t_invalid")
            sure = item.get("confidence")
            if sure is not None and (isinstance(sure, bool) or not 0 <= sure <= 1):
                raise WriteValidationError("confidence is a number in 0..1")
            row |= {"write_cursor": cursor, "kind": _text(item, "kind"), "from_id": _text(item, "from"), "to_id": _text(item, "to"),
                    "source_id": source, "superseded_at": None, "confidence": None if sure is None else float(sure)}
            return "edges", row
        if kind == "op_store":
            name = _text(item, "collection")
            if name not in known:
                raise CollectionError(f"no collection {name}")
            body = item.get("body")
            body = body if isinstance(body, str) else json.dumps(body)
            found = payload.violations(json.loads(body), json.loads(known[name].schema_json))
            if found:
                raise WriteValidationError("; ".join(found))
            return "mutations", {"id": cursor, "collection_name": name, "record_key": _text(item, "record_key"),
                                 "op_kind": "append" if known[name].kind == "append_only_log" else "upsert",
                                 "payload_json": body, "schema_id": item.get("schema_id"), "write_cursor": cursor}
        if kind == "admin_schema":
            row = self.admin.collection_row(item.get("name"), item.get("kind"), item.get("schema_json", "{}"), item.get("retention_json", "{}"), now)
            known[row["name"]] = type("Row", (), row)
            return "collections", row
        raise WriteValidationError(f"unknown item type {kind}")

    # -- lifecycle --------------------------------------------------------------------------

    def transition(self, logical_id: str, to: str, reason: str | None = None) -> None:
        if not logical_id or logical_id[:2] in ("h:", "p:"):
            raise NotLifecycleAddressableError(logical_id)
        found = self.nodes(ids=[logical_id]).where(F.col("superseded_at").isNull()).select("state").first()
        if found is None:
            raise NotLifecycleAddressableError(logical_id)
        legal = [b for a, b in records.TRANSITIONS if a == found.state]
        if to not in legal:
            raise IllegalTransitionError(found.state, to, legal)
        manifest = self.store.manifest()
        manifest["cursor"] += 1
        row = (logical_id, manifest["cursor"], to, reason if to == "deleted" else None)
        self.store.add(manifest, "transitions", self.spark.createDataFrame([row], S.struct(TABLES["transitions"])))
        self.store.publish(manifest)

    def purge(self, logical_id: str) -> bool:
        """Remove every trace of a deleted record; False if there is nothing (left) to remove."""
        found = self.nodes(ids=[logical_id]).where(F.col("superseded_at").isNull()).select("state").first()
        if found is None:
            return False
        if found.state != "deleted":
            raise IllegalTransitionError(found.state, "purged", [b for a, b in records.TRANSITIONS if a == found.state])
        ids = self.spark.createDataFrame([(logical_id,)], "logical_id string")
        manifest = self.store.manifest()
        left = records.purge({n: self.store.table(n, manifest) for n in ("nodes", "edges")}, ids)
        self._keep_only(manifest, left)
        self._audit(manifest, "purge", logical_id)
        self.store.publish(manifest)
        self.store.vacuum()
        return True

    def _keep_only(self, manifest: dict, left: dict[str, DataFrame]) -> None:
        """Write nodes and edges anew with what is left, and with them everything that hung on the rows that are gone:
        projections and failures by cursor, lifecycle steps by logical id, and ids in the telemetry."""
        cursors = {n: self.store.table(n, manifest).select("write_cursor", "logical_id") for n in left}
        alive = written(left["nodes"].select("write_cursor").unionAll(left["edges"].select("write_cursor")), "alive")
        gone = written(cursors["nodes"].unionAll(cursors["edges"]).join(alive, "write_cursor", "left_anti"), "gone")
        still = left["nodes"].select("logical_id").where("logical_id IS NOT NULL")
        lost = gone.where("logical_id IS NOT NULL").select("logical_id").distinct().join(still, "logical_id", "left_anti")
        out = dict(left)
        for name in OWNED:
            table = self.store.table(name, manifest)
            out[name] = table.join(gone.select("write_cursor"), "write_cursor", "left_anti").select(table.columns)
        moves = self.store.table("transitions", manifest)
        out["transitions"] = moves.join(lost, "logical_id", "left_anti").select(moves.columns)
        events = self.store.table("telemetry", manifest)
        if not events.isEmpty():
            at = events.select("session", "seq", F.posexplode(F.arrays_zip("result_ids", "result_stable_ids")).alias("p", "x"))
            kept = at.join(gone.select(F.col("write_cursor").alias("g")), F.col("x.result_ids") == F.col("g"), "left_anti").groupBy("session", "seq").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("k")
            )
            labels = events.select("session", "seq", F.explode("labels").alias("i", "v")).join(gone, F.col("i") == F.col("write_cursor"), "left_anti")
            labels = labels.groupBy("session", "seq").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("l"))
            none = F.array().cast("array<bigint>")
            out["telemetry"] = events.join(kept, ["session", "seq"], "left").join(labels, ["session", "seq"], "left").withColumns({
                "result_ids": F.when(F.col("result_ids").isNotNull(), F.coalesce(F.col("k.result_ids"), none)),
                "result_stable_ids": F.when(F.col("result_stable_ids").isNotNull(), F.coalesce(F.col("k.result_stable_ids"), F.array().cast("array<string>"))),
                "labels": F.col("l"),
            }).select(events.columns)
        if self._telemetry:  # what the session has not written yet
            ids = [i for e in self._telemetry for i in (e.get("result_ids") or [])]
            removed = {r.write_cursor for r in gone.where(F.col("write_cursor").isin(ids)).select("write_cursor").collect()}  # ids the buffer holds
            for e in self._telemetry:
                pairs = [p for p in zip(e.get("result_ids") or [], e.get("result_stable_ids") or []) if p[0] not in removed]
                if e.get("result_ids") is not None:
                    e["result_ids"], e["result_stable_ids"] = [p[0] for p in pairs], [p[1] for p in pairs]
                if e.get("labels"):
                    e["labels"] = {k: v for k, v in e["labels"].items() if k not in removed}
        for name, df in out.items():
            self.store.replace(manifest, name, df)

    def erase_source(self, source_id: str, operator: bool = False) -> None:
        """Remove every row of a source, every version, what was projected from them, the lifecycle steps of records of which nothing
        is left, and their ids in the telemetry. Again is no error."""
        if not source_id or (source_id.startswith(records.RESERVED) and not operator):
            raise ValueError("a source id is not empty and does not begin with _")
        manifest = self.store.manifest()
        mine = F.col("source_id").eqNullSafe(F.lit(source_id))
        self._keep_only(manifest, {n: self.store.table(n, manifest).where(~mine) for n in ("nodes", "edges")})
        self._audit(manifest, "erase_source", source_id)
        self.store.publish(manifest)
        self.store.vacuum()

    def _audit(self, manifest: dict, action: str, subject: str) -> None:
        manifest["cursor"] += 1
        row = (manifest["cursor"], action, hashlib.sha256(subject.encode()).hexdigest(), self.clock())
        self.store.add(manifest, "audit", self.spark.createDataFrame([row], S.struct(TABLES["audit"])))

    # -- projections ------------------------------------------------------------------------

    def specs(self, manifest: dict | None = None) -> dict[str, ProjectionSpec]:
        found = (manifest or self.store.manifest())["meta"].get("projections", {})
        return {n: ProjectionSpec(n, tuple(x["roles"]), x["path"], x["vector"]) for n, x in found.items()}

    def configure_projections(self, specs: list[ProjectionSpec], drop: tuple[str, ...] = ()) -> dict:
        """Declare attributes. What is not named stays; changing one needs its name in drop as well; a repeat changes nothing."""
        names = [s.name for s in specs]
        if len(set(names)) < len(names):
            raise ProjectionError("a name is given twice")
        if bad := [s.name for s in specs if not s.roles or not set(s.roles) <= set(ROLES)]:
            raise ProjectionError(f"unknown roles of {bad}")
        manifest = self.store.manifest()
        have, built, unchanged = self.specs(manifest), [], []
        for s in specs:
            if have.get(s.name) == s and s.name not in drop:
                unchanged.append(s.name)
            elif s.name in have and s.name not in drop:
                raise ProjectionError(f"{s.name} is declared otherwise; name it in drop to build it anew")
            else:
                built.append(s.name)
        dropped = [n for n in drop if n in have and n not in names]
        keep = {n: s for n, s in have.items() if n not in drop} | {s.name: s for s in specs}
        manifest["meta"]["projections"] = {n: {"roles": list(s.roles), "path": s.path, "vector": s.vector} for n, s in keep.items()}
        if built or dropped:
            self._project(manifest)
            self.store.publish(manifest)
        unsupported = self.read.unsupported_kinds() if any(s.vector for s in keep.values()) else []
        deferred = [s.name for s in specs if s.vector and self.embedder is None]
        return {"built": built, "dropped": dropped, "deferred": deferred, "unchanged": unchanged, "vector_unsupported_kinds": unsupported}

    def _cells(self, rows: DataFrame, specs: dict[str, ProjectionSpec]) -> DataFrame:
        """(write_cursor, attr_name, attr_value) of the declared scalars in the bodies of rows, whatever their state."""
        body = F.try_parse_json("body")
        cells = [
            F.struct(F.lit(s.name).alias("attr_name"), F.try_variant_get(body, s.path or f"$.{s.name}", "variant").alias("v")) for s in specs.values()
        ]
        kind = F.schema_of_variant("x.v")
        rows = rows.select("write_cursor", F.explode(F.array(*cells)).alias("x"))
        rows = rows.where(F.col("x.v").isNotNull() & (kind != "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"))
        return rows.select("write_cursor", "x.attr_name", F.try_variant_get("x.v", "$", "string").alias("attr_value"))

    def _project_new(self, manifest: dict, table: str, rows: DataFrame) -> None:
        """Postings and attributes of rows just added: only those are read and written. Readers join what they may see."""
        body = F.col("body") if "body" in rows.columns else F.lit(None).cast("string")
        texts = {"fact": body}
        if table == "nodes":
            status = F.try_variant_get(F.try_parse_json("body"), "$.status", "string")
            texts = {"body": body, "kind": F.col("kind"), "status": F.coalesce(status, F.lit(""))}
        fields = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), t.alias("text")) for n, t in texts.items())))
        terms = rows.select("write_cursor", fields.alias("f")).select("write_cursor", "f.field", index_tokens_udf(F.col("f.text")).alias("terms"))
        terms = written(terms, "terms")
        dl = F.size("terms").alias("dl")
        self.store.add(manifest, "lengths", terms.select("write_cursor", "field", dl))
        counted = terms.select("write_cursor", "field", dl, F.explode("terms").alias("term")).groupBy("write_cursor", "field", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        self.store.add(manifest, "postings", counted.sortWithinPartitions("field", "term"))
        specs = self.specs(manifest)
        if table == "nodes" and specs:
            self.store.add(manifest, "attributes", self._cells(rows, specs))

    def _project(self, manifest: dict) -> None:
        """Attributes of all rows, a pure function of them, written anew: after a change of what is declared."""
        specs = self.specs(manifest)
        if not specs:
            manifest["tables"]["attributes"] = []
            return
        self.store.replace(manifest, "attributes", self._cells(self.store.table("nodes", manifest), specs))

    def enrolled(self, manifest: dict) -> bool:
        """Whether rows are to be embedded: unless vectors are declared, and none of the declarations is searchable."""
        declared = [s for s in self.specs(manifest).values() if s.vector]
        return not declared or any("searchable" in s.roles for s in declared)

    def waiting(self, manifest: dict) -> DataFrame:
        """Current rows of embeddable kinds without a vector, and without a failure on record."""
        if not self.enrolled(manifest):
            return self.nodes(manifest).where("false")
        now = self.nodes(manifest).where(ReadView().existence() & predicates.source_type().isNotNull())
        for done in ("vectors", "projection_failures"):
            now = now.join(self.store.table(done, manifest).select("write_cursor"), "write_cursor", "left_anti")
        return now

    def drain(self, waits: tuple[float, ...] = RETRY_WAITS) -> int:
        """Embed what waits for a vector; returns how many rows got one.

        A row whose embedding is NULL is tried again after each of ``waits``, then recorded in projection_failures and left
        alone until rebuild_projections. When 256 rows have vectors the mean of the first 256 is pinned.
        """
        if self.embedder is None:
            return 0
        manifest = self.store.manifest()
        left, n = self.waiting(manifest).select("write_cursor", "kind", "body", predicates.source_type().alias("source_type")), 0
        for wait in (0, *waits):
            time.sleep(wait)
            made = left.select("write_cursor", self.embedder.column("body").alias("embedding"), "source_type", "kind", "body",
                               F.lit(self.clock()).cast("bigint").alias("created_at"), F.lit("").alias("status"))
            made = written(made, "embedded")
            good = made.where("embedding IS NOT NULL")
            fresh = good.count()
            if fresh:
                self.store.add(manifest, "vectors", good)
                n += fresh
            left = made.where("embedding IS NULL").select("write_cursor", "kind", "body", "source_type")
            if left.isEmpty():
                break
        else:
            failed = left.select("write_cursor", F.lit("embedder").alias("failure_code"), F.lit(self.clock()).cast("bigint").alias("recorded_at"))
            self.store.add(manifest, "projection_failures", failed)
        if n:
            manifest["meta"]["embedder"] = self.embedder.identity
            manifest["meta"]["vectors"] = manifest["meta"].get("vectors", 0) + n
            if "mean" not in manifest["meta"] and manifest["meta"]["vectors"] >= MEAN_PIN:
                manifest["meta"]["mean"] = vector.mean_list(self._vectors(manifest), MEAN_PIN)
        self.store.publish(manifest)
        return n

    def _vectors(self, manifest: dict) -> DataFrame:
        return self.store.table("vectors", manifest).select(F.col("write_cursor").alias("id"), F.col("embedding").cast("array<double>").alias("v"))

    def embed(self, value: str) -> list[float]:
        if self.embedder is None:
            raise DenseUnavailableError("no embedder")
        return self.embedder.embed(value)

    # -- search -----------------------------------------------------------------------------

    def _filtered(self, nodes: DataFrame, f: SearchFilter | None, manifest: dict) -> DataFrame:
        if f is None:
            return nodes
        if f.source_type is not None:
            nodes = nodes.where(predicates.source_type() == f.source_type)
        if f.kind is not None:
            nodes = nodes.where(F.col("kind") == f.kind)
        if f.status is not None:  # the search index carries an empty status for every row
            nodes = nodes.where(F.lit("") == F.lit(f.status))
        if f.created_after is not None:
            made = self.store.table("vectors", manifest).where(F.col("created_at") > f.created_after)
            nodes = nodes.join(made.select("write_cursor"), "write_cursor", "left_semi")
        if f.attributes:
            declared = {n for n, s in self.specs(manifest).items() if "filterable" in s.roles}
            nodes = predicates.with_attributes(nodes, self.store.table("attributes", manifest), f.attributes, declared)
        return nodes

    def _lexical(self, ids: DataFrame, query: str, name: str, manifest: dict) -> DataFrame:
        """(qid, id, score, matched) of the rows in ids (id) by the stored postings of one field; only the query's terms are read."""
        asked, mine = self._query_terms(query), ids.select(F.col("id").alias("write_cursor"))
        terms = asked.first()["terms"]  # of one query
        lengths = self.store.table("lengths", manifest).where(F.col("field") == name).join(mine, "write_cursor", "left_semi")
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
        tf = self.store.table("postings", manifest).where((F.col("field") == name) & F.col("term").isin(terms)).join(mine, "write_cursor", "left_semi")
        return text.scored(tf.select(F.col("write_cursor").alias("id"), "dl", "term", "tf"), asked, stats["n"], stats["mean"] or 1.0)

    def _query_terms(self, query: str) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "qid int, q string").select("qid", text.content_terms(F.col("q")).alias("terms"))
        terms = [t for w in asked.first()["terms"] for t in index_tokens(w)]
        return self.spark.createDataFrame([(0, terms)], "qid int, terms array<string>")

    def _facts(self, f: SearchFilter | None, manifest: dict, now: int) -> DataFrame:
        """Live facts under a filter: attributes exclude all of them; a creation time asks for a vector, which no fact has."""
        live = graph.live_edges(self.edges(manifest), now)
        if f is None:
            return live
        if f.attributes or f.source_type not in (None, "edge_fact") or f.status not in (None, ""):
            return live.where("false")
        if f.kind is not None:
            live = live.where(F.col("kind") == f.kind)
        if f.created_after is not None:
            made = self.store.table("vectors", manifest).where(F.col("created_at") > f.created_after)
            live = live.join(made.select("write_cursor"), "write_cursor", "left_semi")
        return live

    def _text_arm(self, query: str, view: ReadView, f: SearchFilter | None, manifest: dict, now: int) -> DataFrame:
        """Nodes by BM25, at most TEXT_CANDIDATES, then matching facts after them: (qid, key, id, kind, source_id, rank)."""
        nodes = self._filtered(records.visible(self.nodes(manifest), now, view), f, manifest)
        meta = nodes.select(F.col("write_cursor").alias("id"), F.col("body").alias("key"), "kind", "source_id", "logical_id", "importance",
                            F.lit(None).cast("double").alias("confidence"))
        hits = written(text.top(self._lexical(meta, query, "body", manifest), TEXT_CANDIDATES), "text-hits")
        out = hits.join(meta, "id").withColumn("branch", F.lit("text"))
        live = self._facts(f, manifest, now)
        facts = live.select(F.col("write_cursor").alias("id"), F.col("body").alias("key"), F.lit("edge_fact").alias("kind"), "source_id", "logical_id",
                            F.lit(None).cast("double").alias("importance"), "confidence")
        scored = self._lexical(facts, query, "fact", manifest)  # all of them count, so one task must not rank them
        ranked = positions(scored, "qid", [F.col("score").desc(), F.col("id")], "rank").join(facts, "id")
        last = hits.count()  # at most TEXT_CANDIDATES
        return out.unionByName(ranked.withColumn("rank", (F.col("rank") + last).cast("int")).withColumn("branch", F.lit("text_edge")))

    def search(
        self, query: str, filter: Filter | SearchFilter | None = None, *, limit: int = 10, view: ReadView = ReadView(), recency: bool = False,
        importance: bool = False, graph_arm: bool = False, reranker: Callable[[str, DataFrame], DataFrame] | None = None, rerank_depth: int = 0,
        alpha: float = 0.3, pool_n: int | None = None, explain: bool = False, candidates: int | None = None,
    ) -> SearchResult:
        """Hybrid search: vectors and text (and facts, and the graph) fused by reciprocal rank.

        Order of work: filters, arms, fusion by body, recency, importance, rerank blend, limit. Only the
        validity axis of the view may be relaxed. The vector arm is exact; with ``candidates`` it reranks so many
        sign-bit candidates, taken around the pinned mean, and may miss some. ``explain`` adds columns and fills the trace.
        """
        checked_limit(limit)
        if view.include_superseded or view.include_inactive:
            raise InvalidFilterError("a search relaxes only validity")
        f = filter.for_search() if isinstance(filter, Filter) else filter
        if self.embedder is None:
            raise DenseUnavailableError("no embedder; search_text_only remains")
        self.counts.update(queries=1)
        manifest, now = self.store.manifest(), self.clock()
        lexical = self._text_arm(query, view, f, manifest, now)
        nodes = self._filtered(records.visible(self.nodes(manifest), now, view), f, manifest)
        vectors = self.store.table("vectors", manifest).join(nodes.select("write_cursor"), "write_cursor", "left_semi")
        asked = self.spark.createDataFrame([(0, self.embed(query))], "qid bigint, v array<double>")
        all_vectors = vectors.select(F.col("write_cursor").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        depth, mean = max(limit, TEXT_CANDIDATES), manifest["meta"].get("mean")
        near = vector.nearest(all_vectors, asked, depth) if candidates is None else vector.two_phase(all_vectors, asked, depth, mean, candidates)
        meta = nodes.select(F.col("write_cursor").alias("id"), F.col("body").alias("key"), "kind", "source_id", "logical_id", "importance")
        dense = near.join(meta, "id").withColumn("qid", F.lit(0))
        arms = [fusion.Arm("vector", dense.select("qid", "key", "id", "rank"), fusion.ARM_WEIGHTS["vector"]),
                fusion.Arm("text", lexical.select("qid", "key", "id", "rank"), fusion.ARM_WEIGHTS["text"])]
        if graph_arm:
            arms.append(fusion.Arm("graph", self._graph_rows(arms, query, manifest, now), fusion.ARM_WEIGHTS["graph"]))
        fused = fusion.rrf(arms)
        known = meta.drop("key").withColumn("confidence", F.lit(None).cast("double")).unionByName(
            lexical.select("id", "kind", "source_id", "logical_id", "importance", "confidence")
        ).dropDuplicates(["id"])
        hits = fused.withColumn("fused_score", F.col("score")).join(known, "id", "left").withColumn("write_cursor", F.col("id"))
        if recency:
            hits = fusion.recency(hits)
        if importance:
            hits = fusion.importance(hits)
        if reranker is not None and rerank_depth:
            hits = fusion.rerank_blend(reranker(query, hits), "logit", rerank_depth, alpha, pool_n)
        trace = {} if not explain else {
            "query_chars": len(query), "limit": limit, "rrf_k": fusion.RRF_K, "arms": {a.name: a.weight for a in arms},
            "filter": None if f is None else {k: v for k, v in vars(f).items() if v}, "recency": recency, "importance": importance,
            "reranked": rerank_depth if reranker is not None else 0, "alpha": alpha, "vector": "exact" if candidates is None else f"sign bits, {candidates}",
            "mean_pinned": mean is not None, "snapshot_cursor": manifest["cursor"],
        }
        result = SearchResult(self._identified(hits, explain).where(F.col("rank") <= limit), trace, {"vector": dense, "text": lexical},
                              lambda: self.waiting(manifest).count())
        if self._telemetry is not None:
            self._capture(query, result)
        return result

    def _graph_rows(self, arms: list, query: str, manifest: dict, now: int) -> DataFrame:
        """Seeds are the ends of matching facts and the first fused hits; candidates are nodes by hop."""
        edges = self.edges(manifest)
        live = graph.live_edges(edges, now, fallback=False)
        facts = self._lexical(live.select(F.col("write_cursor").alias("id")), query, "fact", manifest)
        ends = live.join(text.top(facts, 10).select(F.col("id").alias("write_cursor")), "write_cursor", "left_semi")
        ends = ends.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("p", F.lit(0))
        nodes = self.nodes(manifest).where(ReadView().existence() & F.col("logical_id").isNotNull())
        first = fusion.rrf(arms).where("rank <= 10").join(nodes.select(F.col("write_cursor").alias("id"), "logical_id"), "id")
        seeds = ends.unionByName(first.select(F.col("logical_id").alias("id"), F.col("rank").alias("p"))).groupBy("id").agg(F.min("p").alias("p"))
        seeds = seeds.withColumn("place", F.row_number().over(Window.orderBy("p", "id"))).where("place <= 10")  # few rows
        kinds = nodes.select(F.col("logical_id").alias("id"), "kind")
        found = graph.graph_arm(edges, seeds.select(F.lit(0).alias("qid"), "id", "place"), kinds, now, allowed=kinds.select("id"))
        placed = found.join(nodes.select(F.col("logical_id").alias("id"), F.col("write_cursor").alias("c"), F.col("body").alias("key")), "id")
        return placed.select("qid", "key", F.col("c").alias("id"), "rank")

    def _identified(self, hits: DataFrame, explain: bool) -> DataFrame:
        """Each hit's stable id: l: of a logical id, else h: of its body."""
        space = F.when(F.col("logical_id").isNotNull(), F.struct(F.lit("logical").alias("space"), F.col("logical_id").alias("value")))
        named = hits.withColumn("stable_id", space.otherwise(F.struct(F.lit("content").alias("space"), F.sha2("key", 256).alias("value"))))
        columns = ["rank", "id", F.col("key").alias("body"), "kind", "source_id", "score", "stable_id"]
        if "ce_score" in hits.columns:
            columns.append("ce_score")
        if explain:
            columns += ["fused_score", *(c for c in hits.columns if c.endswith("_rank"))]
        return named.select(*columns)

    def search_text_only(self, query: str, *, limit: int = 10, view: ReadView = ReadView()) -> SearchResult:
        """The text arm alone; a longer list begins with the shorter one."""
        checked_limit(limit)
        self.counts.update(queries=1)
        lexical = self._text_arm(query, view, None, self.store.manifest(), self.clock())
        fused = fusion.rrf([fusion.Arm("text", lexical.select("qid", "key", "id", "rank"))])
        known = lexical.select("id", "kind", "source_id", "logical_id", "importance", "confidence").dropDuplicates(["id"])
        hits = fused.join(known, "id").withColumn("fused_score", F.col("score"))
        return SearchResult(self._identified(hits, False).where(F.col("rank") <= limit), arms={"text": lexical})

    def search_projected_text(self, projection: str, query: str, filter: SearchFilter | None = None, *, limit: int = 10) -> DataFrame:
        """Rows by BM25 over one searchable attribute; filters come before the limit."""
        checked_limit(limit)
        manifest = self.store.manifest()
        spec = self.specs(manifest).get(projection)
        if spec is None or "searchable" not in spec.roles:
            raise InvalidFilterError(f"{projection} is not a searchable projection")
        nodes = self._filtered(records.visible(self.nodes(manifest), self.clock()), filter, manifest)
        values = self.store.table("attributes", manifest).where(F.col("attr_name") == projection).join(nodes.select("write_cursor"), "write_cursor", "left_semi")
        docs = values.select(F.col("write_cursor").alias("id"), index_tokens_udf(F.col("attr_value")).alias("terms"))
        return text.top(text.bm25(docs, self._query_terms(query)), limit).select("id", "score", "rank")

    def bm25f_search(self, query: str, weights: dict[str, float], b: float = 0.75, *, limit: int = 10) -> DataFrame:
        """Rows by fielded BM25 over kind, body and status."""
        checked_limit(limit)
        manifest = self.store.manifest()
        mine = records.visible(self.nodes(manifest), self.clock()).select("write_cursor")
        fields, asked = {n: float(weights.get(n, 0.0)) for n in ("kind", "body", "status")}, self._query_terms(query)
        lengths = self.store.table("lengths", manifest).where(F.col("field").isin(list(fields))).join(mine, "write_cursor", "left_semi")
        means = {r.field: (r.n, r.mean) for r in lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).collect()}  # three
        rows = self.store.table("postings", manifest).where(F.col("field").isin(list(fields)) & F.col("term").isin(asked.first()["terms"]))
        part = F.lit(0.0)
        for n, w in fields.items():
            each = F.col("tf") * w / (1 - b + b * F.col("dl") / F.lit(float(means.get(n, (0, 1.0))[1] or 1.0)))
            part = F.when(F.col("field") == n, each).otherwise(part)
        tf = rows.join(mine, "write_cursor", "left_semi").groupBy(F.col("write_cursor").alias("id"), "term").agg(F.sum(part).alias("tf"))
        return text.top(text.fielded(tf, asked, max((n for n, _ in means.values()), default=0)), limit).select("id", "score", "rank")

    def rerank(self, query: str, passages: DataFrame, reranker, depth: int, alpha: float = 0.3, pool_n: int | None = None) -> DataFrame:
        """Blend a reranker's logits into ranked passages (qid, key, id, score, rank)."""
        return fusion.rerank_blend(reranker(query, passages), "logit", depth, alpha, pool_n)

    # -- telemetry --------------------------------------------------------------------------

    def enable_telemetry(self) -> None:
        """Events and feedback go to the table telemetry, under the next session's number; neither query texts nor sources do."""
        last = self.store.table("telemetry").agg(F.max("session")).first()[0]
        self._session, self._events, self._telemetry = 0 if last is None else last + 1, 0, []

    def disable_telemetry(self) -> list[dict]:
        """Write what is left and return the session's events."""
        self._flush()
        rows = self.store.table("telemetry").where(F.col("session") == self._session).orderBy("seq").collect()  # of one session
        self._telemetry = None
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]

    def _flush(self) -> None:
        if self._telemetry:
            manifest, schema = self.store.manifest(), S.struct(TABLES["telemetry"])
            rows = [{f.name: e.get(f.name) for f in schema} for e in self._telemetry]
            self.store.add(manifest, "telemetry", self.spark.createDataFrame(rows, schema))
            self.store.publish(manifest)
            self._telemetry = []

    def _record(self, event: dict) -> None:
        self._telemetry.append(event | {"session": self._session, "seq": self._events})
        self._events += 1
        if len(self._telemetry) >= TELEMETRY_BUFFER:
            self._flush()

    def _capture(self, query: str, result: SearchResult) -> None:
        rows = result.rows()
        self._record({
            "type": "event", "query_id": f"q{self._session}-{self._events}", "query_chars": len(query),
            "result_ids": [r.id for r in rows], "result_stable_ids": [f"{r.stable_id.space}:{r.stable_id.value}" for r in rows],
        })

    def record_feedback(self, query_id: str, labels: dict[int, int], label_source: str) -> None:
        if self._telemetry is None:
            raise LoreError("telemetry is off")
        self._record({"type": "feedback", "query_id": query_id, "label_source": label_source, "labels": labels})

    # -- providers --------------------------------------------------------------------------

    def ingest_with_extractor(self, documents: DataFrame, provider) -> dict:
        """Facts a provider finds in documents(source_doc_id, body), checked, then written as edges and entity nodes."""
        kinds = ("source_doc_id string, from_kind string, from_name string, to_kind string, to_name string, kind string, body string, "
                 "t_valid string, t_invalid string, confidence double, model string")  # fmt: skip
        facts = written(providers.run_extractor(documents, provider, kinds), "facts")
        edges, rejected = providers.extracted_edges(facts)
        bad = rejected.count()
        if bad:
            raise WriteValidationError(f"{bad} facts break the contract")
        ends = [facts.select("source_doc_id", F.col(f"{e}_kind").alias("kind"), F.col(f"{e}_name").alias("name")) for e in ("from", "to")]
        entities = ends[0].unionAll(ends[1]).withColumn("logical_id", providers.entity_id(F.col("kind"), F.col("name")))
        entities = entities.groupBy("logical_id").agg(F.min(F.struct("source_doc_id", "kind", "name")).alias("x"))
        manifest = self.store.manifest()
        new = entities.join(self.store.table("nodes", manifest).select("logical_id").distinct(), "logical_id", "left_anti")
        nodes = self._append(manifest, "nodes", new.select("logical_id", "x.kind", F.col("x.source_doc_id").alias("source_id"), F.to_json(F.struct(F.col("x.name").alias("name"))).alias("body")))
        added = self._append(manifest, "edges", edges)
        self.store.publish(manifest)  # entities and facts at once
        self.counts.update(writes=1, write_rows=nodes + added)
        return {"nodes": nodes, "edges": added}

    def consolidate_with_provider(self, verdicts: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Judge the clusters of current edges by (from, kind); by default the most recent wins."""
        manifest = self.store.manifest()
        edges = self.edges(manifest)
        live = edges.where("superseded_at IS NULL")
        if verdicts is None:
            found = records.recency_verdicts(live).select("write_cursor", "verdict", F.col("t_invalid").alias("at"))
        else:
            found = verdicts(live)
        self.store.replace(manifest, "edges", providers.apply_verdicts(edges, found))
        self.store.publish(manifest)
        self.store.vacuum()


class _Read:
    def __init__(self, engine: Engine):
        self.e = engine

    def _now(self) -> int:
        return self.e.clock()

    def get(self, logical_id: str, view: ReadView = ReadView()):
        if not logical_id:
            raise ValueError("a logical id is not empty")
        rows = records.visible(self.e.nodes(ids=[logical_id]), self._now(), view)
        return rows.orderBy(F.col("write_cursor").desc()).limit(1).first()

    def get_many(self, ids: list[str], view: ReadView = ReadView()) -> list:
        rows = records.get_many(self.e.nodes(ids=[i for i in set(ids) if i is not None]), ids, self._now(), view).orderBy("pos").collect()  # one row per asked id
        return [r if r.write_cursor is not None else None for r in rows]

    def list(self, kind: str, predicates: list | None = None, filter: Filter | None = None, limit: int = 100, view: ReadView = ReadView()) -> DataFrame:
        if predicates is not None and filter is not None:
            raise InvalidFilterError("predicates or a filter, not both")
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
            raise ValueError("limit must be a whole number from 0")
        rows = records.visible(self.e.nodes(), self._now(), view).where(F.col("kind") == kind)
        for p in predicates or []:
            rows = rows.where(p.column())
        if filter is not None:
            rows = rows.where(filter.for_list(kind))
        return rows.orderBy("write_cursor").limit(limit)

    def collection(self, name: str, after_id: int = 0, limit: int = 100) -> DataFrame:
        return records.log_page(self.e.store.table("mutations"), name, after_id, limit)

    mutations = collection

    def latest_state(self) -> DataFrame:
        return records.latest_state(self.e.store.table("mutations"))

    def crossed_boundary_since(self, since: int, view: ReadView = ReadView()) -> DataFrame:
        return records.boundary_crossings(self.e.nodes(), since, self._now(), view)

    def projections(self) -> list[ProjectionSpec]:
        return sorted(self.e.specs().values(), key=lambda s: s.name)

    def unsupported_kinds(self) -> list[str]:
        rows = self.e.nodes().where(ReadView().existence() & predicates.source_type().isNull())
        return sorted(r.kind for r in rows.select("kind").distinct().collect())  # kinds are few

    def projection_status(self) -> dict:
        e = self.e
        waiting = e.waiting(e.store.manifest()).count()
        dense = "unavailable" if e.embedder is None else "ready" if waiting == 0 else "embedding"
        status = {s.name: (dense if s.vector else "ready") for s in self.projections()}
        return {"embedder_available": e.embedder is not None, "dense": dense, "waiting": waiting, "projections": status, "unsupported_kinds": self.unsupported_kinds()}


class _Graph:
    def __init__(self, engine: Engine):
        self.e = engine

    def neighbors(self, logical_id: str, depth: int = 1, direction: str = "outgoing", view: ReadView = ReadView()) -> DataFrame:
        """(id, hop): what a record reaches over live edges and visible nodes, at most 50, nearest first."""
        e, now = self.e, self.e.clock()
        allowed = records.visible(e.nodes(), now, view).where("logical_id IS NOT NULL").select(F.col("logical_id").alias("id"))
        roots = e.spark.createDataFrame([(logical_id,)], "root string")
        return graph.neighbours(graph.live_edges(e.edges(), now), roots, depth, direction, allowed).select("id", "hop")

    def search_expand(
        self, query: str, depth: int = 1, limit: int = 10, filter: Filter | SearchFilter | None = None, view: ReadView = ReadView()
    ) -> DataFrame:
        """(id, rank, hop): a search's hits and what they reach both ways over nodes the view shows; a hit wins over a reached node."""
        e, now = self.e, self.e.clock()
        allowed = records.visible(e.nodes(), now, view).where("logical_id IS NOT NULL").select(F.col("logical_id").alias("id"))
        hits = e.search(query, filter, limit=limit, view=view).hits.where("stable_id.space = 'logical'").select(
            F.lit(0).alias("qid"), F.col("stable_id.value").alias("id"), "rank"
        )
        return graph.search_expand(hits, graph.live_edges(e.edges(), now), depth, limit, allowed).select("id", "rank", "hop")


class _Admin:
    def __init__(self, engine: Engine):
        self.e = engine

    @staticmethod
    def collection_row(name, kind, schema_json, retention_json, now: int) -> dict:
        if not name or kind not in ("append_only_log", "latest_state"):
            raise CollectionError("a collection has a name and is an append_only_log or a latest_state")
        try:
            payload.check_schema(json.loads(schema_json))
            json.loads(retention_json)
        except ValueError as e:
            raise CollectionError(str(e)) from e
        return {"name": name, "kind": kind, "schema_json": schema_json, "retention_json": retention_json, "format_version": 1, "created_at": now}

    def configure(self, name: str, kind: str, schema_json: str = "{}", retention_json: str = "{}") -> None:
        self.e.write([{"type": "admin_schema", "name": name, "kind": kind, "schema_json": schema_json, "retention_json": retention_json}])
        self.e.counts.update(admin_ops=1)

    def check_integrity(self) -> DataFrame:
        return records.integrity(self.e.nodes(), self.e.edges())

    def dump_row_counts(self) -> DataFrame:
        parts = [self.e.store.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in TABLES]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def dump_schema(self) -> dict[str, str]:
        return dict(TABLES)

    def dump_mutations(self, collection: str, after_id: int = 0, limit: int = 100) -> dict:
        rows = records.log_page(self.e.store.table("mutations"), collection, after_id, limit).collect()  # one page
        return {"rows": rows, "next_after_id": rows[-1].id if rows and len(rows) == limit else None}

    def census(self) -> DataFrame:
        return records.provenance_census(self.e.store.table("nodes"), self.e.store.table("edges"))

    def trace(self, source_id: str) -> DataFrame:
        rows = records.trace_source(self.e.store.table("nodes"), self.e.store.table("edges"))
        return rows.where(F.col("source_id") == source_id).orderBy("write_cursor")

    def excise_source(self, source_id: str) -> None:
        self.e.erase_source(source_id, operator=True)

    def excise_record(self, collection: str, record_key: str) -> None:
        """Remove every version of a log record; the audit keeps a digest of its name only."""
        manifest = self.e.store.manifest()
        mine = (F.col("collection_name") == collection) & (F.col("record_key") == record_key)
        self.e.store.replace(manifest, "mutations", self.e.store.table("mutations", manifest).where(~mine))
        self.e._audit(manifest, "excise_record", collection + record_key)
        self.e.store.publish(manifest)
        self.e.store.vacuum()

    def rebuild_projections(self) -> None:
        manifest = self.e.store.manifest()
        self.e._project(manifest)
        for name in ("vectors", "postings", "lengths", "projection_failures"):
            manifest["tables"][name] = []
        manifest["meta"].pop("mean", None)
        manifest["meta"]["vectors"] = 0
        for name in ("nodes", "edges"):
            part = self.e.store.table(name, manifest)
            specs, manifest["meta"]["projections"] = manifest["meta"].get("projections", {}), {}  # attributes are built above
            self.e._project_new(manifest, name, part)
            manifest["meta"]["projections"] = specs
        self.e.store.publish(manifest)
        self.e.drain()

    def recompute_mean(self) -> list[float]:
        manifest = self.e.store.manifest()
        mean = vector.mean_list(self.e._vectors(manifest))
        manifest["meta"]["mean"] = mean
        self.e.store.publish(manifest)
        return mean

    def verify_embedder(self, probes: list[str], reference: list[list[float]]) -> dict:
        """Sign flips after centring, and the largest distance before it, between live and reference vectors."""
        live, ref = np.array([self.e.embed(p) for p in probes]), np.array(reference)
        if live.shape != ref.shape:
            raise DenseUnavailableError("the dimensions differ")
        mean = np.array(self.e.store.manifest()["meta"].get("mean") or np.zeros(live.shape[1]))
        flips = int((((live - mean) > 0) != ((ref - mean) > 0)).sum())
        return {"flips": flips, "max_l2": float(np.linalg.norm(live - ref, axis=1).max()), "equivalent": flips == 0 and bool(np.allclose(live, ref, atol=1e-5))}

    def safe_export(self, path: str) -> dict:
        """Every table as parquet, with a manifest of rows and a content digest each."""
        out = {}
        for name in TABLES:
            df = self.e.store.table(name)
            df.write.parquet(f"{path}/{name}")
            digest = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.bit_xor("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
            out[name] = {"rows": digest["n"], "digest": digest["h"]}
        return out
