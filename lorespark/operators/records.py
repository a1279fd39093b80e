"""Versioned records, logs, lifecycle and erasure as set operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators.predicates import ReadView, valid_at
from lorespark.operators.skew import HOT_ROWS, heavy_groups, positions, split_heavy

#: The legal lifecycle steps.
TRANSITIONS = [("pending", "active"), ("pending", "deleted"), ("active", "deleted"), ("deleted", "active")]
#: Source ids that begin so belong to the engine.
RESERVED = "_"


def visible(nodes: DataFrame, now: int, view: ReadView = ReadView()) -> DataFrame:
    return nodes.where(view.column(now))


def view_counts(nodes: DataFrame, instants: list[int]) -> DataFrame:
    """(instant, rows under each relaxation of the view), in one pass."""
    shown = F.col("superseded_at").isNull()
    active = F.col("state") == "active"
    cases = [F.struct(F.lit(t).cast("bigint").alias("instant"), valid_at(t).alias("valid")) for t in instants]
    return (
        nodes.select(shown.alias("shown"), active.alias("active"), F.explode(F.array(*cases)).alias("c"))
        .groupBy("c.instant")
        .agg(
            F.count_if(F.expr("shown AND active AND c.valid")).alias("default_view"),
            F.count_if(F.expr("active AND c.valid")).alias("with_superseded"),
            F.count_if(F.expr("shown AND c.valid")).alias("with_inactive"),
            F.count_if(F.expr("shown AND active")).alias("with_out_of_window"),
            F.count(F.lit(1)).alias("all_rows"),
        )
    )


def get_many(nodes: DataFrame, ids: list[str | None], now: int, view: ReadView = ReadView()) -> DataFrame:
    """One row per asked id, in order of asking (pos), NULL where there is none; of several versions the latest."""
    asked = nodes.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, asked string")
    mine = visible(nodes, now, view).join(F.broadcast(asked.select(F.col("asked").alias("logical_id")).distinct()), "logical_id", "left_semi")
    latest = mine.groupBy("logical_id").agg(
        F.max_by(F.struct("write_cursor", "kind", "body", "state"), "write_cursor").alias("n")
    )
    return asked.join(latest, asked["asked"] == latest["logical_id"], "left").select(
        "pos", F.col("asked").alias("logical_id"), "n.write_cursor", "n.kind", "n.body", "n.state"
    )


def boundary_crossings(nodes: DataFrame, since: int, as_of: int, view: ReadView = ReadView()) -> DataFrame:
    """Rows whose validity begins or ends in (since, as_of]; both ends are reported. Of the view only the existence axes count."""
    def crossed(c: str):
        return F.when((F.col(c) > since) & (F.col(c) <= as_of), F.col(c))

    return (
        nodes.where(view.existence())
        .select("write_cursor", "logical_id", crossed("valid_from").alias("opened_at"), crossed("valid_until").alias("closed_at"))
        .where(F.coalesce("opened_at", "closed_at").isNotNull())
    )


def supersede(
    df: DataFrame, keys: list[str], order: str = "write_cursor", out: str = "superseded_at", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Each row's successor under the same keys: an older version ends at the cursor of the next. Rows with a
    NULL key never end another, nor do they end.

    Keys of ``hot_rows`` rows and more are range-sorted over many tasks; a row meets its successor by position.
    ``hot_rows`` None: the caller knows that there are none, and no rows are counted.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    nxt = F.lead(order).over(Window.partitionBy(*keys).orderBy(order))
    if hot_rows is None:
        return df.withColumn(out, F.when(whole, nxt))
    rows = df.withColumn("__h", F.when(whole, F.xxhash64(*keys)))
    light, hot = split_heavy(rows, "__h", heavy_groups(rows, "__h", hot_rows))
    # NULL keys have no successor: they keep out of the window, where they would be one group.
    free, light = light.where(~whole).withColumn(out, F.lit(None).cast(df.schema[order].dataType)), light.where(whole)
    light = light.withColumn(out, nxt).unionByName(free).drop("__h")
    if hot is None:
        return light
    placed = positions(hot.drop("__rows"), "__h", [F.col(c) for c in (*keys, order)], "__pos")
    later = placed.select("__h", (F.col("__pos") - 1).alias("__pos"), F.struct(*keys).alias("__k"), F.col(order).alias("__next"))
    heavy = placed.join(later, ["__h", "__pos"], "left").withColumn(out, F.when(F.struct(*keys) == F.col("__k"), F.col("__next")))
    return light.unionByName(heavy.select(light.columns))


def recency_verdicts(edges: DataFrame) -> DataFrame:
    """Of the edges of a (from, kind) cluster the latest t_valid is kept (NULL is oldest, ties go to the
    earlier cursor); the others become invalid when the winner became valid, else at 0."""
    newest = F.struct(F.col("t_valid"), (-F.col("write_cursor")).alias("c"))
    won = edges.groupBy("from_id", "kind").agg(F.max(newest).alias("w"))
    keys = F.col("from_id").eqNullSafe(F.col("f")) & F.col("kind").eqNullSafe(F.col("g"))
    kept = F.col("w.c") == -F.col("write_cursor")
    return edges.join(won.withColumnsRenamed({"from_id": "f", "kind": "g"}), keys).select(
        "write_cursor",
        "from_id",
        "kind",
        F.when(kept, "keep").otherwise("invalidate").alias("verdict"),
        F.when(kept, F.col("t_invalid")).otherwise(F.coalesce("w.t_valid", F.lit(0).cast("bigint"))).alias("t_invalid"),
    )


def transition_verdicts(nodes: DataFrame, targets: list[str]) -> DataFrame:
    """For each row and target state, whether the step is legal."""
    legal = F.lit(False)
    for a, b in TRANSITIONS:
        legal = legal | ((F.col("state") == a) & (F.col("target") == b))
    return nodes.withColumn("target", F.explode(F.array(*(F.lit(t) for t in targets)))).select(
        "write_cursor", "state", "target", F.coalesce(legal, F.lit(False)).alias("legal")
    )


def erase_source(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """Every table without what a source left: its nodes and edges of every version, and the rows of the
    other tables that hang on their cursors."""
    if not source_id or source_id.startswith(RESERVED):
        raise ValueError("a source id is not empty and does not begin with _")
    gone = None
    out = {}
    for name in ("nodes", "edges"):
        if name in tables:
            mine = F.col("source_id").eqNullSafe(F.lit(source_id))
            out[name] = tables[name].where(~mine)
            if name == "nodes":
                gone = tables[name].where(mine).select("write_cursor").distinct()
    for name, df in tables.items():
        if name not in out:
            out[name] = df if gone is None else df.join(gone, "write_cursor", "left_anti")
    return out


def purge(tables: dict[str, DataFrame], logical_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the versions of the given logical ids, their projections and the edges that touch them."""
    ids = logical_ids.select("logical_id").where("logical_id IS NOT NULL").distinct()
    out = {"nodes": tables["nodes"].join(ids, "logical_id", "left_anti").select(tables["nodes"].columns)}
    gone = tables["nodes"].join(ids, "logical_id", "left_semi").select("write_cursor").distinct()
    for name, df in tables.items():
        if name == "edges":
            for end in ("from_id", "to_id"):
                df = df.join(ids.withColumnRenamed("logical_id", end), end, "left_anti").select(df.columns)
            out[name] = df
        elif name != "nodes":
            out[name] = df.join(gone, "write_cursor", "left_anti")
    return out


def provenance_census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per source: rows, rows with a lifecycle, whether the source is reserved, and rows nothing can erase."""
    both = nodes.select("source_id", "logical_id").unionAll(edges.select("source_id", "logical_id"))
    return both.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("logical_id").alias("governed_rows"),
        F.coalesce(F.any_value("source_id").startswith(RESERVED), F.lit(False)).alias("reserved"),
        F.count_if(F.col("source_id").isNull() & F.col("logical_id").isNull()).alias("unerasable_rows"),
    )


def trace_source(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, write_cursor, table) of all that each source wrote."""
    parts = [t.where("source_id IS NOT NULL").select("source_id", "write_cursor", F.lit(n).alias("table")) for n, t in (("node", nodes), ("edge", edges))]
    return parts[0].unionAll(parts[1]).distinct()


def retention_sweep(log: DataFrame, collection: str, order: str, cap: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The newest ``cap`` rows of each collection; audit collections are exempt, and so are rows of none."""
    exempt = F.col(collection).isNull() | F.col(collection).startswith("audit")
    swept = log.where(~exempt)
    light, hot = split_heavy(swept, collection, heavy_groups(swept, collection, hot_rows))
    newest = F.row_number().over(Window.partitionBy(collection).orderBy(F.col(order).desc()))
    parts = [log.where(exempt), light.withColumn("__r", newest).where(F.col("__r") <= cap).select(log.columns)]
    if hot is not None:
        placed = positions(hot.drop("__rows"), collection, [F.col(order).desc()], "__r")
        parts.append(placed.where(F.col("__r") <= cap).select(log.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(write_cursor, end, id) of edge ends that are no visible node's logical id."""
    ends = edges.select("write_cursor", F.explode(F.array(
        F.struct(F.lit("from").alias("end"), F.col("from_id").alias("id")), F.struct(F.lit("to").alias("end"), F.col("to_id").alias("id"))
    )).alias("e")).select("write_cursor", "e.end", "e.id")
    known = nodes.where(ReadView().existence()).select(F.col("logical_id").alias("id")).where("id IS NOT NULL").distinct()
    return ends.join(known, "id", "left_anti").select("write_cursor", "end", "id")


def log_page(log: DataFrame, collection: str, after_id: int, limit: int) -> DataFrame:
    """A page of one collection's log in order of id; a negative after_id starts at the beginning."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a whole number from 0")
    rows = log.where((F.col("collection_name") == collection) & (F.col("id") > max(after_id, -1)))
    return rows.orderBy("id").limit(min(limit, 1_000_000))


def latest_state(log: DataFrame) -> DataFrame:
    """One row per (collection, key): the last write."""
    return log.groupBy("collection_name", "record_key").agg(
        F.max("id").alias("id"), F.max_by("payload_json", "id").alias("payload_json")
    )


def attribute_values(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(write_cursor, attr_name, attr_value) of declared top-level attributes of current JSON bodies.

    Text stays as it is, numbers become decimal text, booleans true and false; NULL, missing and
    composite values give no row.
    """
    body = F.try_parse_json("body")
    cells = F.array(*(F.struct(F.lit(n).alias("attr_name"), F.try_variant_get(body, f"$.{n}", "variant").alias("v")) for n in names))
    kind = F.schema_of_variant("x.v")
    return (
        nodes.where(ReadView().existence())
        .select("write_cursor", F.explode(cells).alias("x"))
        .where(F.col("x.v").isNotNull() & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"))
        .select("write_cursor", "x.attr_name", F.try_variant_get("x.v", "$", "string").alias("attr_value"))
        .distinct()
    )


def projection_cursor(expected: DataFrame, done: DataFrame) -> DataFrame:
    """(projection_cursor): the highest cursor up to which nothing expected is missing."""
    missing = expected.select("write_cursor").join(done.select("write_cursor"), "write_cursor", "left_anti")
    last = expected.agg(F.max("write_cursor").alias("last"))
    first = missing.agg(F.min("write_cursor").alias("first"))
    joined = last.withColumn("j", F.lit(1)).join(first.withColumn("j", F.lit(1)), "j")  # one row each
    return joined.select(F.coalesce(F.col("first") - 1, "last", F.lit(0)).cast("bigint").alias("projection_cursor"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, findings): several current rows of one logical id, dangling ends, empty windows, bad states, sources missing."""
    current = nodes.where(ReadView().existence() & F.col("logical_id").isNotNull())
    doubled = current.groupBy("logical_id").agg(F.countDistinct("write_cursor").alias("n")).where("n > 1")
    facts = nodes.agg(
        F.count_if(F.expr("valid_from >= valid_until")).alias("empty_window"),
        F.count_if(F.expr("state NOT IN ('pending', 'active', 'deleted', 'purged')")).alias("unknown_state"),
        F.count_if(F.expr("source_id IS NULL")).alias("no_source"),
    )
    parts = [
        doubled.agg(F.lit("doubled_logical_id").alias("check"), F.count(F.lit(1)).alias("findings")),
        dangling_endpoints(edges, nodes).agg(F.lit("dangling_endpoint").alias("check"), F.count(F.lit(1)).alias("findings")),
        facts.selectExpr("stack(3, 'empty_window', empty_window, 'unknown_state', unknown_state, 'no_source', no_source) AS (check, findings)"),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
