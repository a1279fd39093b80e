"""Queries on records: reads, predicates, logs, lifecycle, projections, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import predicates as P
from lorespark.operators import records as R
from lorespark.plans.canonical import EDGE_NOW, EDGES_SQL, NOW, OPLOG_SQL, edges, nodes, oplog, read, vectors

_VISIBLE = f"""superseded_at IS NULL AND state = 'active' AND (valid_from IS NULL OR valid_from <= {NOW})
  AND (valid_until IS NULL OR valid_until > {NOW})"""
_INSTANTS = [1_769_935_176, 1_771_000_000, 1_772_000_000, NOW, 1_776_000_000, 1_790_000_000]
#: The declared attributes, in the order of the fixed table projection_registry.
_NAMES = [
    "status", "priority", "owner", "due_on", "effort_hours", "is_blocked", "reviewed", "opened_on", "score", "retries", "locale", "budget", "headcount",
    "confidential", "sunset_on",
]
_CURRENT = "superseded_at IS NULL AND state = 'active'"

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("read_active_default", f"SELECT write_cursor, kind, logical_id, state FROM canonical_nodes WHERE {_VISIBLE}")
def _(spark, sf):
    return R.visible(nodes(spark, sf), NOW).select("write_cursor", "kind", "logical_id", "state")


@query("read_view_matrix", f"""
SELECT CAST(instant AS BIGINT) AS instant,
  count(*) FILTER (superseded_at IS NULL AND state = 'active' AND valid) AS default_view,
  count(*) FILTER (state = 'active' AND valid) AS with_superseded,
  count(*) FILTER (superseded_at IS NULL AND valid) AS with_inactive,
  count(*) FILTER (superseded_at IS NULL AND state = 'active') AS with_out_of_window, count(*) AS all_rows
FROM (SELECT instant, superseded_at, state, (valid_from IS NULL OR valid_from <= instant) AND (valid_until IS NULL OR valid_until > instant) AS valid
      FROM canonical_nodes, (VALUES {', '.join(f'({t})' for t in _INSTANTS)}) t(instant)) GROUP BY instant""")
def _(spark, sf):
    return R.view_counts(nodes(spark, sf), _INSTANTS)


_ASKED = ["9c23890b8772ec9f", "no such id", "f84c122392e29429", "9c23890b8772ec9f", "b3d60db5535c4752"]


@query("read_get_many", f"""
WITH asked(pos, logical_id) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(_ASKED))}),
n AS (SELECT logical_id, max(write_cursor) AS write_cursor, arg_max(kind, write_cursor) AS kind, arg_max(body, write_cursor) AS body,
             arg_max(state, write_cursor) AS state FROM canonical_nodes WHERE {_VISIBLE} GROUP BY logical_id)
SELECT pos, logical_id, write_cursor, kind, body, state FROM asked LEFT JOIN n USING (logical_id)""")
def _(spark, sf):
    return R.get_many(nodes(spark, sf), _ASKED, NOW)


@query("read_get_versions", f"""
SELECT logical_id, count(DISTINCT write_cursor) AS versions, max(write_cursor) AS latest, count(DISTINCT superseded_at) AS ended
FROM canonical_nodes WHERE logical_id IS NOT NULL GROUP BY logical_id""")
def _(spark, sf):
    return nodes(spark, sf).where("logical_id IS NOT NULL").groupBy("logical_id").agg(
        F.countDistinct("write_cursor").alias("versions"), F.max("write_cursor").alias("latest"), F.countDistinct("superseded_at").alias("ended")
    )


_JSON = "CASE WHEN json_valid(body) THEN json_type(body, '{0}') END"


@query("read_list_json_eq", f"""SELECT write_cursor, kind FROM canonical_nodes WHERE {_VISIBLE} AND json_valid(body)
  AND CASE WHEN json_valid(body) THEN json_type(body, '$.status') = 'VARCHAR' AND json_extract_string(body, '$.status') = 'blocked' END""")
def _(spark, sf):
    return R.visible(nodes(spark, sf), NOW).where(P.Predicate("$.status", "eq", "blocked").column()).select("write_cursor", "kind")


@query("read_list_json_range", f"""SELECT write_cursor FROM canonical_nodes WHERE {_VISIBLE}
  AND CASE WHEN json_valid(body) THEN json_type(body, '$.status') = 'VARCHAR' AND json_extract_string(body, '$.status') > 'closed' END""")
def _(spark, sf):
    return R.visible(nodes(spark, sf), NOW).where(P.Predicate("$.status", "gt", "closed").column()).select("write_cursor")


@query("read_list_type_strict", """SELECT event_id, k = 7 AS eq7, k >= 50 AS from50, false AS as_text FROM
  (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def _(spark, sf):
    return read(spark, sf, "events").select(
        "event_id",
        P.json_compare("props", "$.k", "eq", 7).alias("eq7"),
        P.json_compare("props", "$.k", "gte", 50).alias("from50"),
        P.json_compare("props", "$.k", "eq", "7").alias("as_text"),
    )


@query("read_list_const_fold", f"SELECT write_cursor FROM canonical_nodes WHERE {_CURRENT} AND kind = 'note'")
def _(spark, sf):
    f = P.Filter((P.Term("Kind", "note"), P.Term("SourceType", "note")))
    return nodes(spark, sf).where(P.ReadView().existence() & (F.col("kind") == "note") & f.for_list("note")).select("write_cursor")


@query("read_list_page", f"""SELECT write_cursor, kind FROM (SELECT DISTINCT write_cursor, kind FROM canonical_nodes WHERE {_VISIBLE} AND kind = 'task')
  ORDER BY write_cursor LIMIT 100""")
def _(spark, sf):
    rows = R.visible(nodes(spark, sf), NOW).where("kind = 'task'").select("write_cursor", "kind").distinct()
    return rows.orderBy("write_cursor").limit(P.checked_limit(100))


@query("source_type_rollup", """
SELECT CASE kind WHEN 'doc' THEN 'article' WHEN 'email' THEN kind WHEN 'article' THEN kind WHEN 'paper' THEN kind WHEN 'meeting' THEN kind
  WHEN 'note' THEN kind WHEN 'todo' THEN kind WHEN 'edge_fact' THEN kind END AS source_type, state, count(*) AS rows
FROM canonical_nodes GROUP BY GROUPING SETS ((source_type, state), (source_type), ())""")
def _(spark, sf):
    df = nodes(spark, sf).select(P.source_type().alias("source_type"), "state")
    return df.rollup("source_type", "state").agg(F.count(F.lit(1)).alias("rows"))


@query("row_kind_counts", "SELECT row_kind, kind, count(*) AS rows FROM canonical_nodes GROUP BY ALL")
def _(spark, sf):
    return nodes(spark, sf).groupBy("row_kind", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query("oplog_page", f"WITH {OPLOG_SQL} SELECT * FROM oplog WHERE collection_name = 'click' AND id > 500 ORDER BY id LIMIT 200")
def _(spark, sf):
    return R.log_page(oplog(spark, sf), "click", 500, 200)


@query("oplog_latest_state", f"""WITH {OPLOG_SQL} SELECT collection_name, record_key, max(id) AS id, arg_max(payload_json, id) AS payload_json
  FROM oplog GROUP BY ALL""")
def _(spark, sf):
    return R.latest_state(oplog(spark, sf))


@query("boundary_crossings", f"""SELECT * FROM (SELECT write_cursor, logical_id,
    CASE WHEN valid_from > 1771000000 AND valid_from <= {NOW} THEN valid_from END AS opened_at,
    CASE WHEN valid_until > 1771000000 AND valid_until <= {NOW} THEN valid_until END AS closed_at
  FROM canonical_nodes WHERE {_CURRENT}) WHERE opened_at IS NOT NULL OR closed_at IS NOT NULL""")
def _(spark, sf):
    return R.boundary_crossings(nodes(spark, sf), 1_771_000_000, NOW)


@query("supersede_on_rewrite", """WITH d AS (SELECT DISTINCT write_cursor, logical_id FROM canonical_nodes)
SELECT write_cursor, logical_id, CASE WHEN logical_id IS NOT NULL THEN lead(write_cursor) OVER (PARTITION BY logical_id ORDER BY write_cursor) END AS superseded_at FROM d""")
def _(spark, sf):
    return R.supersede(nodes(spark, sf).select("write_cursor", "logical_id").distinct(), ["logical_id"])


@query("invalidate_not_accumulate", f"WITH {EDGES_SQL} SELECT from_id, kind, to_id, write_cursor, t_valid FROM edges WHERE superseded_at IS NULL")
def _(spark, sf):
    return edges(spark, sf).where("superseded_at IS NULL").select("from_id", "kind", "to_id", "write_cursor", "t_valid")


@query("recency_consolidation", f"""WITH {EDGES_SQL}, w AS (SELECT *,
  first_value(write_cursor) OVER c AS wc, first_value(t_valid) OVER c AS wt FROM edges WHERE superseded_at IS NULL
  WINDOW c AS (PARTITION BY from_id, kind ORDER BY t_valid DESC NULLS LAST, write_cursor))
SELECT write_cursor, from_id, kind, CASE WHEN wc = write_cursor THEN 'keep' ELSE 'invalidate' END AS verdict,
  CASE WHEN wc = write_cursor THEN t_invalid ELSE coalesce(wt, 0) END AS t_invalid FROM w""")
def _(spark, sf):
    return R.recency_verdicts(edges(spark, sf).where("superseded_at IS NULL"))


@query("transition_legality", """SELECT write_cursor, state, target, (state, target) IN
  (('pending', 'active'), ('pending', 'deleted'), ('active', 'deleted'), ('deleted', 'active')) AS legal
FROM canonical_nodes, (VALUES ('pending'), ('active'), ('deleted'), ('purged')) t(target)""")
def _(spark, sf):
    return R.transition_verdicts(nodes(spark, sf), ["pending", "active", "deleted", "purged"])


_SOURCE = "(SELECT min(source_id) FROM canonical_nodes)"


_GRAPH_NODES = """gn AS (SELECT DISTINCT 'u:' || user_id AS logical_id, user_id % 3 = 0 AS gone FROM events)"""


@query("purge_with_edges", f"""WITH {EDGES_SQL}, {_GRAPH_NODES}, dead AS (SELECT logical_id FROM gn WHERE gone)
SELECT 'nodes' AS name, count(*) AS rows FROM gn WHERE NOT gone
UNION ALL SELECT 'edges', count(*) FROM edges WHERE from_id NOT IN (SELECT * FROM dead) AND to_id NOT IN (SELECT * FROM dead)
UNION ALL SELECT 'vectors', count(*) FROM gn WHERE NOT gone""")
def _(spark, sf):
    """Users as records, a third of them purged: their edges and their vectors go with them."""
    users = read(spark, sf, "events").select("user_id").distinct()
    n = users.select((F.col("user_id") + 10_000_000).alias("write_cursor"), F.concat(F.lit("u:"), "user_id").alias("logical_id"))
    tables = {"nodes": n, "edges": edges(spark, sf), "vectors": n.select("write_cursor", F.lit(1).alias("v"))}
    left = R.purge(tables, users.where("user_id % 3 = 0").select(F.concat(F.lit("u:"), "user_id").alias("logical_id")))
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _first_source(df):
    return df.agg(F.min("source_id")).first()[0]


@query("erase_source_cascade", f"""
SELECT 'nodes' AS name, count(*) AS rows FROM canonical_nodes WHERE source_id IS DISTINCT FROM {_SOURCE}
UNION ALL SELECT 'attributes', count(*) FROM canonical_attributes WHERE write_cursor NOT IN
  (SELECT write_cursor FROM canonical_nodes WHERE source_id = {_SOURCE})""")
def _(spark, sf):
    tables = {"nodes": nodes(spark, sf), "attributes": read(spark, sf, "canonical_attributes")}
    left = R.erase_source(tables, _first_source(tables["nodes"]))
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, df in left.items()]
    return parts[0].unionAll(parts[1])


@query("purge_cascade", f"""WITH {EDGES_SQL}, ids AS (SELECT DISTINCT logical_id FROM canonical_nodes WHERE state = 'deleted' AND logical_id IS NOT NULL)
SELECT 'nodes' AS name, count(*) AS rows FROM canonical_nodes WHERE logical_id IS NULL OR logical_id NOT IN (SELECT * FROM ids)
UNION ALL SELECT 'attributes', count(*) FROM canonical_attributes WHERE write_cursor NOT IN
  (SELECT write_cursor FROM canonical_nodes WHERE logical_id IN (SELECT * FROM ids))
UNION ALL SELECT 'edges', count(*) FROM edges""")
def _(spark, sf):
    tables = {"nodes": nodes(spark, sf), "attributes": read(spark, sf, "canonical_attributes"), "edges": edges(spark, sf)}
    left = R.purge(tables, tables["nodes"].where("state = 'deleted'"))
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("provenance_census", f"""WITH {EDGES_SQL}, b AS (SELECT source_id, logical_id FROM canonical_nodes UNION ALL SELECT source_id, logical_id FROM edges)
SELECT source_id, count(*) AS rows, count(logical_id) AS governed_rows, coalesce(starts_with(source_id, '_'), false) AS reserved,
  count(*) FILTER (source_id IS NULL AND logical_id IS NULL) AS unerasable_rows FROM b GROUP BY source_id""")
def _(spark, sf):
    return R.provenance_census(nodes(spark, sf), edges(spark, sf))


@query("trace_source", f"""WITH {EDGES_SQL} SELECT source_id, write_cursor, 'node' AS "table" FROM canonical_nodes WHERE source_id IS NOT NULL
UNION SELECT source_id, write_cursor, 'edge' FROM edges WHERE source_id IS NOT NULL""")
def _(spark, sf):
    return R.trace_source(nodes(spark, sf), edges(spark, sf))


@query("legacy_backfill", "SELECT write_cursor, CASE WHEN source_id IS NULL AND logical_id IS NULL THEN '_legacy' ELSE source_id END AS source_id FROM canonical_nodes")
def _(spark, sf):
    both = F.col("source_id").isNull() & F.col("logical_id").isNull()
    return nodes(spark, sf).select("write_cursor", F.when(both, "_legacy").otherwise(F.col("source_id")).alias("source_id"))


@query("retention_sweep", f"""WITH {OPLOG_SQL} SELECT id, collection_name FROM (SELECT *, row_number() OVER (PARTITION BY collection_name ORDER BY id DESC) AS r FROM oplog)
  WHERE r <= 1000 OR starts_with(collection_name, 'audit')""")
def _(spark, sf):
    return R.retention_sweep(oplog(spark, sf), "collection_name", "id", 1000).select("id", "collection_name")


@query("dangling_endpoints", f"""WITH {EDGES_SQL}, e AS (SELECT write_cursor, 'from' AS "end", from_id AS id FROM edges UNION ALL SELECT write_cursor, 'to', to_id FROM edges)
SELECT * FROM e WHERE id NOT IN (SELECT logical_id FROM canonical_nodes WHERE {_CURRENT} AND logical_id IS NOT NULL)""")
def _(spark, sf):
    return R.dangling_endpoints(edges(spark, sf), nodes(spark, sf))


@query("attribute_extraction", f"""SELECT DISTINCT write_cursor, attr_name, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.' || attr_name) END AS attr_value
FROM canonical_nodes, (VALUES {', '.join(f"('{n}')" for n in _NAMES)}) t(attr_name)
WHERE {_CURRENT} AND CASE WHEN json_valid(body) THEN json_type(body, '$.' || attr_name) NOT IN ('OBJECT', 'ARRAY', 'NULL') END""")
def _(spark, sf):
    return R.attribute_values(nodes(spark, sf), _NAMES)


@query("attribute_filter", f"""SELECT write_cursor, kind FROM canonical_nodes n WHERE {_VISIBLE}
  AND EXISTS (SELECT 1 FROM canonical_attributes a WHERE a.write_cursor = n.write_cursor AND attr_name = 'status' AND attr_value = 'open')
  AND EXISTS (SELECT 1 FROM canonical_attributes a WHERE a.write_cursor = n.write_cursor AND attr_name = 'priority' AND attr_value = '2')""")
def _(spark, sf):
    hits = R.visible(nodes(spark, sf), NOW)
    attributes = read(spark, sf, "canonical_attributes")
    return P.with_attributes(hits, attributes, (("status", "open"), ("priority", "2")), {"status", "priority"}).select("write_cursor", "kind")


@query("dense_readiness", f"""SELECT kind, count(*) AS rows, count(*) FILTER (write_cursor NOT IN (SELECT vec_id FROM embeddings)) AS waiting
FROM canonical_nodes WHERE {_CURRENT} AND kind IN ('email', 'article', 'paper', 'meeting', 'note', 'todo', 'doc') GROUP BY kind""")
def _(spark, sf):
    rows = nodes(spark, sf).where(P.ReadView().existence() & P.source_type().isNotNull()).select("write_cursor", "kind")
    done = vectors(spark, sf).select("write_cursor", F.lit(1).alias("done")).distinct()
    return rows.join(done, "write_cursor", "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("done").isNull()).alias("waiting")
    )


@query("projection_cursor", f"""WITH e AS (SELECT write_cursor FROM canonical_nodes WHERE {_CURRENT}),
m AS (SELECT min(write_cursor) AS first FROM e WHERE write_cursor NOT IN (SELECT write_cursor FROM canonical_attributes))
SELECT CAST(coalesce(first - 1, (SELECT max(write_cursor) FROM e), 0) AS BIGINT) AS projection_cursor FROM m""")
def _(spark, sf):
    return R.projection_cursor(nodes(spark, sf).where(P.ReadView().existence()), read(spark, sf, "canonical_attributes"))


@query("projection_roles", """SELECT name, json_contains(roles, '"filterable"') AS filterable, json_contains(roles, '"rankable"') AS rankable,
  json_contains(roles, '"searchable"') AS searchable FROM projection_registry""")
def _(spark, sf):
    roles = F.from_json("roles", "array<string>")
    return read(spark, sf, "projection_registry").select("name", *(F.array_contains(roles, r).alias(r) for r in ("filterable", "rankable", "searchable")))


@query("integrity_checks", f"""WITH {EDGES_SQL} SELECT 'doubled_logical_id' AS "check", count(*) AS findings FROM
  (SELECT logical_id FROM canonical_nodes WHERE {_CURRENT} AND logical_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT write_cursor) > 1)
UNION ALL SELECT 'dangling_endpoint', count(*) FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges)
  WHERE id NOT IN (SELECT logical_id FROM canonical_nodes WHERE {_CURRENT} AND logical_id IS NOT NULL)
UNION ALL SELECT 'empty_window', count(*) FROM canonical_nodes WHERE valid_from >= valid_until
UNION ALL SELECT 'unknown_state', count(*) FROM canonical_nodes WHERE state NOT IN ('pending', 'active', 'deleted', 'purged')
UNION ALL SELECT 'no_source', count(*) FROM canonical_nodes WHERE source_id IS NULL""")
def _(spark, sf):
    return R.integrity(nodes(spark, sf), edges(spark, sf))


@query("row_counts", """SELECT 'canonical_nodes' AS name, count(*) AS rows FROM canonical_nodes UNION ALL SELECT 'canonical_attributes', count(*) FROM canonical_attributes
UNION ALL SELECT 'projection_registry', count(*) FROM projection_registry UNION ALL SELECT 'embeddings', count(*) FROM embeddings""")
def _(spark, sf):
    parts = [
        read(spark, sf, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
        for n in ("canonical_nodes", "canonical_attributes", "projection_registry", "embeddings")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("edge_expiry_filter", f"WITH {EDGES_SQL} SELECT write_cursor FROM edges WHERE superseded_at IS NULL AND (t_invalid IS NULL OR t_invalid > {EDGE_NOW})")
def _(spark, sf):
    e = edges(spark, sf)
    return e.where(F.col("superseded_at").isNull() & (F.col("t_invalid").isNull() | (F.col("t_invalid") > EDGE_NOW))).select("write_cursor")


@query("telemetry_join", """WITH e AS (SELECT 'q' || event_id AS query_id, event_type FROM events WHERE event_id % 2 = 0),
f AS (SELECT 'q' || (event_id - 1) AS query_id, value FROM events WHERE event_id % 2 = 1)
SELECT event_type, count(*) AS asked, count(f.query_id) AS answered, round(avg(f.value), 6) AS mean_value FROM e LEFT JOIN f USING (query_id) GROUP BY event_type""")
def _(spark, sf):
    df = read(spark, sf, "events")
    asked = df.where("event_id % 2 = 0").select(F.concat(F.lit("q"), "event_id").alias("query_id"), "event_type")
    fed = df.where("event_id % 2 = 1").select(F.concat(F.lit("q"), F.col("event_id") - 1).alias("query_id"), "value", F.lit(1).alias("f"))
    return asked.join(fed, "query_id", "left").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("asked"), F.count("f").alias("answered"), F.round(F.avg("value"), 6).alias("mean_value")
    )


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
