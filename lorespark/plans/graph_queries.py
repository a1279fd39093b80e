"""Queries on the graph of facts. Roots: users whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import graph as G
from lorespark.operators import text as T
from lorespark.operators.passages import passage_ranking
from lorespark.plans.canonical import EDGE_NOW, EDGES_SQL, edges, read

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_LIVE = f"live AS (SELECT * FROM edges WHERE superseded_at IS NULL AND (t_invalid IS NULL OR t_invalid > {EDGE_NOW}))"
_ROOTS = "roots AS (SELECT DISTINCT 'u:' || user_id AS root FROM events WHERE user_id % 100 = 0)"
_STEPS = {
    "outgoing": "step AS (SELECT DISTINCT from_id AS a, to_id AS b FROM live)",
    "incoming": "step AS (SELECT DISTINCT to_id AS a, from_id AS b FROM live)",
    "both": "step AS (SELECT from_id AS a, to_id AS b FROM live UNION SELECT to_id, from_id FROM live)",
}


def _bfs_sql(depth: int, direction: str, roots: str = _ROOTS, cap: str = "WHERE p <= 50", live: str = _LIVE) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, {live}, {_STEPS[direction]}, {roots},
walk AS (SELECT root, root AS id, 0 AS hop FROM roots UNION SELECT root, b, hop + 1 FROM walk JOIN step ON a = id WHERE hop < {depth}),
best AS (SELECT root, id, min(hop) AS hop FROM walk GROUP BY root, id),
found AS (SELECT root, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY hop, id) AS p FROM best WHERE hop > 0) {cap})"""


def _roots(spark, sf):
    return read(spark, sf, "events").where("user_id % 100 = 0").select(F.concat(F.lit("u:"), "user_id").alias("root")).distinct()


def _bfs(depth, direction, cap=G.CAP):
    def run(spark, sf):
        return G.neighbours(G.live_edges(edges(spark, sf), EDGE_NOW), _roots(spark, sf), depth, direction, cap=cap)

    return run


for _name, _depth, _direction, _cap in (
    ("bfs_depth1", 1, "outgoing", 50), ("bfs_depth2_both", 2, "both", 50), ("bfs_depth3_both", 3, "both", 50), ("bfs_min_hop", 3, "both", None),
):
    Q[_name] = _bfs(_depth, _direction, _cap)
    SQL[_name] = _bfs_sql(_depth, _direction, cap="" if _cap is None else "WHERE p <= 50") + " SELECT * FROM found"

_TOPICS = "roots AS (SELECT DISTINCT 't:' || json_extract_string(props, '$.k') AS root FROM events)"


@query("bfs_incoming", _bfs_sql(2, "incoming", _TOPICS) + " SELECT * FROM found")
def _(spark, sf):
    roots = read(spark, sf, "events").select(F.concat(F.lit("t:"), F.get_json_object("props", "$.k")).alias("root")).distinct()
    return G.neighbours(G.live_edges(edges(spark, sf), EDGE_NOW), roots, 2, "incoming")


@query("search_expand", _bfs_sql(1, "both", """hits AS (SELECT kind AS qid, from_id AS root, row_number() OVER (PARTITION BY kind ORDER BY n DESC, from_id) AS rank FROM (SELECT kind, from_id, count(*) AS n FROM edges GROUP BY ALL) QUALIFY rank <= 5), roots AS (SELECT DISTINCT root FROM hits)""") + """
SELECT qid, root AS id, CAST(rank AS INTEGER) AS rank, 0 AS hop FROM hits
UNION ALL SELECT qid, f.id, CAST(min(rank) AS INTEGER), min(hop) FROM hits JOIN found f USING (root) WHERE (qid, f.id) NOT IN (SELECT (qid, root) FROM hits) GROUP BY qid, f.id""")
def _(spark, sf):
    from pyspark.sql.window import Window

    e = edges(spark, sf)
    counts = e.groupBy(F.col("kind").alias("qid"), F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hits = counts.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "id")))
    return G.search_expand(hits, G.live_edges(e, EDGE_NOW), 1, 5)


_ARM_LIVE = _LIVE[:-1] + " AND NOT temporal_fallback)"


_SEEDS = """asked AS (SELECT DISTINCT user_id AS q FROM events WHERE user_id % 100 = 0), users AS (SELECT DISTINCT user_id FROM events),
seeds AS (SELECT 'u:' || q AS qid, 'u:' || user_id AS id, user_id - q + 1 AS place FROM asked JOIN users ON user_id BETWEEN q AND q + 12),
roots AS (SELECT DISTINCT id AS root FROM seeds WHERE place <= 10)"""


@query("graph_arm", _bfs_sql(3, "both", roots=_SEEDS, live=_ARM_LIVE) + """, kinds AS (SELECT to_id AS id, CASE WHEN count(*) % 2 = 0 THEN 'unknown' ELSE 'topic' END AS kind FROM edges GROUP BY to_id),
met AS (SELECT qid, f.id, min(hop) AS hop FROM seeds s JOIN found f ON s.id = f.root WHERE place <= 10 GROUP BY ALL),
scored AS (SELECT qid, id, round(1.0 / (1 + hop) * CASE WHEN kind = 'unknown' THEN 0.3 ELSE 1.0 END, 9) AS weight FROM met LEFT JOIN kinds USING (id))
SELECT qid, id, CAST(weight AS DOUBLE) AS weight, CAST(row_number() OVER (PARTITION BY qid ORDER BY weight DESC, id) AS INTEGER) AS rank FROM scored""")
def _(spark, sf):
    """Up to ten of thirteen ranked seeds a query, each followed for three hops; what several reach counts once, by the least hop."""
    e = edges(spark, sf)
    users = read(spark, sf, "events").select("user_id").distinct()
    asked = users.where("user_id % 100 = 0").select(F.col("user_id").alias("q"), F.explode(F.sequence(F.col("user_id"), F.col("user_id") + 12)).alias("user_id"))
    seeds = asked.join(users, "user_id").select(
        F.concat(F.lit("u:"), "q").alias("qid"), F.concat(F.lit("u:"), "user_id").alias("id"), (F.col("user_id") - F.col("q") + 1).alias("place")
    )
    kinds = e.groupBy(F.col("to_id").alias("id")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "unknown").otherwise("topic").alias("kind"))
    return G.graph_arm(e, seeds, kinds, EDGE_NOW)


_ALLOWED = "step AS (SELECT s.a, s.b FROM ({}) s WHERE s.a NOT LIKE 't:%3' AND s.b NOT LIKE 't:%3')"


@query("bfs_view_on_path", _bfs_sql(3, "both").replace(_STEPS["both"], _ALLOWED.format("SELECT from_id AS a, to_id AS b FROM live UNION SELECT to_id, from_id FROM live")) + " SELECT * FROM found")
def _(spark, sf):
    """The view hides every tenth topic: nothing is reached through one."""
    e = edges(spark, sf)
    ids = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().where("NOT id LIKE 't:%3'")
    return G.neighbours(G.live_edges(e, EDGE_NOW), _roots(spark, sf), 3, "both", ids)


_MENTIONS = "m AS (SELECT DISTINCT doc_id, lower(trim(n)) AS n FROM (SELECT doc_id, unnest(people_mentions) AS n FROM corpus_docs) WHERE trim(n) <> '')"


@query("entity_graph", f"WITH {_MENTIONS}, d AS (SELECT doc_id, lower(trim(n)) AS n, rn FROM (SELECT rn, doc_id, unnest(people_mentions) AS n FROM (SELECT row_number() OVER () AS rn, * FROM corpus_docs)) WHERE trim(n) <> '')"
       " SELECT x.n AS a, y.n AS b, count(DISTINCT x.doc_id) AS n FROM d x JOIN d y ON x.rn = y.rn AND x.n < y.n GROUP BY ALL")
def _(spark, sf):
    return G.entity_graph(read(spark, sf, "corpus_docs").select(F.col("doc_id").alias("doc"), F.col("people_mentions").alias("names")))


@query("ppr_rounds", f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT from_id AS a, to_id AS b, CAST(count(*) AS DOUBLE) AS w FROM edges WHERE superseded_at IS NULL GROUP BY ALL),
s AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM e), ids AS (SELECT a AS id FROM e UNION SELECT b FROM e),
r AS (SELECT DISTINCT 'u:' || user_id AS id FROM events WHERE user_id % 100 = 0), base AS (SELECT id, CASE WHEN id IN (SELECT id FROM r) THEN 1.0 / (SELECT count(*) FROM r) ELSE 0.0 END AS p,
  id NOT IN (SELECT a FROM e) AS ends FROM ids),
it0 AS (SELECT id, p AS score FROM base), """ + ", ".join(
    f"""it{k + 1} AS (SELECT base.id, 0.85 * (coalesce(c, 0) + (SELECT coalesce(sum(score), 0) FROM it{k} JOIN base USING (id) WHERE ends) * p) + 0.15 * p AS score
  FROM base LEFT JOIN (SELECT b AS id, sum(score * share) AS c FROM it{k} JOIN s ON it{k}.id = s.a GROUP BY b) USING (id))""" for k in range(4))
       + " SELECT id, round(score, 9) AS score FROM it4")
def _(spark, sf):
    return G.pagerank(*_ppr(spark, sf), 4).select("id", F.round("score", 9).alias("score"))


def _ppr(spark, sf):
    e = edges(spark, sf).where("superseded_at IS NULL").groupBy(F.col("from_id").alias("a"), F.col("to_id").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return e, _roots(spark, sf).select(F.col("root").alias("id"), F.lit(1.0).alias("weight"))


@query("ppr_converged")
def _(spark, sf):
    """The same PageRank run until the scores move by less than 1e-6 in total."""
    return G.pagerank(*_ppr(spark, sf), 1_000, tolerance=1e-6).select("id", F.round("score", 9).alias("score"))


@query("ppr_seed_weights", """WITH d AS (SELECT DISTINCT doc_id, lower(trim(n)) AS n FROM (SELECT doc_id, unnest(people_mentions) AS n FROM corpus_docs) WHERE trim(n) <> ''),
t AS (SELECT count(DISTINCT doc_id) AS total FROM corpus_docs) SELECT n AS id, round(greatest(ln((total + 1) / (count(*) + 0.5)), 1e-6), 9) AS weight FROM d, t GROUP BY n, total""")
def _(spark, sf):
    docs = read(spark, sf, "corpus_docs")
    total = docs.select(F.countDistinct("doc_id")).first()[0]
    names = docs.select("doc_id", F.explode("people_mentions").alias("n")).select("doc_id", F.lower(F.trim("n")).alias("id")).where("id <> ''").distinct()
    return names.groupBy("id").agg(F.round(F.greatest(F.ln(F.lit(total + 1) / (F.count(F.lit(1)) + 0.5)), F.lit(1e-6)), 9).alias("weight"))


@query("ppr_passages")
def _(spark, sf):
    """Corpus passages for each document title whose id is divisible by 100: BM25 fused with the PageRank mass of their names."""
    rows = read(spark, sf, "corpus_docs")
    latest = rows.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("modified_at", F.lit("")), F.coalesce("body", F.lit("")).alias("body")))["body"].alias("body"))
    docs = latest.select(F.col("doc_id").alias("id"), T.words(F.col("body"), T.HARNESS_WORD, 2).alias("terms"))
    asked = read(spark, sf, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL")
    asked = asked.select(F.col("doc_id").alias("qid"), T.words(F.col("title"), T.HARNESS_WORD, 2).alias("terms"))
    members = rows.select(F.col("doc_id").alias("doc"), F.explode("people_mentions").alias("n")).select("doc", F.lower(F.trim("n")).alias("id")).where("id <> ''").distinct()
    together = G.entity_graph(rows.select(F.col("doc_id").alias("doc"), F.col("people_mentions").alias("names"))).select("a", "b")
    return passage_ranking(docs, asked, members, together)


@query("graph_seeding", f"""WITH {EDGES_SQL}, {_ARM_LIVE}, d AS (SELECT write_cursor AS id, regexp_extract_all(lower(body), '[a-z0-9]+') AS terms FROM live),
one AS (SELECT unnest(['click', '69', '17']) AS term), st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d), o AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM d),
t AS (SELECT id, dl, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM one) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM t JOIN f USING (term), st GROUP BY id),
h AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 10) SELECT DISTINCT unnest([from_id, to_id]) AS id FROM live WHERE write_cursor IN (SELECT id FROM h)""")
def _(spark, sf):
    """The ends of the ten facts that match a query best."""
    live = G.live_edges(edges(spark, sf), EDGE_NOW, fallback=False)
    asked = spark.createDataFrame([(1, ["click", "69", "17"])], "qid int, terms array<string>")
    docs = live.select(F.col("write_cursor").alias("id"), T.words(F.col("body"), T.HARNESS_WORD).alias("terms"))
    best = T.top(T.bm25(docs, asked), 10).select(F.col("id").alias("write_cursor"))
    return live.join(best, "write_cursor", "left_semi").select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
