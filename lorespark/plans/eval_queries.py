"""Queries of evaluation analytics over the pool, its gold records and the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators import evals as E
from lorespark.operators import text as T
from lorespark.operators import vector as V
from lorespark.plans.canonical import VECTORS_SQL, read, vectors

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_RUN = """ranked AS (SELECT query_id AS qid, doc_id AS id, min(pool_rank) + 1 AS rank FROM pool WHERE query_id IS NOT NULL GROUP BY ALL),
labels AS (SELECT DISTINCT query_id AS qid, l.id AS id, l.relevance AS relevance FROM (SELECT query_id, unnest(labels) AS l FROM gold_records)),
gold AS (SELECT DISTINCT qid, id FROM labels WHERE relevance > 0)"""


def _ranked(spark, sf):
    p = read(spark, sf, "pool").where("query_id IS NOT NULL")
    return p.groupBy(F.col("query_id").alias("qid"), F.col("doc_id").alias("id")).agg((F.min("pool_rank") + 1).alias("rank"))


def _labels(spark, sf):
    g = read(spark, sf, "gold_records").select(F.col("query_id").alias("qid"), F.explode("labels").alias("l"))
    return g.select("qid", "l.id", "l.relevance").distinct()


def _gold(spark, sf):
    return _labels(spark, sf).where("relevance > 0").select("qid", "id").distinct()


_MET = "met AS (SELECT g.qid, g.id, rank FROM gold g LEFT JOIN ranked r ON g.qid = r.qid AND g.id = r.id)"


@query("recall_ladder", f"""WITH {_RUN}, {_MET} SELECT qid, CAST(k AS INTEGER) AS k, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall,
  count(*) FILTER (rank <= k) = count(*) AS all_found FROM met, (VALUES (5), (10), (20), (50)) t(k) GROUP BY qid, k""")
def _(spark, sf):
    return E.recall_ladder(_ranked(spark, sf), _gold(spark, sf))


@query("mrr_ndcg", f"""WITH {_RUN}, {_MET}, a AS (SELECT qid, min(rank) FILTER (rank <= 10) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, least(count(*), 10) AS n FROM met GROUP BY qid)
SELECT qid, first IS NOT NULL AS hit, round(coalesce(1 / first, 0), 6) AS rr, round(dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM a""")
def _(spark, sf):
    return E.mrr_ndcg(_ranked(spark, sf), _gold(spark, sf))


@query("metrics_by_class", f"""WITH {_RUN}, {_MET}, r AS (SELECT qid, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall FROM met GROUP BY qid),
c AS (SELECT DISTINCT query_id AS qid, embedder_id AS cls FROM gold_records)
SELECT cls, count(*) AS queries, round(avg(recall), 4) AS recall FROM r JOIN (SELECT qid, min(cls) AS cls FROM c GROUP BY qid) USING (qid) GROUP BY ROLLUP (cls)""")
def _(spark, sf):
    r = E.recall_ladder(_ranked(spark, sf), _gold(spark, sf), (10,))
    c = read(spark, sf, "gold_records").groupBy(F.col("query_id").alias("qid")).agg(F.min("embedder_id").alias("cls"))
    return E.by_class(r.join(c, "qid"), "cls", ["recall"])


@query("abstention_fpr", """WITH q AS (SELECT DISTINCT query_id AS qid FROM gold_records), h AS (SELECT DISTINCT query_id AS qid FROM pool WHERE ce_norm >= 0.5 AND NOT isnan(ce_norm))
SELECT count(*) AS queries, count(h.qid) AS answered, round(count(h.qid) / count(*), 6) AS fpr FROM q LEFT JOIN h USING (qid)""")
def _(spark, sf):
    q = read(spark, sf, "gold_records").select(F.col("query_id").alias("qid")).distinct()
    h = read(spark, sf, "pool").where("ce_norm >= 0.5 AND NOT isnan(ce_norm)").select(F.col("query_id").alias("qid"), F.lit(1).alias("h")).distinct()
    return q.join(h, "qid", "left").agg(F.count(F.lit(1)).alias("queries"), F.count("h").alias("answered"), F.round(F.count("h") / F.count(F.lit(1)), 6).alias("fpr"))


@query("found_at_k", f"""WITH {_RUN}, {_MET} SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (rank <= k) AS found, round(count(*) FILTER (rank <= k) / count(*), 6) AS share
FROM met, (VALUES (50), (100), (200), (500), (1000)) t(k) GROUP BY k""")
def _(spark, sf):
    met = _gold(spark, sf).join(_ranked(spark, sf), ["qid", "id"], "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in (50, 100, 200, 500, 1000)))))
    hit = F.count_if(F.col("rank") <= F.col("k"))
    return met.groupBy("k").agg(hit.alias("found"), F.round(hit / F.count(F.lit(1)), 6).alias("share"))


@query("frozen_precision_recall", f"""WITH {_RUN}, c AS (SELECT DISTINCT query_id AS qid, unnest(candidate_ids) AS id FROM gold_records),
a AS (SELECT qid, count(l.id) AS labelled, count(*) FILTER (relevance > 0) AS relevant FROM c LEFT JOIN (SELECT qid, id, max(relevance) AS relevance FROM labels GROUP BY ALL) l USING (qid, id) GROUP BY qid),
t AS (SELECT qid, count(*) AS total FROM gold GROUP BY qid)
SELECT qid, CASE WHEN labelled > 0 THEN round(relevant / labelled, 6) END AS precision, CASE WHEN total > 0 THEN round(relevant / total, 6) END AS recall FROM a LEFT JOIN t USING (qid)""")
def _(spark, sf):
    c = read(spark, sf, "gold_records").select(F.col("query_id").alias("qid"), F.explode("candidate_ids").alias("id")).distinct()
    labels = _labels(spark, sf).groupBy("qid", "id").agg(F.max("relevance").alias("relevance"))
    a = c.join(labels, ["qid", "id"], "left").groupBy("qid").agg(F.count("relevance").alias("labelled"), F.count_if(F.col("relevance") > 0).alias("relevant"))
    t = _gold(spark, sf).groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    return a.join(t, "qid", "left").select(
        "qid", F.when(F.col("labelled") > 0, F.round(F.col("relevant") / F.col("labelled"), 6)).alias("precision"),
        F.when(F.col("total") > 0, F.round(F.col("relevant") / F.col("total"), 6)).alias("recall"),
    )


_SWEEP = ((0.0, 20), (0.3, 20), (0.3, 50), (1.0, 50))


@query("rerank_sweep", f"""WITH {_RUN}, best AS (SELECT query_id AS qid, doc_id AS id, max(CASE WHEN NOT isnan(ce_norm) THEN ce_norm END) AS ce FROM pool WHERE query_id IS NOT NULL GROUP BY ALL),
x AS (SELECT alpha, pool_n, qid, id, rank, rank <= pool_n AS inside, CASE WHEN rank <= pool_n THEN round(alpha * coalesce(ce, 0) + (1 - alpha) * (1.0 / (30 + rank)), 9) END AS s
  FROM ranked JOIN best USING (qid, id), (VALUES {', '.join(f'({a}, {n})' for a, n in _SWEEP)}) t(alpha, pool_n)),
y AS (SELECT *, row_number() OVER (PARTITION BY alpha, pool_n, qid ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, s DESC NULLS LAST, rank, id) AS r FROM x)
SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(pool_n AS INTEGER) AS pool_n, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(1.0 / r), 6) AS mrr FROM gold JOIN y USING (qid, id) GROUP BY alpha, pool_n""")
def _(spark, sf):
    best = read(spark, sf, "pool").where("query_id IS NOT NULL").groupBy(F.col("query_id").alias("qid"), F.col("doc_id").alias("id")).agg(
        F.max(F.nanvl("ce_norm", F.lit(None).cast("double"))).alias("ce")
    )
    cases = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(n).alias("pool_n")) for a, n in _SWEEP))
    x = _ranked(spark, sf).join(best, ["qid", "id"]).withColumn("c", F.explode(cases)).select("qid", "id", "rank", "ce", "c.alpha", "c.pool_n")
    inside = F.col("rank") <= F.col("pool_n")
    s = F.when(inside, F.round(F.col("alpha") * F.coalesce("ce", F.lit(0.0)) + (1 - F.col("alpha")) * (1.0 / (30 + F.col("rank"))), 9))
    order = Window.partitionBy("alpha", "pool_n", "qid").orderBy(F.when(inside, 0).otherwise(1), s.desc_nulls_last(), "rank", "id")
    y = x.withColumn("r", F.row_number().over(order))
    return _gold(spark, sf).join(y, ["qid", "id"]).groupBy("alpha", "pool_n").agg(
        F.round(F.avg((F.col("r") <= 10).cast("double")), 6).alias("recall"), F.round(F.avg(1 / F.col("r")), 6).alias("mrr")
    )


@query("ranking_divergence", """WITH b AS (SELECT query_id AS qid, doc_id AS id, max(CASE WHEN NOT isnan(base_score) THEN base_score END) AS s, max(CASE WHEN NOT isnan(ce_norm) THEN ce_norm END) AS c FROM pool WHERE query_id IS NOT NULL GROUP BY ALL),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC NULLS LAST, id) AS rs, row_number() OVER (PARTITION BY qid ORDER BY c DESC NULLS LAST, id) AS rc FROM b),
t AS (SELECT qid, list_sort(list(id) FILTER (rs <= 10)) <> list_sort(list(id) FILTER (rc <= 10)) AS differ FROM r WHERE rs <= 10 OR rc <= 10 GROUP BY qid)
SELECT count(*) AS queries, round(avg(CASE WHEN differ THEN 1.0 ELSE 0.0 END), 6) AS divergence FROM t""")
def _(spark, sf):
    from lorespark.operators.text import top

    none = F.lit(None).cast("double")
    b = read(spark, sf, "pool").where("query_id IS NOT NULL").groupBy(F.col("query_id").alias("qid"), F.col("doc_id").alias("id")).agg(
        F.max(F.nanvl("base_score", none)).alias("s"), F.max(F.nanvl("ce_norm", none)).alias("c")
    )
    lists = [
        top(b, 10, order=(F.col(c).desc_nulls_last(), F.col("id"))).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias(c)) for c in "sc"
    ]
    both = lists[0].join(lists[1], "qid")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("s") != F.col("c")).cast("double")), 6).alias("divergence"))


@query("squad_em_f1", r"""WITH n AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(title), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS a,
  list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS g FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, a = g AS em, a, g FROM n),
aw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(a) AS x FROM w) GROUP BY ALL), gw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(g) AS x FROM w) GROUP BY ALL),
c AS (SELECT doc_id, sum(least(aw.n, gw.n)) AS c FROM aw JOIN gw USING (doc_id, x) GROUP BY doc_id)
SELECT doc_id, CAST(em AS INTEGER) AS em, round(CASE WHEN em THEN 1.0 WHEN c > 0 THEN 2.0 * c / (len(a) + len(g)) ELSE 0.0 END, 6) AS f1 FROM w LEFT JOIN c USING (doc_id)""")
def _(spark, sf):
    return E.em_f1(read(spark, sf, "documents").where("title IS NOT NULL AND text IS NOT NULL"), "doc_id", "title", "text")


@query("answer_containment", """SELECT source_type, count(*) AS questions, count(*) FILTER (contains(lower(text), lower(author_or_sender))) AS contained
FROM documents WHERE author_or_sender IS NOT NULL AND text IS NOT NULL GROUP BY source_type""")
def _(spark, sf):
    d = read(spark, sf, "documents").where("author_or_sender IS NOT NULL AND text IS NOT NULL")
    return d.groupBy("source_type").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.contains(F.lower("text"), F.lower("author_or_sender"))).alias("contained"))


@query("paired_delta", """WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT count(*) AS n, round(avg(b.v - a.v), 6) AS mean_delta, round(var_pop(b.v - a.v), 6) AS variance, round(regr_slope(b.v, a.v), 6) AS ols_slope FROM a JOIN b USING (user_id)""")
def _(spark, sf):
    e = read(spark, sf, "events")
    a, b = (e.where(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias("v")) for t in ("click", "view"))
    return E.paired(a, b, "user_id", "v")


@query("bootstrap_means")
def _(spark, sf):
    return E.bootstrap(read(spark, sf, "events"), "event_type", "value")


@query("perf_drift", """WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, median(value) AS value FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM d), p AS (SELECT series, max(value) FILTER (r = 1) AS latest, median(value) FILTER (r BETWEEN 2 AND 11) AS median FROM r GROUP BY series)
SELECT series, round(latest, 6) AS latest, round(median, 6) AS median, round(latest / median - 1, 6) AS change, CASE WHEN median IS NULL THEN 'insufficient' WHEN latest / median - 1 > 0.15 THEN 'regression' ELSE 'ok' END AS verdict FROM p""")
def _(spark, sf):
    days = read(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("at")).agg(F.median("value").alias("value"))
    return E.perf_drift(days.withColumn("sha", F.lit("")))


@query("perf_drift_recall", """WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, round(median(value) / 100, 9) AS value FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM d), p AS (SELECT series, max(value) FILTER (r = 1) AS latest, median(value) FILTER (r BETWEEN 2 AND 11) AS median FROM r GROUP BY series)
SELECT series, round(latest, 6) AS latest, round(median, 6) AS median, round(latest - median, 6) AS change, CASE WHEN median IS NULL THEN 'insufficient' WHEN median - latest > 0.03 THEN 'regression' ELSE 'ok' END AS verdict FROM p""")
def _(spark, sf):
    days = read(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("at")).agg(F.round(F.median("value") / 100, 9).alias("value"))
    return E.perf_drift(days.withColumn("sha", F.lit("")), recall=True)


_EVIDENCE = "ev AS (SELECT qid, id, bool_or(relevance > 0) AS req, bool_or(relevance = 0) AS sup FROM labels GROUP BY ALL)"


@query("evidence_recall", f"""WITH {_RUN}, {_EVIDENCE}, h AS (SELECT DISTINCT qid, id, true AS hit FROM ranked WHERE rank <= 20),
a AS (SELECT qid, count(*) FILTER (req) AS r, count(*) FILTER (req AND hit) AS rh, count(*) FILTER (sup) AS s, count(*) FILTER (sup AND hit) AS sh FROM ev LEFT JOIN h USING (qid, id) GROUP BY qid)
SELECT qid, CASE WHEN rh = r THEN 1.0 ELSE 0.0 END AS strict, round(CASE WHEN r = 0 THEN 1.0 ELSE rh / r END, 6) AS graded, round(CASE WHEN s > 0 THEN sh / s END, 6) AS supporting FROM a""")
def _(spark, sf):
    ev = _labels(spark, sf).select("qid", "id", F.when(F.col("relevance") > 0, "required").otherwise("supporting").alias("necessity"))
    return E.evidence_recall(_ranked(spark, sf), ev, 20)


@query("recall_gate", f"""WITH {_RUN}, {_MET}, r AS (SELECT qid, round(count(*) FILTER (rank <= 50) / count(*), 6) AS recall FROM met GROUP BY qid),
c AS (SELECT query_id AS qid, min(embedder_id) AS cls FROM gold_records GROUP BY 1),
i AS (SELECT cls, count(recall) AS n, avg(recall) AS mean, coalesce(stddev_samp(recall), 0) * 1.96 / sqrt(count(recall)) AS w FROM r JOIN c USING (qid) GROUP BY cls)
SELECT cls, n, round(mean, 6) AS mean, round(mean - w, 6) AS low, round(mean + w, 6) AS high, round(mean + w, 6) >= 0.9 AS clears FROM i""")
def _(spark, sf):
    r = E.recall_ladder(_ranked(spark, sf), _gold(spark, sf), (50,))
    c = read(spark, sf, "gold_records").groupBy(F.col("query_id").alias("qid")).agg(F.min("embedder_id").alias("cls"))
    return E.normal_interval(r.join(c, "qid"), "cls", "recall").withColumn("clears", E.clears_floor(F.col("high"), 0.9))


@query("decision_ladder", """WITH u AS (SELECT user_id, avg(value) AS base FROM events GROUP BY 1),
d AS (SELECT event_type AS class, user_id, round(avg(value) - any_value(base), 9) AS gain FROM events JOIN u USING (user_id) GROUP BY ALL),
i AS (SELECT class, count(gain) AS n, round(avg(gain) - coalesce(stddev_samp(gain), 0) * 1.96 / sqrt(count(gain)), 6) AS low FROM d GROUP BY class),
v AS (SELECT class, CASE WHEN n < 30 THEN 'UNDERPOWERED' WHEN low IS NULL THEN 'NO_DATA' WHEN low > 0.04 THEN 'SUFFICIENT' ELSE 'CEILING_ABSORBED' END AS verdict FROM i)
SELECT class, verdict FROM v UNION ALL SELECT NULL, CASE WHEN count(*) FILTER (verdict = 'SUFFICIENT') > 0 THEN 'SUFFICIENT' WHEN count(*) FILTER (verdict = 'CEILING_ABSORBED') > 0 THEN 'CEILING_ABSORBED' ELSE 'INCONCLUSIVE' END FROM v""")
def _(spark, sf):
    e = read(spark, sf, "events")
    base = e.groupBy("user_id").agg(F.avg("value").alias("base"))
    gain = e.groupBy(F.col("event_type").alias("class"), "user_id").agg(F.avg("value").alias("v")).join(base, "user_id")
    return E.sufficiency(E.normal_interval(gain.withColumn("gain", F.round(F.col("v") - F.col("base"), 9)), "class", "gain"))


@query("depth_measurability", """SELECT CAST(k AS INTEGER) AS k, CAST(l AS INTEGER) AS "limit", CASE WHEN k <= l THEN 'yes' WHEN k > 100 THEN 'never' ELSE 'raise the limit' END AS measurable
FROM (SELECT DISTINCT pool_rank + 1 AS k FROM pool WHERE pool_rank < 300) p, (VALUES (10), (50), (100)) t(l)""")
def _(spark, sf):
    k = read(spark, sf, "pool").where("pool_rank < 300").select((F.col("pool_rank") + 1).cast("int").alias("k")).distinct()
    rows = k.withColumn("limit", F.explode(F.array(F.lit(10), F.lit(50), F.lit(100))))
    return rows.select("k", "limit", E.measurable(F.col("k"), F.col("limit")).alias("measurable"))


@query("graph_coverage", """WITH m AS (SELECT doc_id, list_distinct(list_filter(list_transform(flatten(list(coalesce(people_mentions, []))), lambda x: lower(trim(x))), lambda x: x <> '')) AS names FROM corpus_docs GROUP BY doc_id),
n AS (SELECT len(names) AS n, len(names) * (len(names) - 1) // 2 AS e FROM m)
SELECT count(*) AS questions, count(*) FILTER (n > 0) AS covered, CAST(sum(n) AS BIGINT) AS entities, CAST(sum(e) AS BIGINT) AS edges, median(n) AS median_entities, median(e) AS median_edges,
  round(count(*) FILTER (n > 0) / count(*), 6) AS coverage, count(*) FILTER (n > 0) / count(*) >= 0.5 AND sum(n) > 0 AND sum(e) > 0 AS ok FROM n""")
def _(spark, sf):
    names = F.flatten(F.collect_list(F.coalesce("people_mentions", F.array().cast("array<string>"))))
    return E.graph_coverage(read(spark, sf, "corpus_docs").groupBy(F.col("doc_id").alias("question")).agg(names.alias("names")), 0.5)


@query("gold_build", """WITH g AS (SELECT DISTINCT query_id, l.id AS id, l.relevance > 0 AS rel FROM (SELECT query_id, unnest(labels) AS l FROM gold_records)),
n AS (SELECT query_id, count(DISTINCT id) FILTER (rel AND id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)) AS n FROM g GROUP BY query_id)
SELECT query_id, CASE WHEN n > 0 THEN n END AS required, CASE WHEN n = 0 THEN 'no evidence in the corpus' END AS reason FROM n""")
def _(spark, sf):
    """Questions with the documents that ground them, and why the others were dropped."""
    g = read(spark, sf, "gold_records").select("query_id", F.explode("labels").alias("l"))
    rows = g.groupBy(F.col("query_id").alias("qa_id")).agg(F.collect_set(F.when(F.col("l.relevance") > 0, F.col("l.id"))).alias("evidence"))
    rows = rows.select("qa_id", F.col("qa_id").alias("question"), F.lit(False).alias("negative"), "evidence")
    gold, dropped = E.build_gold(rows, read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id"))
    gold = gold.select("query_id", F.size("required").cast("bigint").alias("required"), F.lit(None).cast("string").alias("reason"))
    return gold.unionByName(dropped.select(F.col("qa_id").alias("query_id"), F.lit(None).cast("bigint").alias("required"), "reason"))


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def _(spark, sf):
    e = read(spark, sf, "events")
    a, b = (E.ceil_percentile(e, "event_type", "value", q).withColumnRenamed("value", n) for q, n in ((0.5, "p50"), (0.99, "p99")))
    return a.join(b, "event_type")


@query("kendall_tau", f"""WITH {VECTORS_SQL}, n AS (SELECT q.write_cursor AS qid, m.write_cursor AS id, round(list_distance(q.v, m.v), 9) AS d, round(list_sum(list_transform(range(1, 33), lambda i: (q.v[i] - m.v[i]) ** 2)), 9) AS h
  FROM vectors q, vectors m WHERE q.write_cursor % 100 = 0),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS a, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS b FROM n), t AS (SELECT * FROM r WHERE a <= 50)
SELECT x.qid, count(*) AS pairs, round((2.0 * count(*) FILTER (x.b < y.b) - count(*)) / count(*), 6) AS tau FROM t x JOIN t y ON x.qid = y.qid AND x.a < y.a GROUP BY x.qid""")
def _(spark, sf):
    v = vectors(spark, sf).select(F.col("write_cursor").alias("id"), "v")
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    # Only the first fifty are put in order by the half-length vectors: tau asks for their order, not for their places among all rows.
    a = V.nearest(v, q, 50).select("qid", "id", F.col("rank").alias("a")).join(v.select("id", F.slice("v", 1, 32).alias("m")), "id")
    square = F.aggregate(F.zip_with("m", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    both = a.join(q.select("qid", F.slice("v", 1, 32).alias("q")), "qid").withColumn("h", F.round(square, 9))
    both = both.withColumn("b", F.row_number().over(Window.partitionBy("qid").orderBy("h", "id")))
    return E.kendall_tau(both, "qid", "a", "b", "id")


@query("label_recall_vectors", f"""WITH {VECTORS_SQL}, n AS (SELECT q.write_cursor AS qid, q.label AS label, m.label AS other, row_number() OVER (PARTITION BY q.write_cursor ORDER BY round(list_distance(q.v, m.v), 9), m.write_cursor) AS r
  FROM vectors q, vectors m WHERE q.write_cursor % 100 = 0 AND m.write_cursor <> q.write_cursor)
SELECT qid, label, count(*) FILTER (r <= 10 AND label = other) AS hits FROM n GROUP BY qid, label""")
def _(spark, sf):
    v = vectors(spark, sf).select(F.col("write_cursor").alias("id"), "v", "label")
    q = v.where("id % 100 = 0")
    near = V.nearest(v, q.select(F.col("id").alias("qid"), "v"), 11).where("qid <> id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where("r <= 10")
    hits = near.join(v.select("id", F.col("label").alias("other")), "id")
    own = q.select(F.col("id").alias("qid"), "label")
    return own.join(hits, "qid", "left").groupBy("qid", "label").agg(F.count_if(F.col("label") == F.col("other")).alias("hits"))


@query("nearest_centroid_source", r"""WITH docs AS (SELECT doc_id AS id, source_type AS label, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: strlen(t) >= 2) AS terms FROM documents WHERE text IS NOT NULL AND source_type IS NOT NULL),
n AS (SELECT count(*) AS n FROM docs), occ AS (SELECT id, label, unnest(terms) AS term FROM docs), tf AS (SELECT id, label, term, count(*) AS tf FROM occ GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w0 AS (SELECT id, label, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), w AS (SELECT id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w0),
sz AS (SELECT label, count(*) AS n FROM docs WHERE len(terms) > 0 GROUP BY label), c0 AS (SELECT label, term, sum(w) / any_value(n) AS c FROM w JOIN sz USING (label) GROUP BY label, term),
c AS (SELECT label AS predicted, term, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS c FROM c0), s AS (SELECT id, label, predicted, round(sum(w * c), 9) AS score FROM w JOIN c USING (term) GROUP BY ALL)
SELECT id, label, predicted FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, predicted) = 1""")
def _(spark, sf):
    d = read(spark, sf, "documents").where("text IS NOT NULL AND source_type IS NOT NULL")
    return E.nearest_centroid(d.select(F.col("doc_id").alias("id"), F.col("source_type").alias("label"), T.words(F.col("text"), T.HARNESS_WORD, 2).alias("terms")))


@query("stratified_folds", "SELECT doc_id, source_type, CAST((row_number() OVER (PARTITION BY source_type ORDER BY sha256('7:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")
def _(spark, sf):
    return E.folds(read(spark, sf, "documents"), "doc_id", "source_type", 5, 7)


@query("gold_validation", """WITH g AS (SELECT query_id, count(*) AS rows, max(len(candidate_ids)) AS candidates, max(len(list_filter(labels, lambda l: l.relevance > 0))) AS relevant FROM gold_records GROUP BY query_id)
SELECT count(*) AS queries, count(*) FILTER (rows > 1) AS repeated, count(*) FILTER (coalesce(relevant, 0) = 0) AS without_relevant, count(*) FILTER (coalesce(candidates, 0) = 0) AS without_candidates FROM g""")
def _(spark, sf):
    g = read(spark, sf, "gold_records").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(F.size("candidate_ids"), F.lit(0))).alias("candidates"),
        F.max(F.size(F.filter("labels", lambda x: x["relevance"] > 0))).alias("relevant"),
    )
    return g.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("rows") > 1).alias("repeated"),
        F.count_if(F.coalesce("relevant", F.lit(0)) <= 0).alias("without_relevant"), F.count_if(F.col("candidates") <= 0).alias("without_candidates"),
    )


@query("thread_sessions", r"""SELECT regexp_replace(thread_id, '#c\d+$', '') AS session, count(DISTINCT source_type) AS types, count(*) AS rows FROM documents WHERE thread_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def _(spark, sf):
    d = read(spark, sf, "documents").where("thread_id IS NOT NULL").withColumn("session", F.regexp_replace("thread_id", r"#c\d+$", ""))
    return d.groupBy("session").agg(F.countDistinct("source_type").alias("types"), F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("n")).where("n >= 2").drop("n")


@query("corpus_freeze", """WITH d AS (SELECT DISTINCT doc_id, provenance, sha256(concat_ws('|', doc_id, coalesce(modified_at, ''), coalesce(body, ''))) AS h FROM corpus_docs)
SELECT provenance, count(*) AS docs, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM d GROUP BY provenance""")
def _(spark, sf):
    from lorespark.sources.corpus import freeze

    return freeze(read(spark, sf, "corpus_docs"))


@query("corpus_doc_ids", "SELECT DISTINCT doc_id, substr(sha256(concat_ws('|', provenance, url_or_external_id)), 1, 16) AS derived FROM corpus_docs")
def _(spark, sf):
    from lorespark.sources.corpus import derived_id

    return read(spark, sf, "corpus_docs").select("doc_id", derived_id("provenance", "url_or_external_id").alias("derived")).distinct()


@query("corpus_ingest", """SELECT DISTINCT 'node' AS item, doc_id AS a, NULL AS b, source_type AS kind FROM corpus_docs WHERE doc_id IS NOT NULL
UNION ALL SELECT DISTINCT 'edge', doc_id, parent_doc_id, 'follows_up_on' FROM corpus_docs WHERE doc_id IS NOT NULL AND parent_doc_id IS NOT NULL""")
def _(spark, sf):
    from lorespark.sources.corpus import corpus_items

    rows = read(spark, sf, "corpus_docs")
    chains = rows.where("parent_doc_id IS NOT NULL").select(F.array("parent_doc_id", "doc_id").alias("doc_ids"), F.lit("follows_up_on").alias("relation"))
    n, e = corpus_items(rows, chains)
    return n.select(F.lit("node").alias("item"), F.col("logical_id").alias("a"), F.lit(None).cast("string").alias("b"), "kind").unionByName(
        e.select(F.lit("edge").alias("item"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), "kind")
    )


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
