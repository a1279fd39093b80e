"""Queries on text, vectors and their fusion. A stated query set (ids divisible by 100) searches all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import fusion as FU
from lorespark.operators import ranked as R
from lorespark.operators import text as T
from lorespark.operators import vector as V
from lorespark.operators.predicates import ReadView
from lorespark.operators.skew import positions
from lorespark.operators.widen import latest, plain_name
from lorespark.plans.canonical import EDGES_SQL, VECTORS_SQL, edges, nodes, read, vectors

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _terms_sql(column: str) -> str:
    kept = (
        f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}]+')), "
        f"lambda t: strlen(t) >= 3 AND NOT list_contains({_STOP}, t))"
    )
    raw = f"list_filter(list_distinct(regexp_split_to_array(coalesce({column}, ''), '\\s+')), lambda t: t <> '')"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {raw} END"


_DOCS = r"docs AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS terms FROM documents)"
_ASKED = f"asked AS (SELECT DISTINCT qid, unnest(terms) AS term FROM (SELECT doc_id AS qid, {_terms_sql('title')} AS terms FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL))"
_TF = """occ AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM docs),
tf AS (SELECT id, dl, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM docs)"""
_FLOORED = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
_PLUS = "ln(1 + (n - df + 0.5) / (df + 0.5))"


def _bm25_sql(k1: str, b: str, idf: str) -> str:
    return f"""scored AS (SELECT qid, id, round(sum({idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / mean))), 9) AS score, count(*) AS matched
  FROM asked JOIN df USING (term) JOIN tf USING (term), st GROUP BY qid, id)"""


def _ranked(k: int, columns: str = "qid, id, score", source: str = "scored") -> str:
    return f"""SELECT {columns}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source}) WHERE rank <= {k}"""


def _docs(spark, sf, pattern=T.WORD, least=1):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.words(F.col("text"), pattern, least).alias("terms"))


def _asked(spark, sf):
    d = read(spark, sf, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL")
    return d.select(F.col("doc_id").alias("qid"), T.content_terms(F.col("title")).alias("terms"))


@query("query_terms", f"SELECT doc_id AS qid, list_sort({_terms_sql('title')}) AS terms FROM documents WHERE title IS NOT NULL")
def _(spark, sf):
    d = read(spark, sf, "documents").where("title IS NOT NULL")
    return d.select(F.col("doc_id").alias("qid"), F.array_sort(T.content_terms(F.col("title"))).alias("terms"))


@query("bm25_body", f"WITH {_DOCS}, {_ASKED}, {_TF}, {_bm25_sql('1.2', '0.75', _FLOORED)} {_ranked(100)}")
def _(spark, sf):
    return R.bm25_top(spark, R.postings(_docs(spark, sf), _asked(spark, sf)), 100)


_HDOCS = "docs AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: strlen(t) >= 2) AS terms FROM documents)"
_HASKED = """asked AS (SELECT DISTINCT qid, unnest(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: strlen(t) >= 2)) AS term
  FROM (SELECT doc_id AS qid, title FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL))"""


def _harness(spark, sf):
    asked = read(spark, sf, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL")
    asked = asked.select(F.col("doc_id").alias("qid"), T.words(F.col("title"), T.HARNESS_WORD, 2).alias("terms"))
    return _docs(spark, sf, T.HARNESS_WORD, 2), asked


@query("bm25_harness", f"WITH {_HDOCS}, {_HASKED}, {_TF}, {_bm25_sql('1.5', '0.75', _PLUS)} {_ranked(50)}")
def _(spark, sf):
    return R.bm25_top(spark, R.postings(*_harness(spark, sf)), 50, T.HARNESS)


@query("bm25_b_sweep", f"WITH {_HDOCS}, {_HASKED}, {_TF}, " + ", ".join(
    f"s{i} AS (SELECT qid, id, round(sum({_PLUS} * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / mean))), 9) AS score FROM asked JOIN df USING (term) JOIN tf USING (term), st GROUP BY qid, id)"
    for i, b in enumerate((0.0, 0.25, 0.5, 0.75))) + " " + " UNION ALL ".join(
    f"SELECT CAST({b} AS DOUBLE) AS b, * FROM ({_ranked(10, source=f's{i}')})" for i, b in enumerate((0.0, 0.25, 0.5, 0.75))))
def _(spark, sf):
    found = R.postings(*_harness(spark, sf))
    out = None
    for b in (0.0, 0.25, 0.5, 0.75):
        rows = R.bm25_top(spark, found, 10, T.Bm25(1.5, b, "plus_one")).select(F.lit(b).alias("b"), "qid", "id", "score", "rank")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("match_all_terms", f"WITH {_DOCS}, {_ASKED}, {_TF}, {_bm25_sql('1.2', '0.75', _FLOORED)}, c AS (SELECT qid, count(*) AS n FROM asked GROUP BY qid) SELECT qid, id, score FROM scored JOIN c USING (qid) WHERE matched = c.n")
def _(spark, sf):
    return R.bm25_all_terms(spark, R.postings(_docs(spark, sf), _asked(spark, sf)))


@query("tfidf_cosine", f"""WITH {_HDOCS}, n AS (SELECT count(*) AS n FROM docs),
occ AS (SELECT id, unnest(terms) AS term FROM docs), tf AS (SELECT id, term, count(*) AS tf FROM occ GROUP BY ALL),
idf AS (SELECT term, ln(n / count(*)) + 1 AS idf FROM tf, n GROUP BY term, n), w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
qo AS (SELECT doc_id AS qid, unnest(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: strlen(t) >= 2)) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
qw AS (SELECT qid, term, count(*) * any_value(idf) AS qw FROM qo JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY qid),
scored AS (SELECT qid, id, round(sum(qw * w) / any_value(norm * qnorm), 9) AS score FROM qw JOIN w USING (term) JOIN nm USING (id) JOIN qn USING (qid) GROUP BY qid, id)
{_ranked(20)}""")
def _(spark, sf):
    return R.tfidf_top(*_harness(spark, sf), 20)


_FIELDS = {"f_kind": 0.5, "f_body": 1.0, "f_status": 2.0}
_NODE_FIELDS = r"""docs AS (SELECT DISTINCT write_cursor AS id, regexp_extract_all(lower(coalesce(kind, '')), '[\p{L}\p{N}]+') AS f_kind,
  regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}]+') AS f_body,
  regexp_extract_all(lower(coalesce(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.status') END, '')), '[\p{L}\p{N}]+') AS f_status
  FROM canonical_nodes WHERE superseded_at IS NULL AND state = 'active')"""


def _node_fields(spark, sf):
    status = F.try_variant_get(F.try_parse_json("body"), "$.status", "string")
    rows = nodes(spark, sf).where(ReadView().existence()).select("write_cursor", "kind", "body").distinct()
    return rows.select(
        F.col("write_cursor").alias("id"), T.words(F.col("kind")).alias("f_kind"), T.words(F.col("body")).alias("f_body"), T.words(status).alias("f_status")
    )


_TITLES = "(SELECT DISTINCT write_cursor AS qid, json_extract_string(body, '$.title') AS title FROM canonical_nodes WHERE write_cursor % 100 = 0 AND CASE WHEN json_valid(body) THEN json_type(body, '$.title') = 'VARCHAR' END)"


@query("bm25f_fielded", f"""WITH {_NODE_FIELDS}, asked AS (SELECT DISTINCT qid, unnest(terms) AS term FROM (SELECT qid, {_terms_sql('title')} AS terms FROM {_TITLES})),
st AS (SELECT count(*) AS n, avg(len(f_kind)) AS a, avg(len(f_body)) AS b, avg(len(f_status)) AS c FROM docs),
occ AS (SELECT id, unnest(f_kind) AS term, 0.5 / (0.25 + 0.75 * len(f_kind) / a) AS w FROM docs, st
  UNION ALL SELECT id, unnest(f_body), 1.0 / (0.25 + 0.75 * len(f_body) / b) FROM docs, st
  UNION ALL SELECT id, unnest(f_status), 2.0 / (0.25 + 0.75 * len(f_status) / c) FROM docs, st),
tf AS (SELECT id, term, sum(w) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT qid, id, round(sum({_FLOORED} * tf * 2.2 / (tf + 1.2)), 9) AS score FROM asked JOIN df USING (term) JOIN tf USING (term), st GROUP BY qid, id) {_ranked(100)}""")
def _(spark, sf):
    """The titles of the nodes whose cursor is divisible by 100 search all current nodes."""
    title = F.try_variant_get(F.try_parse_json("body"), "$.title", "string")
    asked = nodes(spark, sf).where("write_cursor % 100 = 0").select(F.col("write_cursor").alias("qid"), title.alias("title")).where("title IS NOT NULL").distinct()
    asked = asked.select("qid", T.content_terms(F.col("title")).alias("terms"))
    return R.bm25f_top(_node_fields(spark, sf), _FIELDS, asked, 100)


_OWNERS = r"""held AS (SELECT write_cursor, attr_value AS v FROM canonical_attributes WHERE write_cursor IS NOT NULL AND replace(lower(regexp_replace(attr_name, '^\s+|\s+$', '', 'g')), '-', '_') = 'owner'
  QUALIFY row_number() OVER (PARTITION BY write_cursor ORDER BY landed_at DESC NULLS LAST, attr_value DESC NULLS LAST) = 1)"""


@query("projected_text", r"""WITH """ + _OWNERS + r""", docs AS (SELECT write_cursor AS id, regexp_extract_all(lower(v), '[\p{L}\p{N}]+') AS terms FROM held WHERE v IS NOT NULL),
asked AS (SELECT DISTINCT id AS qid, unnest(terms) AS term FROM docs WHERE id % 100 = 0), """ + f"{_TF}, {_bm25_sql('1.2', '0.75', _FLOORED)} {_ranked(100)}")
def _(spark, sf):
    """The owners that hold, however the name is spelled; those of cursors divisible by 100 search all of them."""
    rows = read(spark, sf, "canonical_attributes").where("write_cursor IS NOT NULL").where(plain_name(F.col("attr_name")) == "owner")
    held = latest(rows, ["write_cursor"], "attr_value", "landed_at").where("attr_value IS NOT NULL")
    docs = held.select(F.col("write_cursor").alias("id"), T.words(F.col("attr_value")).alias("terms"))
    return R.bm25_top(spark, R.postings(docs, docs.where("id % 100 = 0").withColumnRenamed("id", "qid")), 100)


@query("index_key_enrichment", "SELECT doc_id, concat_ws(' ', text, source, thread_id) AS body, strlen(concat_ws(' ', text, source, thread_id)) - strlen(coalesce(text, '')) AS added FROM documents")
def _(spark, sf):
    body = F.concat_ws(" ", "text", "source", "thread_id")
    return read(spark, sf, "documents").select("doc_id", body.alias("body"), (F.octet_length(body) - F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("added"))


@query("word_window_chunks", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i AS INTEGER) AS ord, array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ') AS chunk FROM w, unnest(range(0, CAST(greatest(ceil((len(w) - 120) / 100.0), 0) AS BIGINT) + 1)) t(i)""")
def _(spark, sf):
    chunks = T.word_windows(F.col("text"), 120, 100)
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunks).alias("ord", "chunk"))


@query("paragraph_chunks")
def _(spark, sf):
    rows = read(spark, sf, "corpus_docs").where("body IS NOT NULL").select("doc_id", "modified_at", F.posexplode(T.paragraph_chunks(F.col("body"))).alias("ord", "chunk"))
    return rows.distinct()


@query("hashed_words", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
c AS (SELECT doc_id, CAST(CAST('0x' || sha1_low AS BIGINT) % 64 AS INTEGER) AS dim, count(*) AS n FROM (SELECT doc_id, substr(sha1(t), 33, 8) AS sha1_low FROM t) GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", T.words(F.col("text"), T.HARNESS_WORD).alias("terms"))
    return T.hashed_words(d, "doc_id", "terms", 64).withColumn("value", F.round("value", 6))


# -- vectors ----------------------------------------------------------------------------------


def _vec(spark, sf):
    return vectors(spark, sf).select(F.col("write_cursor").alias("id"), "v", "label")


def _qvec(spark, sf):
    return _vec(spark, sf).where("id % 100 = 0").select(F.col("id").alias("qid"), "v", "label")


_NEAR = "near AS (SELECT q.write_cursor AS qid, m.write_cursor AS id, {} AS distance FROM vectors q, vectors m WHERE q.write_cursor % 100 = 0 {})"
_L2 = "round(list_distance(q.v, m.v), 9)"
_HAM = "CAST(list_sum(list_transform(range(1, len(m.v) + 1), lambda i: CASE WHEN (q.v[i] - {0} > 0) <> (m.v[i] - {0} > 0) THEN 1 ELSE 0 END)) AS DOUBLE)"
_NRANK = "SELECT qid, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM {}) WHERE rank <= {}"
_VMEAN = "vm AS (SELECT list(mean ORDER BY dim) AS mean FROM (SELECT dim, avg(v[dim]) AS mean FROM vectors, unnest(range(1, len(v) + 1)) t(dim) GROUP BY dim))"


def _out(df):
    return df.select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query("knn_l2_exact", f"WITH {VECTORS_SQL}, {_NEAR.format(_L2, '')} {_NRANK.format('near', 20)}")
def _(spark, sf):
    return _out(V.nearest(_vec(spark, sf), _qvec(spark, sf), 20))


@query("knn_cosine", f"WITH {VECTORS_SQL}, {_NEAR.format('round(1 - list_cosine_similarity(q.v, m.v), 9)', '')} {_NRANK.format('near', 20)}")
def _(spark, sf):
    return _out(V.nearest(_vec(spark, sf), _qvec(spark, sf), 20, "cosine"))


@query("knn_hamming", f"WITH {VECTORS_SQL}, {_NEAR.format(_HAM.format('0'), '')} {_NRANK.format('near', 192)}")
def _(spark, sf):
    return _out(V.nearest(_vec(spark, sf), _qvec(spark, sf), V.CANDIDATES, "hamming"))


@query("knn_two_phase", f"WITH {VECTORS_SQL}, {_NEAR.format(_HAM.format('0') + ' AS h, ' + _L2, '')}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS r FROM near) WHERE r <= 192) {_NRANK.format('c', 10)}")
def _(spark, sf):
    return _out(V.two_phase(_vec(spark, sf), _qvec(spark, sf), 10))


@query("knn_filtered", f"WITH {VECTORS_SQL}, {_NEAR.format(_L2, 'AND m.label IN (1, 3)')} {_NRANK.format('near', 20)}")
def _(spark, sf):
    return _out(V.nearest(_vec(spark, sf).where("label IN (1, 3)"), _qvec(spark, sf), 20))


@query("knn_mean_centred", f"WITH {VECTORS_SQL}, {_VMEAN}, near AS (SELECT q.write_cursor AS qid, m.write_cursor AS id, {_HAM.format('mean[i]')} AS distance FROM vectors q, vectors m, vm WHERE q.write_cursor % 100 = 0) {_NRANK.format('near', 50)}")
def _(spark, sf):
    v = _vec(spark, sf)
    return _out(V.nearest(v, _qvec(spark, sf), 50, "hamming", V.mean_list(v)))


@query("vector_mean", f"WITH {VECTORS_SQL} SELECT CAST(dim - 1 AS INTEGER) AS dim, round(avg(v[dim]), 9) AS mean FROM vectors, unnest(range(1, len(v) + 1)) t(dim) GROUP BY dim")
def _(spark, sf):
    return V.mean_vector(_vec(spark, sf)).select("dim", F.round("mean", 9).alias("mean"))


@query("vector_mean_pin", f"WITH {VECTORS_SQL} SELECT CAST(dim - 1 AS INTEGER) AS dim, round(avg(v[dim]), 9) AS mean FROM (SELECT * FROM vectors ORDER BY write_cursor LIMIT 256), unnest(range(1, len(v) + 1)) t(dim) GROUP BY dim")
def _(spark, sf):
    return V.mean_vector(_vec(spark, sf), 256).select("dim", F.round("mean", 9).alias("mean"))


@query("sign_bits", f"WITH {VECTORS_SQL} SELECT write_cursor AS id, len(list_filter(v, lambda x: x > 0)) AS ones FROM vectors")
def _(spark, sf):
    return _vec(spark, sf).select("id", F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("ones"))


@query("ann_recall_at_10", f"""WITH {VECTORS_SQL}, {_NEAR.format(_HAM.format('0') + ' AS h, ' + _L2, '')},
a AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS r FROM near) WHERE r <= 10),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS r FROM near) WHERE r <= 192),
b AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS r2 FROM c) WHERE r2 <= 10)
SELECT a.qid, round(count(b.id) / 10.0, 6) AS recall FROM a LEFT JOIN b USING (qid, id) GROUP BY a.qid""")
def _(spark, sf):
    exact = V.nearest(_vec(spark, sf), _qvec(spark, sf), 10).select("qid", "id")
    found = V.two_phase(_vec(spark, sf), _qvec(spark, sf), 10).select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.round(F.count("hit") / 10, 6).alias("recall"))


@query("ann_recall_floor", """WITH q AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL)
SELECT n AS queries, true AS clears_floor FROM q""")
def _(spark, sf):
    """Two-phase search with as many candidates as a sample of the rows needs; its recall at 10 over the query set against the floor."""
    v, q = _vec(spark, sf), _qvec(spark, sf)
    size = V.candidates_for(v, v.where("id % 100 = 50").select(F.col("id").alias("qid"), "v"), 10)
    exact = V.nearest(v, q, 10).select("qid", "id")
    found = V.two_phase(v, q, 10, candidates=size).select("qid", "id", F.lit(1).alias("hit"))
    each = exact.join(found, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("queries"), (F.avg("r") >= 0.9).alias("clears_floor"))


_STEP = """a{0} AS (SELECT write_cursor, v, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT write_cursor, vectors.v, cluster, round(list_distance(vectors.v, c{0}.v), 9) AS d FROM vectors, c{0}) GROUP BY write_cursor, v),
c{1} AS (SELECT cluster, list(x ORDER BY dim) AS v FROM (SELECT cluster, dim, avg(v[dim]) AS x FROM a{0}, unnest(range(1, len(v) + 1)) t(dim) GROUP BY cluster, dim) GROUP BY cluster)"""


@query("kmeans_lloyd", f"WITH {VECTORS_SQL}, c0 AS (SELECT write_cursor AS cluster, v FROM vectors WHERE write_cursor < 10), {', '.join(_STEP.format(i, i + 1) for i in range(4))} SELECT write_cursor AS id, cluster FROM a3")
def _(spark, sf):
    v = _vec(spark, sf)
    return V.lloyd(v, v.where("id < 10").select(F.col("id").alias("cluster"), "v"), 3)


# -- fusion -----------------------------------------------------------------------------------

_ARMS = f"""{_DOCS}, {_ASKED}, {_TF}, {_bm25_sql('1.2', '0.75', _FLOORED)}, {VECTORS_SQL}, {_NEAR.format(_L2, '')},
body AS (SELECT doc_id AS id, coalesce(text, '') AS key FROM documents),
vr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM near),
tr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored),
varm AS (SELECT qid, key, min((rank, id)) AS b FROM vr JOIN body USING (id) WHERE rank <= 100 GROUP BY ALL),
tarm AS (SELECT qid, key, min((rank, id)) AS b FROM tr JOIN body USING (id) WHERE rank <= 100 GROUP BY ALL)"""


def _fused_sql(k: float, wv: float, wt: float) -> str:
    return f"""{_ARMS}, p AS (SELECT qid, key, 0 AS arm, b[1] AS r, b[2] AS id, {wv} AS w FROM varm UNION ALL SELECT qid, key, 1, b[1], b[2], {wt} FROM tarm),
g AS (SELECT qid, key, round(sum(w / ({k} + r)), 9) AS score, min((arm, r, id)) AS s, min(r) FILTER (arm = 0) AS vector_rank, min(r) FILTER (arm = 1) AS text_rank FROM p GROUP BY qid, key),
fused AS (SELECT qid, key, s[3] AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, s[1], s[2], s[3]) AS rank, vector_rank, text_rank FROM g)"""


def _bodies(spark, sf):
    """(id, key): what is fused is a document's text, by its digest, so that no shuffle carries texts."""
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))


def _arm_rows(spark, sf):
    body = _bodies(spark, sf)
    near = V.nearest(_vec(spark, sf), _qvec(spark, sf), 100).select("qid", "id", "rank")
    lexical = R.bm25_top(spark, R.postings(_docs(spark, sf), _asked(spark, sf)), 100).select("qid", "id", "rank")
    return near.join(body, "id"), lexical.join(body, "id")


def _fused(spark, sf, k=FU.RRF_K, wv=FU.ARM_WEIGHTS["vector"], wt=FU.ARM_WEIGHTS["text"]):
    near, lexical = _arm_rows(spark, sf)
    return FU.rrf([FU.Arm("vector", near, wv), FU.Arm("text", lexical, wt)], k)


_PLAIN = "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(text_rank AS INTEGER) AS text_rank FROM fused"


@query("rrf_two_arm", f"WITH {_fused_sql(30.0, 1.0, 3.0)} {_PLAIN}")
def _(spark, sf):
    return _fused(spark, sf).drop("key")


@query("rrf_harness", f"WITH {_fused_sql(60.0, 1.0, 1.0)} {_PLAIN}")
def _(spark, sf):
    return _fused(spark, sf, FU.HARNESS_K, 1.0, 1.0).drop("key")


@query("hybrid_search", f"WITH {_fused_sql(30.0, 1.0, 3.0)} {_PLAIN} WHERE rank <= 10")
def _(spark, sf):
    """Lexical and vector arms, fused; the first ten of each query, with the place each arm gave them."""
    return _fused(spark, sf).drop("key").where("rank <= 10")


@query("recency_reweight", f"""WITH {_fused_sql(30.0, 1.0, 3.0)}, r AS (SELECT qid, id, rank AS r0, round(score + 0.002 * CASE WHEN max(id) OVER q > min(id) OVER q
  THEN (id - min(id) OVER q) / (max(id) OVER q - min(id) OVER q) ELSE 0 END, 9) AS score FROM fused WINDOW q AS (PARTITION BY qid))
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0) AS INTEGER) AS rank FROM r""")
def _(spark, sf):
    return FU.recency(_fused(spark, sf), "id").select("qid", "id", "score", "rank")


_IMP = "imp AS (SELECT write_cursor AS id, max(importance) AS importance FROM canonical_nodes GROUP BY write_cursor)"


@query("importance_reweight", f"""WITH {_fused_sql(30.0, 1.0, 3.0)}, {_IMP}, r AS (SELECT qid, id, rank AS r0, round(score * coalesce(importance, 1.0), 9) AS score FROM fused LEFT JOIN imp USING (id))
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0) AS INTEGER) AS rank FROM r""")
def _(spark, sf):
    imp = nodes(spark, sf).groupBy(F.col("write_cursor").alias("id")).agg(F.max("importance").alias("importance"))
    hits = _fused(spark, sf).join(imp, "id", "left").withColumn("confidence", F.lit(None).cast("double"))
    return FU.importance(hits).select("qid", "id", "score", "rank")


@query("ce_blend", f"""WITH {_fused_sql(30.0, 1.0, 3.0)}, x AS (SELECT *, rank <= 50 AS inside, (id % 13) / 3.0 - 2 AS logit FROM fused),
y AS (SELECT *, min(CASE WHEN inside THEN score END) OVER q AS lo, max(CASE WHEN inside THEN score END) OVER q AS hi FROM x WINDOW q AS (PARTITION BY qid)),
z AS (SELECT qid, id, rank, inside, CASE WHEN inside THEN round(0.3 * (1 / (1 + exp(-logit))) + (1 - 0.3) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 9) END AS ce_score FROM y)
SELECT qid, id, round(ce_score, 6) AS ce_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, ce_score DESC NULLS LAST, rank) AS INTEGER) AS rank FROM z""")
def _(spark, sf):
    hits = _fused(spark, sf).withColumn("logit", (F.col("id") % 13) / 3.0 - 2)
    return FU.rerank_blend(hits, "logit", 50).select("qid", "id", (F.round(F.col("ce_score") * 1e6) / 1e6).alias("ce_score"), "rank")


@query("fused_rerank", f"""WITH {_fused_sql(60.0, 1.0, 1.0)}, x AS (SELECT *, rank <= 20 AS inside, (id % 13) / 3.0 - 2 AS logit FROM fused),
y AS (SELECT *, min(CASE WHEN inside THEN score END) OVER q AS lo, max(CASE WHEN inside THEN score END) OVER q AS hi FROM x WINDOW q AS (PARTITION BY qid)),
z AS (SELECT qid, id, rank, inside, CASE WHEN inside THEN round(0.3 * (1 / (1 + exp(-logit))) + (1 - 0.3) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 9) END AS ce_score FROM y)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, ce_score DESC NULLS LAST, rank) AS INTEGER) AS rank, CAST(rank AS INTEGER) AS fused_rank FROM z""")
def _(spark, sf):
    """The fused pool of the evaluation arms, its first twenty put in order by a reranker, the rest after them as they were."""
    near, lexical = _arm_rows(spark, sf)
    logit = lambda hits: hits.withColumn("logit", (F.col("id") % 13) / 3.0 - 2)
    return FU.fused_rerank([FU.Arm("vector", near), FU.Arm("text", lexical)], logit, 20).select("qid", "id", "rank", "fused_rank")


@query("passage_pooling", """WITH p AS (SELECT query_id AS qid, doc_id AS doc, ce_norm AS score FROM pool WHERE query_id IS NOT NULL AND ce_norm IS NOT NULL AND NOT isnan(ce_norm)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC) AS n FROM p)
SELECT qid, doc, round(max(score), 9) AS best, round(avg(score), 9) AS mean, round(avg(score) FILTER (n <= 2), 9) AS top2 FROM r GROUP BY qid, doc""")
def _(spark, sf):
    p = read(spark, sf, "pool").where("query_id IS NOT NULL AND ce_norm IS NOT NULL AND NOT isnan(ce_norm)").select(
        F.col("query_id").alias("qid"), F.col("doc_id").alias("doc"), F.col("ce_norm").alias("score")
    )
    parts = [FU.pooled(p, h).select("qid", "doc", F.col("score").alias(n)) for h, n in (("max", "best"), ("mean", "mean"), ("top2", "top2"))]
    return parts[0].join(parts[1], ["qid", "doc"]).join(parts[2], ["qid", "doc"])


# -- nodes and facts together, three arms, clusters ---------------------------------------------

_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_ONE = ["calendar", "archive", "click", "topic"]


def _single_sql(name: str, rows: str) -> str:
    """CTEs that score rows (id, body) for the one query."""
    return f"""{name}d AS (SELECT id, body, {_WORDS.format('body')} AS terms FROM ({rows})),
{name}s AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM {name}d), {name}o AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM {name}d),
{name}t AS (SELECT id, dl, term, count(*) AS tf FROM {name}o WHERE term IN (SELECT term FROM one) GROUP BY ALL), {name}f AS (SELECT term, count(*) AS df FROM {name}t GROUP BY term),
{name}r AS (SELECT id, body, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(sum({_FLOORED} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM {name}t JOIN {name}f USING (term), {name}s GROUP BY id) JOIN {name}d USING (id))"""


@query("text_only", f"""WITH {EDGES_SQL}, one AS (SELECT unnest({_ONE}) AS term),
{_single_sql('n', "SELECT DISTINCT write_cursor AS id, body FROM canonical_nodes WHERE superseded_at IS NULL AND state = 'active'")},
{_single_sql('e', "SELECT write_cursor AS id, body FROM edges WHERE superseded_at IS NULL")},
u AS (SELECT 'text' AS branch, id, body, rank FROM nr WHERE rank <= 100 UNION ALL SELECT 'text_edge', id, body, rank + least(100, (SELECT count(*) FROM nr)) FROM er),
b AS (SELECT body, min(rank) AS r, arg_min(id, rank) AS id, arg_min(branch, rank) AS branch FROM u GROUP BY body)
SELECT id, branch, round(1 / (30.0 + r), 9) AS score, CAST(p AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY r) AS p FROM b) WHERE p <= 100""")
def _(spark, sf):
    """Current nodes, at most 100, then all matching facts; one row per body; the first 100."""
    asked = spark.createDataFrame([(1, _ONE)], "qid int, terms array<string>")
    n = nodes(spark, sf).where(ReadView().existence()).select(F.col("write_cursor").alias("id"), "body").distinct()
    e = edges(spark, sf).where("superseded_at IS NULL").select(F.col("write_cursor").alias("id"), "body")
    parts = []
    for rows, branch in ((n, "text"), (e, "text_edge")):
        hits = T.bm25(rows.select("id", T.words(F.col("body")).alias("terms")), asked).join(rows.withColumnRenamed("body", "key"), "id")
        parts.append(hits.withColumn("branch", F.lit(branch)))
    first = T.top(parts[0], 100)
    last = first.count()  # at most 100
    # All matching facts have a place in the list, so their ranks come from a range sort, not from one task.
    facts = positions(parts[1], "qid", [F.col("score").desc(), F.col("id")], "rank").withColumn("rank", (F.col("rank") + last).cast("int"))
    rows = first.unionByName(facts).groupBy("qid", "key").agg(F.min(F.struct("rank", "id", "branch")).alias("b"))
    ranked = T.top(rows.select("qid", F.col("b.rank").alias("r"), "b.id", "b.branch"), 100, order=(F.col("r"),))
    return ranked.select("id", "branch", F.round(1 / (30.0 + F.col("r")), 9).alias("score"), "rank")


@query("rrf_three_arm", f"""WITH {_ARMS}, hnear AS (SELECT q.write_cursor AS qid, m.write_cursor AS id, {_HAM.format('0')} AS distance FROM vectors q, vectors m WHERE q.write_cursor % 100 = 0),
hr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM hnear),
harm AS (SELECT qid, key, min((rank, id)) AS b FROM hr JOIN body USING (id) WHERE rank <= 100 GROUP BY ALL),
p AS (SELECT qid, key, 0 AS arm, b[1] AS r, b[2] AS id, 1.0 AS w FROM varm UNION ALL SELECT qid, key, 1, b[1], b[2], 3.0 FROM tarm UNION ALL SELECT qid, key, 2, b[1], b[2], 1.0 FROM harm),
g AS (SELECT qid, key, round(sum(w / (30.0 + r)), 9) AS score, min((arm, r, id)) AS s FROM p GROUP BY qid, key)
SELECT qid, s[3] AS id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, s[1], s[2], s[3]) AS INTEGER) AS rank FROM g""")
def _(spark, sf):
    near, lexical = _arm_rows(spark, sf)
    bits = V.nearest(_vec(spark, sf), _qvec(spark, sf), 100, "hamming").select("qid", "id", "rank").join(_bodies(spark, sf), "id")
    return FU.rrf([FU.Arm("vector", near, 1.0), FU.Arm("text", lexical, 3.0), FU.Arm("bits", bits, 1.0)]).select("qid", "id", "score", "rank")


@query("coverage_clusters", f"WITH {VECTORS_SQL}, c0 AS (SELECT write_cursor AS cluster, v FROM vectors WHERE write_cursor < 10), {', '.join(_STEP.format(i, i + 1) for i in range(4))}, "
       "near AS (SELECT q.write_cursor AS qid, c4.cluster AS id, round(1 - list_cosine_similarity(q.v, c4.v), 9) AS distance FROM vectors q, c4 WHERE q.write_cursor % 100 = 0) " + _NRANK.format("near", 3))
def _(spark, sf):
    """The three clusters whose summary vector is nearest to each query."""
    v = _vec(spark, sf)
    found = V.lloyd(v, v.where("id < 10").select(F.col("id").alias("cluster"), "v"), 3)
    means = found.join(v, "id").select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
    summaries = means.groupBy(F.col("cluster").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    return _out(V.nearest(summaries, _qvec(spark, sf), 3, "cosine"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
