"""Every core query against its SQL over the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import connect, rows  # noqa: E402

from lorespark.plans import catalog  # noqa: E402

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf) -> duckdb.DuckDBPyConnection:
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_are_known():
    """p2_wide has SQL with its days as text (p2_wide_text); the two PageRanks are tested in test_operators."""
    assert sorted(set(QUERIES) - set(SQL)) == ["bootstrap_means", "p2_wide", "paragraph_chunks", "ppr_converged", "ppr_passages"]


def test_paragraph_chunks_against_plain_packing(spark, sf):
    def packed(text, limit=6_000):
        done, now = [], None
        for paragraph in text.split("\n\n"):
            for piece in [paragraph[k : k + limit] for k in range(0, len(paragraph), limit)] or [""]:
                if now is None:
                    now = piece
                elif len(now) + len(piece) + 2 <= limit:
                    now += "\n\n" + piece
                else:
                    done, now = [*done, now], piece
        return [x for x in [*done, now] if x.strip(" ")]

    rows = spark.read.parquet(f"{sf}/corpus_docs.parquet").where("body IS NOT NULL").select("doc_id", "modified_at", "body").collect()
    want = {(r.doc_id, r.modified_at, k, chunk) for r in rows for k, chunk in enumerate(packed(r.body))}
    got = [tuple(r) for r in QUERIES["paragraph_chunks"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bootstrap_means_lie_about_the_mean(spark, sf):
    """Each interval holds the mean and is as wide as the normal one, to a tenth; the same rows give the same interval."""
    got = {r.event_type: r for r in QUERIES["bootstrap_means"](spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    for kind, values in events.groupby("event_type").value:
        r, error = got[kind], 1.96 * values.std() / len(values) ** 0.5
        assert r.n == len(values) and abs(r["mean"] - values.mean()) < 1e-9 and r.low < r["mean"] < r.high
        assert abs((r.high - r.low) / (2 * error) - 1) < 0.1
    assert got == {r.event_type: r for r in QUERIES["bootstrap_means"](spark, sf).collect()}


def test_p2_wide_has_the_declared_types(spark, sf):
    kinds = dict(QUERIES["p2_wide"](spark, sf).dtypes)
    assert len(kinds) == 16 and {kinds[c] for c in ("priority", "due_on", "score", "reviewed", "status")} == {"bigint", "date", "double", "boolean", "string"}


def test_knn_filter_is_below_the_cut(spark, sf):
    """A filter on the rows reaches the scan; it is never applied to the k that were kept."""
    from lorespark.plans.retrieval_queries import Q

    plan = Q["knn_filtered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow") < plan.index("In(label")
