import json

import pytest
from pyspark.sql import functions as F

from lorespark.engine import Engine, ProjectionSpec
from lorespark.errors import (
    CollectionError, DenseUnavailableError, IllegalTransitionError, InvalidFilterError, InvalidLimitError, NotLifecycleAddressableError,
    ProjectionError, WriteValidationError,
)
from lorespark.operators.predicates import Filter, Predicate, ReadView, SearchFilter, Term
from lorespark.runtime import scratch_path


@pytest.fixture()
def engine(spark):
    return Engine.open(spark, scratch_path(spark, "engine"), clock=lambda: 1_500)


def node(logical_id, body, kind="note", source="src:a", **more):
    return {"kind": kind, "body": body, "source_id": source, "logical_id": logical_id, **more}


def test_write_supersede_read(engine):
    out = engine.write([node("a", {"status": "open", "priority": 3}), node("b", "plain text"), node("a", {"status": "done", "priority": True})])
    assert out["cursors"] == [1, 2, 3]
    assert json.loads(engine.read.get("a").body)["status"] == "done"
    assert engine.read.get("zz") is None
    assert [r and r.logical_id for r in engine.read.get_many(["b", "x", "a", "b"])] == ["b", None, "a", "b"]
    assert engine.read.list("note", [Predicate("$.status", "eq", "done")]).count() == 1
    assert engine.read.list("note", [Predicate("$.priority", "gte", 1)]).count() == 0  # true is no number
    assert engine.read.list("note", view=ReadView(include_superseded=True)).count() == 3
    assert engine.read.list("note", filter=Filter((Term("Kind", "task"),))).count() == 0
    with pytest.raises(InvalidFilterError):
        engine.read.list("note", [Predicate("$.secret", "eq", "x")])
    with pytest.raises(ValueError):
        engine.read.get("")


def test_a_bad_item_stops_the_whole_batch(engine):
    bad = [
        {"kind": "note", "source_id": ""}, {"kind": "note", "source_id": "_x"}, {"kind": "", "source_id": "s"}, node("a", "x", valid_from=5, valid_until=5),
        node("a", "x", valid_from=True), node("a", "x", state="deleted"), node("a", "x", importance=2), {"type": "edge", "kind": "k", "from": "a", "source_id": "s"},
        {"type": "nothing"}, "text",
    ]
    for item in bad:
        with pytest.raises(WriteValidationError):
            engine.write([node("ok", "fine"), item])
    assert engine.read.get("ok") is None


def test_lifecycle(engine):
    engine.write([node("a", "alpha", state="pending"), {"type": "edge", "kind": "knows", "from": "a", "to": "b", "source_id": "s"}])
    assert engine.read.get("a") is None
    engine.transition("a", "active")
    assert engine.read.get("a").state == "active"
    with pytest.raises(IllegalTransitionError):
        engine.transition("a", "pending")
    with pytest.raises(IllegalTransitionError):
        engine.purge("a")
    for wrong in ("h:abc", "nobody"):
        with pytest.raises(NotLifecycleAddressableError):
            engine.transition(wrong, "active")
    engine.transition("a", "deleted", "obsolete")
    assert engine.read.get("a", ReadView(include_inactive=True)).reason == "obsolete"
    assert engine.purge("a") and not engine.purge("a")
    assert engine.nodes().count() == 0 and engine.edges().count() == 0


def test_erase_source(engine):
    engine.configure_projections([ProjectionSpec("status")])
    engine.write([node("a", {"status": "x"}, source="s1"), node("b", {"status": "y"}, source="s2"), node("a", {"status": "z"}, source="s1")])
    engine.drain()
    engine.erase_source("s1")
    engine.erase_source("s1")
    assert [r.logical_id for r in engine.nodes().collect()] == ["b"]
    assert engine.store.table("attributes").count() == 1 and engine.store.table("vectors").count() == 1
    with pytest.raises(ValueError):
        engine.erase_source("_legacy")


def test_hybrid_search(engine):
    engine.configure_projections([ProjectionSpec("status", ("filterable", "searchable"))])
    engine.write([
        node("a", {"text": "quarterly budget reviewed by finance", "status": "open"}), node("b", {"text": "travel plan for spring"}, importance=0.1),
        node("c", {"text": "the budget and travel budgets"}, kind="doc"), node("old", {"text": "budget"}, valid_until=1_000),
        {"type": "edge", "kind": "about", "from": "a", "to": "b", "source_id": "s", "body": "the budget covers travel"},
        {"type": "edge", "kind": "about", "from": "a", "to": "c", "source_id": "s", "body": "budget expired", "t_invalid": 1_200},
    ])
    engine.drain()
    got = engine.search("What of the budgets?", limit=5, explain=True).rows()
    assert [r.rank for r in got] == list(range(1, len(got) + 1))
    ids = [r.stable_id.value for r in got]
    assert {"a", "c"} <= set(ids) and "old" not in ids
    assert any(r.kind == "edge_fact" for r in got) and not any("expired" in r.body for r in got)
    assert all(r.source_id for r in got)
    assert [r.stable_id.value for r in engine.search("budget", SearchFilter(kind="doc")).rows()] == ["c"]
    assert [r.stable_id.value for r in engine.search("budget", SearchFilter(attributes=(("status", "open"),))).rows()] == ["a"]
    assert engine.search("budget", SearchFilter(status="open")).rows() == []
    with pytest.raises(InvalidFilterError):
        engine.search("budget", SearchFilter(attributes=(("nothing", "x"),)))
    with pytest.raises(InvalidFilterError):
        engine.search("budget", Filter((Term("Json", Predicate("$.status", "eq", "x")),)))
    for limit in (0, 101, True, "5"):
        with pytest.raises(InvalidLimitError):
            engine.search("budget", limit=limit)
    long = [r.id for r in engine.search_text_only("budget travel", limit=4).rows()]
    for k in (1, 2, 3):
        assert [r.id for r in engine.search_text_only("budget travel", limit=k).rows()] == long[:k]
    assert [r.id for r in engine.search_projected_text("status", "open").collect()] == [1]
    ranks = [engine.bm25f_search("doc", {"kind": w, "body": 1.0}).count() for w in (0.0, 8.0)]
    assert ranks == [1, 1]
    expanded = {r.id: r.hop for r in engine.graph.search_expand("quarterly finance", 1, 1).collect()}
    assert expanded == {"a": 0, "b": 1}
    with_graph = engine.search("quarterly finance", graph_arm=True, limit=10).rows()
    assert "b" in [r.stable_id.value for r in with_graph]


def test_neighbours_need_visible_nodes(engine):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "gone")]
    engine.write([node(x, x) for x in "abcd"] + [{"type": "edge", "kind": "k", "from": f, "to": t, "source_id": "s"} for f, t in edges])
    assert {r.id: r.hop for r in engine.graph.neighbors("a", 3).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.id for r in engine.graph.neighbors("a", 1, "incoming").collect()} == {"c"}
    engine.transition("b", "deleted")
    assert engine.graph.neighbors("a", 3).collect() == []
    for depth in (0, 4):
        with pytest.raises(InvalidLimitError):
            engine.graph.neighbors("a", depth)


def test_projections(engine):
    engine.write([node("a", {"x": 1, "y": "t", "z": {"deep": True}, "n": None, "l": [1]})])
    nested = ProjectionSpec("deep", path="$.z.deep")
    assert engine.configure_projections([ProjectionSpec("x"), nested, ProjectionSpec("n"), ProjectionSpec("l"), ProjectionSpec("z")])["built"] == ["x", "deep", "n", "l", "z"]
    assert sorted((r.attr_name, r.attr_value) for r in engine.store.table("attributes").collect()) == [("deep", "true"), ("x", "1")]
    assert engine.configure_projections([ProjectionSpec("x")])["unchanged"] == ["x"]
    with pytest.raises(ProjectionError):
        engine.configure_projections([ProjectionSpec("x", ("searchable",))])
    assert engine.configure_projections([ProjectionSpec("x", ("searchable",))], drop=("x", "l"))["dropped"] == ["l"]
    status = engine.read.projection_status()
    assert status["dense"] == "embedding" and engine.drain() == 1 and engine.read.projection_status()["dense"] == "ready"


def test_op_store(engine):
    schema = json.dumps({"type": "object", "required": ["name", "count"], "properties": {"count": {"type": "integer", "minimum": 2}}})
    engine.admin.configure("jobs", "append_only_log", schema)
    with pytest.raises(CollectionError):
        engine.admin.configure("bad", "append_only_log", '{"$ref": "http://x"}')
    item = {"type": "op_store", "collection": "jobs", "record_key": "k"}
    for body in ({"name": "x"}, {"name": "x", "count": 1}, {"name": "x", "count": True}):
        with pytest.raises(WriteValidationError):
            engine.write([{**item, "body": {"name": "ok", "count": 5}}, {**item, "body": body}])
    engine.write([{**item, "body": {"name": "x", "count": n}} for n in (2, 3)])
    assert engine.read.collection("jobs", -5, 10).count() == 2 and engine.read.collection("jobs", 0, 0).count() == 0
    assert json.loads(engine.read.latest_state().first().payload_json)["count"] == 3
    page = engine.admin.dump_mutations("jobs", 0, 1)
    assert page["next_after_id"] == page["rows"][0].id
    engine.admin.excise_record("jobs", "k")
    assert engine.read.collection("jobs").count() == 0


def test_no_embedder(spark):
    engine = Engine.open(spark, scratch_path(spark, "engine"), use_default_embedder=False, clock=lambda: 1)
    engine.write([node("a", "hello world")])
    with pytest.raises(DenseUnavailableError):
        engine.search("hello")
    assert [r.stable_id.value for r in engine.search_text_only("hello").rows()] == ["a"]


def test_extractor_and_consolidation(engine, spark):
    def provider(doc, body):
        for line in body.splitlines():
            who, what, when = line.split(";")
            yield {"from_kind": "person", "from_name": who, "to_kind": "org", "to_name": what, "kind": "works_for", "body": line,
                   "t_valid": when or None, "t_invalid": None, "confidence": 0.9, "model": "m"}

    docs = spark.createDataFrame([("d1", "Bob;Acme;2020-01-01\nBob;Acme;2020-01-01"), ("d2", "bob;Beta;2022-01-01T00:00:00Z")], "source_doc_id string, body string")
    assert engine.ingest_with_extractor(docs, provider) == {"nodes": 3, "edges": 2}
    engine.consolidate_with_provider()
    ended = {r.body: r.t_invalid for r in engine.edges().collect()}
    assert ended == {"Bob;Acme;2020-01-01": 1640995200, "bob;Beta;2022-01-01T00:00:00Z": None}
    with pytest.raises(WriteValidationError):
        engine.ingest_with_extractor(spark.createDataFrame([("d3", "Bob;Acme;yesterday")], docs.schema), provider)


def test_admin(engine):
    engine.write([node("a", "x", source="s1"), {"type": "edge", "kind": "k", "from": "a", "to": "nobody", "source_id": "s1"}])
    assert {r.check: r.findings for r in engine.admin.check_integrity().collect()}["dangling_endpoint"] == 1
    assert {r.name: r.rows for r in engine.admin.dump_row_counts().collect()}["nodes"] == 1
    assert [r.write_cursor for r in engine.admin.trace("s1").collect()] == [1, 2]
    engine.drain()
    engine.admin.recompute_mean()
    probes = ["one two", "three"]
    assert engine.admin.verify_embedder(probes, [engine.embed(p) for p in probes])["equivalent"]
    assert engine.report()["embedder"] == "hashing-64"


class _Points:
    """Embeds a text of numbers as those numbers."""

    identity, dim = "points-2", 2

    def embed(self, value):
        return [float(x) for x in value.split()]

    def column(self, name):
        return F.transform(F.split(name, " "), lambda x: x.cast("double"))


def test_search_keeps_a_near_row_behind_many_of_equal_signs(spark):
    """One row lies closest but differs in a sign; 200 far ones have the query's signs and would fill a fixed list of candidates."""
    engine = Engine.open(spark, scratch_path(spark, "engine"), embedder=_Points(), clock=lambda: 1_500)
    engine.write([node(f"far{i}", f"{50 + i} {50 + i}") for i in range(200)] + [node("near", "1 -0.01")])
    engine.drain()
    got = engine.search("1 0.01", limit=3)
    first = got.arms["vector"].where("rank = 1").first()
    assert first.key == "1 -0.01" and got.arms["vector"].count() == 100


def _stored_text(engine):
    """Every value of every stored table, as text."""
    return {n: "\n".join(str(r) for r in engine.store.table(n).collect()) for n in engine.admin.dump_schema() if n != "audit"}


def test_erasure_leaves_no_trace(engine, spark):
    engine.configure_projections([ProjectionSpec("status", ("filterable", "searchable"))])
    engine.write([
        node("secretid", {"text": "zephyr plan", "status": "x"}, source="s1"), node("other", {"text": "zephyr notes", "status": "y"}, source="s2"),
        {"type": "edge", "kind": "about", "from": "other", "to": "secretid", "source_id": "s1", "body": "zephyr fact"},
    ])
    engine.transition("secretid", "deleted", "secretreason")
    engine.transition("secretid", "active")
    engine.drain()
    engine.enable_telemetry()
    assert len(engine.search("zephyr").rows()) == 3
    engine._flush()
    engine.search("zephyr")
    engine.record_feedback("q0-0", {1: 1, 2: 0}, "user")
    engine.erase_source("s1")
    assert [r.id for r in engine.search("zephyr").rows()] == [2]
    events = engine.disable_telemetry()
    assert [e["query_id"] for e in events] == ["q0-0", "q0-1", "q0-0", "q0-3"] and [e.get("result_ids") for e in events] == [[2], [2], None, [2]]
    assert events[2]["labels"] == {2: 0}
    stored = _stored_text(engine)
    assert not any("secret" in t for t in stored.values())
    for name in ("attributes", "vectors", "postings", "lengths"):
        assert {r.write_cursor for r in engine.store.table(name).select("write_cursor").collect()} == {2}
    files = [p.read_bytes() for p in __import__("pathlib").Path(engine.store.path).rglob("*.parquet") if "/audit/" not in str(p)]
    assert files and not any(b"secretid" in f or b"secretreason" in f for f in files)


def test_bulk_writes_are_checked_like_single_ones(engine, spark):
    good = spark.createDataFrame([("note", '{"ok": true, "n": 1}', "s", 0.5, 1, 2)], "kind string, body string, source_id string, importance double, valid_from bigint, valid_until bigint")
    for wrong in (
        good.withColumn("importance", F.lit(5.0)), good.withColumn("importance", F.lit(float("nan"))), good.withColumn("valid_from", F.lit("1")),
        good.withColumn("valid_from", F.lit(2)), good.withColumn("source_id", F.lit("_x")), good.withColumn("importance", F.lit("0.5")),
    ):
        with pytest.raises(WriteValidationError):
            engine.write_frame("nodes", wrong)
    with pytest.raises(WriteValidationError):
        engine.write_frame("edges", good.select("kind", "source_id", F.lit("a").alias("from_id"), F.lit("b").alias("to_id"), F.lit(1.5).alias("confidence")))
    engine.configure_projections([ProjectionSpec("ok"), ProjectionSpec("n")])
    assert engine.write_frame("nodes", good.withColumn("valid_until", F.lit(9_999))) == 1
    for value in (True, "true"):
        assert engine.search("ok", SearchFilter(attributes=(("ok", value),))).hits.count() == 1
    assert engine.search("ok", SearchFilter(attributes=(("ok", False),))).hits.count() == 0
    trace = engine.search("ok", SearchFilter(kind="note"), explain=True).trace
    assert trace["filter"] == {"kind": "note"} and trace["arms"] == {"vector": 1.0, "text": 3.0} and trace["vector"] == "exact"


class _Failing(_Points):
    """No vector for texts that begin with x."""

    def column(self, name):
        return F.when(~F.col(name).startswith("x"), F.array(F.lit(1.0), F.lit(2.0)))


def test_failed_embeddings_are_recorded_and_vectors_need_a_role(spark):
    engine = Engine.open(spark, scratch_path(spark, "engine"), embedder=_Failing(), clock=lambda: 1_500)
    engine.write([node("a", "x1"), node("b", "1 2"), {"type": "edge", "kind": "knows", "from": "a", "to": "b", "source_id": "s", "body": "fact of b"},
                  {"type": "edge", "kind": "likes", "from": "a", "to": "b", "source_id": "s", "body": "fact of a"}])
    engine.configure_projections([ProjectionSpec("v", ("filterable",), vector=True)])
    assert engine.drain(waits=(0,)) == 0  # declared, but not searchable: nothing is embedded
    engine.configure_projections([ProjectionSpec("v", ("searchable",), vector=True)], drop=("v",))
    assert engine.drain(waits=(0,)) == 1 and engine.drain(waits=()) == 0
    assert [tuple(r) for r in engine.store.table("projection_failures").collect()] == [(1, "embedder", 1_500)]
    facts = lambda f: sorted(r.kind for r in engine._facts(f, engine.store.manifest(), 1_500).select("kind").collect())
    assert facts(None) == ["knows", "likes"] and facts(SearchFilter(kind="likes")) == ["likes"] and facts(SearchFilter(source_type="edge_fact")) == ["knows", "likes"]
    assert facts(SearchFilter(created_after=1)) == facts(SearchFilter(source_type="note")) == facts(SearchFilter(attributes=(("v", "1"),))) == []
