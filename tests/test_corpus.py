import sys

import pytest

from lorespark.errors import ProviderError
from lorespark.operators.providers import command_extractor, run_extractor
from lorespark.runtime import scratch_path
from lorespark.schema import CORPUS, struct
from lorespark.sources import corpus as C


def test_jsonl_round_trip_and_freezing(spark, sf):
    docs = spark.read.parquet(f"{sf}/corpus_docs.parquet")
    path = scratch_path(spark, "corpus")
    C.write_jsonl(docs, path)
    back = C.read_jsonl(spark, path)
    assert back.schema.simpleString() == struct(CORPUS).simpleString()
    frozen = C.freeze(docs)
    assert C.differences(C.freeze(back), frozen).collect() == []
    assert C.differences(C.freeze(back.unionAll(back).repartition(7)), frozen).collect() == []  # neither order nor repetition matters
    one = docs.where("body IS NOT NULL").select("doc_id").first().doc_id
    changed = C.differences(C.freeze(docs.where(docs.doc_id != one)), frozen).collect()
    assert len(changed) == 1 and changed[0].found == changed[0].expected - 1 or changed[0].found < changed[0].expected


def test_lines_are_deterministic(spark):
    df = spark.createDataFrame([(1, None, "é")], "b int, a string, c string")
    row = C.json_lines(df).first()
    assert row.line == '{"a":null,"b":1,"c":"é"}' and len(row.sha256) == 64


@pytest.mark.parametrize("kind", sorted(C.CONNECTORS))
def test_connectors_give_the_corpus_schema(spark, kind):
    mapping = C.CONNECTORS[kind]
    columns = sorted(set(mapping.values()) - {mapping["created_at"]})  # an upstream table may lack a column
    df = spark.createDataFrame([tuple(f"{c} value" for c in columns)], ", ".join(f"`{c}` string" for c in columns))
    out = C.connect(df, kind, "upstream", "CC-BY-4.0")
    row = out.first()
    assert out.columns == [f.name for f in struct(CORPUS)]
    assert row.source_type == kind and row.title == f"{mapping['title']} value" and row.created_at is None and len(row.doc_id) == 16


def test_command_extractor():
    program = (
        "import sys, json\n"
        "lines = [json.loads(x) for x in sys.stdin]\n"
        "print(json.dumps({'type': 'ready'}))\n"
        "print(json.dumps({'type': 'result', 'request_id': lines[1]['request_id'], 'edges': [{'body': lines[1]['body']}]}))\n"
    )
    assert list(command_extractor([sys.executable, "-c", program])("d1", "hello")) == [{"body": "hello"}]
    with pytest.raises(ProviderError):
        list(command_extractor([sys.executable, "-c", "print('{}')"])("d1", "x"))
    wrong = program.replace("lines[1]['request_id']", "'other'")
    with pytest.raises(ProviderError):
        list(command_extractor([sys.executable, "-c", wrong])("d1", "x"))


def test_one_process_serves_many_documents(spark):
    program = (
        "import json, os, sys\n"
        "for line in sys.stdin:\n"
        "    m = json.loads(line)\n"
        "    if m['type'] == 'hello': print(json.dumps({'type': 'ready'}))\n"
        "    else: print(json.dumps({'type': 'result', 'request_id': m['request_id'], 'edges': [{'body': m['body'], 'model': str(os.getpid())}]}))\n"
    )
    docs = spark.createDataFrame([("d1", "a"), ("d2", None), ("d1", "b")], "source_doc_id string, body string").coalesce(1)
    got = run_extractor(docs, command_extractor([sys.executable, "-c", program]), "source_doc_id string, body string, model string").collect()
    assert sorted((r.source_doc_id, r.body) for r in got) == [("d1", "a"), ("d1", "b"), ("d2", "")]
    assert len({r.model for r in got}) == 1
    silent = "print('{\"type\": \"ready\"}')"
    with pytest.raises(ProviderError):
        list(command_extractor([sys.executable, "-c", silent])("d1", "x"))
