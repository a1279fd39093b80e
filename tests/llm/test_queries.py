"""Every query of the subpackage against its SQL over the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import connect, rows  # noqa: E402

from lorespark.llm import catalog  # noqa: E402
from lorespark.llm.tokens import Tokenizer, _encoder  # noqa: E402

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), connect(sf).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql(spark, sf):
    """What SQL cannot say: ids and counts against the tokenizer itself, pieces against their boundaries, languages of all texts."""
    assert sorted(set(QUERIES) - set(SQL)) == ["p3_pieces", "p6_ids", "p7_mix", "p7_report", "p8_found", "p8_languages"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    encoder = _encoder(Tokenizer.load())
    assert {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, sf).collect()} == {k: encoder.encode_ordinary(t) for k, t in texts.items()}
    assert all(r.tokens == len(encoder.encode_ordinary(texts[r.doc_id])) for r in QUERIES["p7_mix"](spark, sf).collect())
    report = QUERIES["p7_report"](spark, sf).toPandas()
    assert len(report) == 11 and abs(report.actual_share.sum() - 1) < 1e-4
    assert {r.doc_id for r in QUERIES["p3_pieces"](spark, sf).collect()} == {r.doc_id for r in QUERIES["p3_found"](spark, sf).collect()}
    found = QUERIES["p8_languages"](spark, sf).toPandas()
    assert set(found[found.seg == 0].doc_id) == set(texts) and len(found[found.seg == 0]) == len(texts)
    named = found[found.label.notna() & found.lang.notna() & (found.groupby("doc_id").seg.transform("max") == 0)]
    assert (named.label == named.lang).mean() > 0.9  # some labels are wrong by design
    wrong = QUERIES["p8_found"](spark, sf).toPandas()
    assert set(wrong.doc_id) <= set(texts) and wrong.lang.notna().all() and len(wrong) == len(wrong.drop_duplicates(["doc_id", "seg"]))


def test_found_columns(spark, sf):
    want = {
        "p1_found": ["query_id", "doc_id"], "p3_found": ["doc_id", "boundary"], "p4_found": ["query_id", "doc_id"],
        "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "seg", "lang"],
    }
    assert {n: QUERIES[n](spark, sf).columns for n in want} == want
