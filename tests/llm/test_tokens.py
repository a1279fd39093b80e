import random

import pytest
import tiktoken

from lorespark.llm.tokens import PATTERN, Tokenizer, clean_cuts, decode_corpus, encode_corpus

TOKENIZER = Tokenizer.load()
SCHEMA = "doc_id bigint, text string"


ENCODER = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=TOKENIZER.table(), special_tokens={})


def whole(text):
    return ENCODER.encode_ordinary(text or "")


def texts():
    rng = random.Random(11)
    alphabet = ["word", "don't", " ", "  ", "\n", "\n\n", " \t", "12", "…", "été", "日本語", "。", "👩‍👩‍👧", "<|endoftext|>", "\r\n", "'s", "'", " ", "　", "x" * 40]
    out = [None, "", " ", "a", "\n" * 900, "x" * 1500, "<|endoftext|>", "é" * 333 + " " * 500 + "b" * 400, "�​"]
    for n in (3, 40, 200, 900):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(6)]
    return out


@pytest.mark.parametrize("chunk, overlap", [(16_384, 1_024), (200, 40), (64, 20), (30, 7)])
def test_ids_are_those_of_the_whole_text(spark, chunk, overlap):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.ids for r in encode_corpus(df, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert got == {i: whole(t) for i, t in rows}
    if chunk == 64:
        counts = encode_corpus(df, chunk_chars=chunk, overlap_chars=overlap, count_only=True).collect()
        assert {r.doc_id: r.tokens for r in counts} == {i: len(x) for i, x in got.items()}


def test_repeated_keys_and_rows(spark):
    rows = [(1, "ab " * 50), (1, "ab " * 50), (1, "cd " * 60), (None, "ef " * 70), (None, "ef " * 70), (2, "x"), (2, "x"), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, chunk_chars=64, overlap_chars=20).collect()), key=str)
    assert got == sorted(((i, whole(t)) for i, t in rows), key=str)


def test_agrees_with_the_json_form_of_the_vocabulary(spark):
    from tokenizers import Tokenizer as Json

    other = Json.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for t in texts():
        assert other.encode(t or "", add_special_tokens=False).ids == whole(t)


def test_round_trip(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", k int, t string")
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df, chunk_chars=64, overlap_chars=20)).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_clean_cuts_split_without_changing_ids():
    for t in texts():
        for cut in clean_cuts(t or ""):
            assert whole(t[:cut]) + whole(t[cut:]) == whole(t)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert encode_corpus(df).collect() == []
    assert decode_corpus(encode_corpus(df)).collect() == []
