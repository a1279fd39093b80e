"""Encoding and decoding of whole corpora with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.runtime import worker_cache

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut into chunks of that many ...
CHUNK_CHARS = 16_384
#: ... each repeating that many of the one before.
OVERLAP_CHARS = 1_024


@dataclass(frozen=True)
class Tokenizer:
    """A rank file: one line per token, its bytes in base64 and its id. Its size is fixed by the vocabulary."""

    name: str
    ranks: bytes

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Tokenizer:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            return cls(name, f.read())

    def table(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines() if line)}


def _encoder(tokenizer: Tokenizer):
    """The worker's encoder, loaded once."""
    import tiktoken

    cache = worker_cache()
    key = ("encoder", tokenizer.name, len(tokenizer.ranks))
    if key not in cache:
        cache[key] = tiktoken.Encoding(tokenizer.name, pat_str=PATTERN, mergeable_ranks=tokenizer.table(), special_tokens={})
    return cache[key]


def _pattern():
    cache = worker_cache()
    if "pattern" not in cache:
        cache["pattern"] = regex.compile(PATTERN)
    return cache["pattern"]


def clean_cuts(text: str, start: int = 0) -> np.ndarray:
    """Positions in text between two pre-tokens of which the first does not end in white space.

    Such a place is independent of what follows: pre-tokens before it end where they end, so the
    text on either side can be encoded by itself. The last pre-token's end is left out, for it may
    go on beyond the text.
    """
    ends = [m.end() for m in _pattern().finditer(text) if not text[m.end() - 1].isspace()]
    if ends and ends[-1] == len(text):
        ends.pop()
    return np.array(ends, dtype=np.int64) + start


def token_offsets(text: str, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in characters of the tokens of a text, sorted. A character that is cut between tokens belongs to each of them."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    encoder = _encoder(tokenizer)
    sizes = np.array([len(b) for b in encoder.decode_tokens_bytes(encoder.encode_ordinary(text))], dtype=np.int64)
    wide = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    per_char = 1 + (wide > 0x7F).astype(np.int64) + (wide > 0x7FF) + (wide > 0xFFFF)
    last = np.cumsum(per_char)  # the byte after each character
    ends = np.cumsum(sizes)
    return np.searchsorted(last, ends - sizes, side="right"), np.searchsorted(last, ends - 1, side="right") + 1


def encode_corpus(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: Tokenizer | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    count_only: bool = False,
) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; or (key, tokens) with ``count_only``.

    The empty and the NULL text have the empty list. Strings that look like special tokens are
    ordinary text. One row comes out per row of df, also of repeated keys, repeated rows and NULL keys;
    an empty table gives no rows; other columns are ignored.

    Texts of up to ``chunk_chars`` characters are encoded as they are. A longer one is cut into
    overlapping chunks, which are pre-tokenised in parallel. In the overlap of two neighbours the
    first position where both have a pre-token boundary is the cut: from there on both agree. The
    pieces between the cuts are encoded in parallel and their ids joined in order. Neighbours that
    never agree (an overlap inside one pre-token) stay one piece, so the ids are always those of the
    whole text.
    """
    spark: SparkSession = df.sparkSession
    tokenizer = tokenizer or Tokenizer.load()
    shipped = spark.sparkContext.broadcast((tokenizer.name, tokenizer.ranks))  # a fixed vocabulary, as plain values: workers may lack the package
    kind = df.schema[key].dataType.simpleString()
    out = "ids int" if count_only else "ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(Tokenizer(*shipped.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = [encoder.encode_ordinary(t) if t else [] for t in texts]
            sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            if count_only:
                last = pa.array(sizes)
            else:
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    long = F.coalesce(F.length("t") > chunk_chars, F.lit(False))
    short = rows.where(~long).mapInArrow(encode, f"k {kind}, {out}")

    step = chunk_chars - overlap_chars
    # A long text is known by its key and a hash of itself; equal rows are worked on once.
    whole = rows.where(long).groupBy(F.struct("k", F.xxhash64("t").alias("h")).alias("k"), "t").agg(F.count(F.lit(1)).alias("m"))
    kind_of_long = f"struct<k:{kind},h:bigint>"
    chunks = (
        whole.select("k", "t", "m", F.explode(F.expr(f"sequence(0, greatest(0, length(t) - {overlap_chars} - 1), {step})")).alias("at"))
        .select("k", "m", (F.col("at") / step).cast("int").alias("c"), "at", F.substring("t", F.col("at") + 1, F.lit(chunk_chars)).alias("t"))
        .repartition("k", "c")
    )

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            head, tail = [], []
            for a, t in zip(at, texts):
                cuts = clean_cuts(t, int(a))
                head.append(cuts[(cuts > a) & (cuts <= a + overlap_chars)])
                tail.append(cuts[cuts > a + step])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                names=["k", "c", "head", "tail"],
            )

    found = chunks.mapInArrow(boundaries, f"k {kind_of_long}, c int, head array<bigint>, tail array<bigint>")
    in_text = Window.partitionBy("k").orderBy("c")
    cuts = (
        found.withColumn("cut", F.array_min(F.array_intersect(F.lag("tail").over(in_text), F.col("head"))))
        .withColumn("piece", F.count("cut").over(in_text))
        .select("k", "c", "cut", F.lead("cut").over(in_text).alias("next"), "piece", F.lead("c").over(in_text).alias("more"))
    )
    # What a chunk gives to its piece: from its cut (or start) to the next chunk's cut (or start).
    begin = F.coalesce("cut", "at")
    end = F.coalesce("next", F.when(F.col("more").isNotNull(), F.col("at") + step), F.col("at") + chunk_chars)
    parts = chunks.join(cuts.withColumnsRenamed({"k": "k2", "c": "c2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("c") == F.col("c2")))
    parts = parts.select("k", "m", "piece", "c", F.substring("t", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("t"))
    pieces = parts.groupBy("k", "m", "piece").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("p"))
    pieces = pieces.select("k", "m", "piece", F.concat_ws("", F.col("p.t")).alias("t"))
    encoded = pieces.mapInArrow(encode, f"k {kind_of_long}, m bigint, piece bigint, {out}")
    if count_only:
        joined = encoded.groupBy("k", "m").agg(F.sum("ids").cast("int").alias("ids"))
    else:
        lists = F.sort_array(F.collect_list(F.struct("piece", "ids")))
        joined = encoded.groupBy("k", "m").agg(F.flatten(F.transform(lists, lambda x: x["ids"])).alias("ids"))
    joined = joined.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).select(F.col("k.k").alias("k"), "ids")
    return short.unionByName(joined).select(F.col("k").alias(key), F.col("ids").alias("tokens" if count_only else "ids"))


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: Tokenizer | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids, whose tokens' bytes are joined and read as UTF-8.

    NULL and empty lists give the empty text; bytes that are no UTF-8 give U+FFFD; an unknown id or
    a NULL in a list is an error.
    """
    tokenizer = tokenizer or Tokenizer.load()
    shipped = df.sparkSession.sparkContext.broadcast((tokenizer.name, tokenizer.ranks))
    kind = df.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokenizer(*shipped.value)
        cache, name = worker_cache(), ("bytes", known.name, len(known.ranks))
        if name not in cache:
            cache[name] = {i: b for b, i in known.table().items()}
        words = cache[name]
        for batch in batches:
            texts = [b"".join(words[i] for i in x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    out = df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(decode, f"k {kind}, text string")
    return out.withColumnRenamed("k", key)
