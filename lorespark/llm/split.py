"""Cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.tokens import Tokenizer, token_offsets

#: Kinds of boundary, from the most to the least natural.
KINDS = ["paragraph", "line", "sentence", "word"]
HARD = "character"
_PATTERNS = [
    regex.compile(p)
    for p in (
        r"(?:\A|\r?\n)(?:[^\S\n]*+\n)++(?:[^\S\n]++\Z)?|(?:\A|\r?\n)[^\S\n]++\Z",  # blank lines, with the line end before them
        r"\r?\n",
        r"(?<=[.!?…])\s+|(?<=[。！？])\s*",
        r"\s+",
    )
]


def boundaries(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the sorted starts and ends of its boundaries and those of the kinds before it.

    A boundary is a stretch between two units; a text may be cut anywhere inside it.
    """
    out, starts, ends = [], np.empty(0, np.int64), np.empty(0, np.int64)
    for pattern in _PATTERNS:
        spans = np.array([m.span() for m in pattern.finditer(text)], dtype=np.int64).reshape(-1, 2)
        starts, ends = np.r_[starts, spans[:, 0]], np.r_[ends, spans[:, 1]]
        order = np.lexsort((ends, starts))
        starts, ends = starts[order], ends[order]
        if len(starts):  # join what touches
            reach = np.maximum.accumulate(ends)
            first = np.r_[True, starts[1:] > reach[:-1]]
            last = np.r_[first[1:], True]
            starts, ends = starts[first], reach[last]
        out.append((starts, ends))
    return out


class Characters:
    """Sizes in characters: the prefix sums are the offsets themselves."""

    def __init__(self, text: str):
        self.size = len(text)

    def between(self, a, b):
        return b - a

    def reach(self, start: int, limit: int) -> int:
        """The last place such that the text from start to there is within limit."""
        return min(start + limit, self.size)

    def back(self, end: int, limit: int) -> int:
        """The first place such that the text from there to end is within limit."""
        return max(end - limit, 0)


class Tokens:
    """Sizes in tokens of the whole text: a piece has every token that it holds a character of.

    ``starts`` and ``ends`` are the sorted offsets of the tokens. Two prefix sums, of tokens begun before and of
    tokens ended by each place, give the size of any piece by a subtraction and any limit by a binary search.
    """

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        places = np.arange(len(text) + 1)
        self.begun = np.searchsorted(starts, places, side="left")
        self.ended = np.searchsorted(ends, places, side="right")

    def between(self, a, b):
        return self.begun[b] - self.ended[a]

    def reach(self, start: int, limit: int) -> int:
        return int(np.searchsorted(self.begun, self.ended[start] + limit, side="right")) - 1

    def back(self, end: int, limit: int) -> int:
        return int(np.searchsorted(self.ended, self.begun[end] - limit, side="left"))


def natural_kind(bounds: list[tuple[np.ndarray, np.ndarray]], size: int, most: int, measure=None) -> str:
    """The first kind whose units all have at most ``most`` characters (or what measure counts)."""
    for kind, (starts, ends) in zip(KINDS, bounds):
        a, b = np.r_[0, ends], np.r_[starts, size]
        if (b - a if measure is None else measure.between(a, np.maximum(a, b))).max() <= most:
            return kind
    return HARD


def cut(text: str, limit: int, overlap: int, measure=None) -> tuple[str, list[tuple[int, int, int, str]]]:
    """(natural kind, pieces as (start, new, end, kind of the cut at the end)).

    A piece is text[start:end], of which text[start:new] repeats the end of the piece before. Where a single
    character is larger than the limit, in tokens, it is a piece of its own.
    """
    measure = measure or Characters(text)
    bounds, size = boundaries(text), len(text)
    kind = natural_kind(bounds, size, limit - overlap, measure)
    words = np.unique(bounds[-1][1])
    pieces, start, new = [], 0, 0
    while measure.between(start, size) > limit and new < size:
        last = max(measure.reach(start, limit), new + 1)
        for name, (starts, ends) in zip(KINDS, bounds):
            k = int(np.searchsorted(starts, last, side="right")) - 1  # the last boundary that begins within the limit
            if k >= 0 and min(int(ends[k]), last) > new:
                end = min(int(ends[k]), last)
                break
        else:
            name, end = HARD, last
        pieces.append((start, new, end, name))
        back = measure.back(end, overlap)
        k = int(np.searchsorted(words, back))
        start = int(words[k]) if k < len(words) and words[k] < end else min(back, end)  # a word's beginning, else mid-word
        start, new = min(max(start, pieces[-1][0] + 1), end), end
    if new < size or not pieces:
        pieces.append((start, new, size, "end"))
    else:
        pieces[-1] = (*pieces[-1][:3], "end")
    return kind, pieces


def split_oversized(
    df: DataFrame, key: str = "doc_id", text: str = "body", limit: int = 6_000, overlap: int = 200, tokenizer: Tokenizer | None = None
) -> DataFrame:
    """(key, boundary, piece, start, repeated, size, cut, text): each text over ``limit`` in ordered pieces.

    Sizes are characters, or tokens of the whole text if a ``tokenizer`` is given (a token cut in two counts on both
    sides; start and repeated are characters all the same). A piece has at most ``limit``, the first ``repeated`` characters of which (at most ``overlap``)
    are the end of the piece before; without them the pieces joined are the text. A cut goes to the
    last paragraph boundary under the limit, else to the last line, sentence or word boundary, else
    it is hard; ``cut`` says which, ``end`` for the last piece. ``boundary`` is the first kind at
    whose boundaries alone the text could be cut, every unit having at most limit - overlap,
    else ``character``. Characters are code points. A character of more tokens than limit is a piece of its own.

    Texts within the limit, empty and NULL ones give no rows. Keys are kept as they are, repeated
    and NULL ones too; other columns are ignored. ``overlap`` must be below ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = df.schema[key].dataType.simpleString()
    shipped = tokenizer and df.sparkSession.sparkContext.broadcast((tokenizer.name, tokenizer.ranks))  # a fixed vocabulary

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in enumerate(batch.column(1)):
                t = t.as_py()
                measure = Tokens(t, *token_offsets(t, Tokenizer(*shipped.value))) if shipped else Characters(t)
                if measure.between(0, len(t)) <= limit:
                    continue
                natural, parts = cut(t, limit, overlap, measure)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row] * n)),
                        pa.array([natural] * n),
                        pa.array(range(n), pa.int32()),
                        pa.array([a for a, *_ in parts], pa.int64()),
                        pa.array([b - a for a, b, *_ in parts], pa.int32()),
                        pa.array([int(measure.between(a, c)) for a, _, c, _ in parts], pa.int32()),
                        pa.array([name for *_, name in parts]),
                        pa.array([t[a:c] for a, _, c, _ in parts]),
                    ],
                    names=["k", "boundary", "piece", "start", "repeated", "size", "cut", "text"],
                )

    # A text has at most one token a byte, so what has fewer bytes than the limit is left out before Python.
    large = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where((F.octet_length("t") if tokenizer else F.length("t")) > limit)
    out = large.mapInArrow(
        pieces, f"k {kind}, boundary string, piece int, start bigint, repeated int, size int, cut string, text string"
    )
    return out.withColumnRenamed("k", key)


def holding_versions(df: DataFrame, key: str, text: str, modified: str, over: int | None = None) -> DataFrame:
    """(key, text) of each key's version with the latest ``modified`` (ISO-8601 text; NULL is earliest).

    Among equally late versions any text comes before NULL and the one with the greatest hash holds. NULL keys are
    left out. Only hashes take part in finding the version that holds; texts are fetched for those, and with ``over``
    only for those of more characters (the other keys then have no row).
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"),
        F.struct(F.try_to_timestamp(modified).alias("m"), F.col(text).isNotNull().alias("f"), F.xxhash64(text).alias("h")).alias("v"),
        F.col(text).alias("t"),
    )
    last = rows.groupBy("k").agg(F.max("v").alias("v")).select(F.col("k").alias("k2"), F.col("v").alias("v2"))
    wanted = rows if over is None else rows.where(F.length("t") > over)
    found = wanted.join(last, (F.col("k") == F.col("k2")) & F.col("v").eqNullSafe(F.col("v2")))
    return found.groupBy("k").agg(F.any_value("t").alias(text)).select(F.col("k").alias(key), text)
