"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.tokens import Tokenizer, encode_corpus
from lorespark.operators.skew import joined
from lorespark.runtime import written

#: The flow is worked out in the driver, so more membership patterns than this, counted in the data, are an error.
MOST_PATTERNS = 200_000
#: A pattern's documents are put in order in parts, by hash, of about so many.
PART_ROWS = 20_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


class _Flow:
    """Maximum flow by layers and blocking flows; capacities may be raised between runs, and the flow goes on from where it was."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def add(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def used(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def _layers(self, source: int, sink: int) -> list[int] | None:
        depth = [-1] * len(self.edges)
        depth[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                y = self.to[e]
                if self.left[e] and depth[y] < 0:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        return depth if depth[sink] >= 0 else None

    def run(self, source: int, sink: int) -> None:
        while (depth := self._layers(source, sink)) is not None:
            tried, path, x = [0] * len(self.edges), [], source
            while True:
                if x == sink:
                    amount = min(self.left[e] for e in path)
                    cut = len(path)
                    for k in range(len(path) - 1, -1, -1):
                        self.left[path[k]] -= amount
                        self.left[path[k] ^ 1] += amount
                        if not self.left[path[k]]:
                            cut = k
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.edges[x]
                while tried[x] < len(edges) and not (self.left[edges[tried[x]]] and depth[self.to[edges[tried[x]]]] == depth[x] + 1):
                    tried[x] += 1
                if tried[x] < len(edges):
                    path.append(edges[tried[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    tried[x] += 1
                else:
                    break


def route(patterns: dict[tuple[str, ...], int], targets: list[Target], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each membership pattern gives to each source: as much of every quota as can be
    had, at the least repetition. A pattern's n-th copy costs n - 1 a token, so use is even.

    Only the ways into the patterns have a cost, and it rises with the copy. A shortest augmenting path therefore
    costs as much as the copy it begins with, so the minimum is found by letting in one copy of
    everything after the other, each time up to the maximum flow.
    """
    by = {t.source: t for t in targets}
    names, listed = sorted(by), sorted(patterns)
    flow = _Flow(2 + len(listed) + len(names))
    at = {n: 2 + len(listed) + k for k, n in enumerate(names)}
    ways, inner = [], {}
    for k, pattern in enumerate(listed):
        mine = [by[s] for s in pattern]
        ways.append((flow.add(0, 2 + k, 0), max(t.max_repeats for t in mine), patterns[pattern]))
        for t in mine:
            inner[pattern, t.source] = flow.add(2 + k, at[t.source], patterns[pattern] * t.max_repeats)
    for n in names:
        flow.add(at[n], 1, round(by[n].share * total))
    for copy in range(max((most for _, most, _ in ways), default=0)):
        for edge, most, size in ways:
            if copy < most:
                flow.left[edge] += size
        flow.run(0, 1)
    return {x: flow.used(e) for x, e in inner.items()}


@dataclass
class Mix:
    documents: DataFrame
    report: DataFrame


def mix_sources(
    df: DataFrame,
    targets: list[Target],
    key: str = "doc_id",
    text: str = "text",
    sources: str = "sources",
    total: int | None = None,
    seed: int = 0,
    tokenizer: Tokenizer | None = None,
) -> Mix:
    """Documents and how often to use each, so that every source has its share of the total tokens.

    ``sources`` is the array of the sources a document belongs to; those without a target do not
    count, and documents left with none (or with no tokens) are not used. Keys must be unique.
    ``total`` is the wanted size of the mix in tokens, by default that of all usable documents.

    Documents are aggregated by membership pattern. A minimum-cost flow routes the patterns' tokens
    to the sources' quotas (share * total), where the n-th copy of a document costs n - 1, so that
    quotas are filled as far as ``max_repeats`` allows and nothing is repeated before everything
    was used once. Each pattern's documents stand in an order fixed by ``seed`` on a tape that
    repeats; a source takes a stretch of it, so no document is used more than max_repeats times for
    a source, and a source misses its quota by less than one document.

    ``documents``: key, source, tokens, uses. ``report``: one row per target with the share wanted
    and had (of the tokens used), tokens, uses, the most uses of one document, and status:
    ``reached``, or ``short`` where the source cannot fill its quota. An empty table gives an empty
    mix and a report in which every target is short.
    """
    if len({t.source for t in targets}) < len(targets):
        raise ValueError("each source has one target")
    names = sorted(t.source for t in targets)
    wanted = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    mine = F.array_sort(F.array_intersect(F.coalesce(sources, F.array().cast("array<string>")), wanted))
    rows = df.select(F.struct(F.col(key).alias("id"), mine.alias("p")).alias("k"), F.col(text).alias("t")).where(F.size("k.p") > 0)
    sizes = written(
        encode_corpus(rows, "k", "t", tokenizer, count_only=True)
        .select("k.id", "k.p", F.col("tokens").cast("bigint").alias("n"), F.expr(f"xxhash64(k.id, {int(seed)}L)").alias("h"))
        .where("n > 0"),
        "mix-sizes",
    )
    counted = written(sizes.groupBy("p").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "mix-patterns")
    if counted.count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns occur")
    patterns = {tuple(r.p): r.n for r in counted.collect()}  # at most MOST_PATTERNS
    total = sum(patterns.values()) if total is None else total
    flows = route(patterns, targets, total)

    tape, begin = [], {}
    for (pattern, source), tokens in sorted(flows.items()):
        x = begin.get(pattern, 0)
        begin[pattern] = x + tokens
        if tokens:
            tape.append((list(pattern), patterns[pattern], source, x, x + tokens))
    spark = df.sparkSession
    stretches = written(spark.createDataFrame(tape, "p array<string>, size bigint, source string, x bigint, y bigint"), "mix-tape")

    # A pattern's documents are summed one after the other in parts by hash, as many as its exact count asks for.
    parts = counted.select("p", F.ceil(F.col("docs") / PART_ROWS).alias("parts"))
    sizes = joined(sizes, parts, ["p"]).withColumn("b", F.expr("pmod(h, parts)")).drop("parts")
    sums = sizes.groupBy("p", "b").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("p", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("p", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sizes.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, ["p", "b"])
        .withColumn("a", F.col("start") + F.col("rank"))
    )
    # A document begins at a, a + size, a + 2 size, ... on its pattern's tape; count those in [x, y).
    uses = F.expr("((y - a + size - 1) div size) - ((x - a + size - 1) div size)")
    used = (
        joined(placed, stretches, ["p"])
        .withColumn("uses", uses.cast("int"))
        .where("uses > 0")
        .select(F.col("id").alias(key), "source", F.col("n").alias("tokens"), "uses")
    )
    used = written(used, "mix")

    had = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.sum("uses").cast("bigint").alias("uses"),
        F.max("uses").alias("most_uses"),
    )
    filled = {t.source: 0 for t in targets}
    available = dict(filled)
    for (pattern, source), tokens in flows.items():
        filled[source] += tokens
        available[source] += patterns[pattern]
    plan = spark.createDataFrame(
        [
            (t.source, t.share, t.max_repeats, round(t.share * total), available[t.source],
             "reached" if filled[t.source] >= round(t.share * total) and available[t.source] else "short")
            for t in targets
        ],
        "source string, target_share double, max_repeats int, target_tokens bigint, available_tokens bigint, status string",
    )
    everything = Window.partitionBy()
    report = plan.join(had, "source", "left").select(
        "source",
        "target_share",
        F.round(F.coalesce("actual_tokens", F.lit(0)) / F.sum("actual_tokens").over(everything), 6).alias("actual_share"),
        "target_tokens",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("actual_tokens", "available_tokens", "documents", "uses")),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        "max_repeats",
        "status",
    )
    return Mix(used, report)
