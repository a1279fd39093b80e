"""Extraction and consolidation by outside providers, checked and turned into rows."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.errors import ProviderError

VERDICTS = ("keep", "supersede", "merge", "invalidate")
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2}))?$"


def entity_id(kind: Column, name: Column) -> Column:
    """The logical id of an extracted entity; kinds with a colon have none (the write is refused)."""
    key = F.concat(F.lower(F.trim(kind)), F.lit(":"), F.lower(F.trim(name)))
    return F.when(~F.contains(kind, F.lit(":")), F.sha2(key, 256))


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of a strict ISO-8601 date or instant, else NULL."""
    return F.when(text.rlike(_ISO), F.unix_timestamp(F.try_to_timestamp(text)))


def extracted_edges(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected) of facts(source_doc_id, from_kind, from_name, to_kind, to_name, kind, body, t_valid, t_invalid,
    confidence, model): ids derived, times strict, confidence within 0..1, repeated facts of a document collapsed."""
    f = facts.withColumns(
        {
            "from_id": entity_id(F.col("from_kind"), F.col("from_name")),
            "to_id": entity_id(F.col("to_kind"), F.col("to_name")),
            "valid": iso_epoch(F.col("t_valid")),
            "invalid": iso_epoch(F.col("t_invalid")),
        }
    )
    reason = (
        F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), "entity kind")
        .when(F.col("t_valid").isNotNull() & F.col("valid").isNull(), "t_valid")
        .when(F.col("t_invalid").isNotNull() & F.col("invalid").isNull(), "t_invalid")
        .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.col("confidence").isNull()), "confidence")
    )
    f = f.withColumn("reason", reason)
    good = f.where("reason IS NULL").groupBy("source_doc_id", "from_id", "kind", "to_id").agg(
        F.max(F.struct("valid", "body", "invalid", "confidence", "model")).alias("x")
    )
    edges = good.select(
        "kind", "from_id", "to_id", F.col("source_doc_id").alias("source_id"), F.col("x.body").alias("body"),
        F.col("x.valid").alias("t_valid"), F.col("x.invalid").alias("t_invalid"), F.col("x.confidence").alias("confidence"),
        F.col("x.model").alias("extractor_model_id"), F.col("x.valid").isNull().alias("temporal_fallback"),
    )
    return edges, f.where("reason IS NOT NULL").select("source_doc_id", "reason")


def run_extractor(documents: DataFrame, provider: Callable[[str, str], Iterator[dict]], schema: str) -> DataFrame:
    """The facts a provider finds: provider(source_doc_id, body) runs on the executors, one document at a time, or, if it has
    ``many``, provider.many(pairs) for all documents of a batch, giving (source_doc_id, fact)."""
    def each(batches):
        import pandas as pd

        for pdf in batches:
            pairs = [(d, b or "") for d, b in zip(pdf["source_doc_id"], pdf["body"])]
            many = getattr(provider, "many", lambda asked: ((d, x) for d, b in asked for x in provider(d, b)))
            rows = [dict(source_doc_id=d, **x) for d, x in many(pairs)]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])

    return documents.select("source_doc_id", "body").mapInPandas(each, schema)


def command_extractor(command: list[str], timeout: float = 60.0) -> Callable[[str, str], Iterator[dict]]:
    """A provider behind a command that speaks lines of JSON: hello and ready, then extract and result per document.

    One process serves all documents of a batch; ``timeout`` is for one document. Every request needs exactly one result.
    """
    def many(pairs: list[tuple[str, str]]) -> Iterator[tuple[str, dict]]:
        of: dict[str, str] = {}
        asked = [{"type": "hello", "protocol": "extract.v1"}]
        for k, (doc, body) in enumerate(pairs):
            name = doc if doc not in of else f"{doc}#{k}"
            of[name] = doc
            asked.append({"type": "extract", "request_id": name, "body": body})
        done = subprocess.run(command, input="\n".join(map(json.dumps, asked)) + "\n", capture_output=True, text=True, timeout=timeout * max(1, len(pairs)))
        lines = [json.loads(x) for x in done.stdout.splitlines() if x.strip()]
        if done.returncode or not lines or lines[0].get("type") != "ready":
            raise ProviderError(f"the extractor did not answer: {done.stderr[-300:]}")
        open_ids = set(of)
        for line in lines[1:]:
            name = line.get("request_id")
            if line.get("type") != "result" or name not in open_ids:
                raise ProviderError("an answer to no request")
            open_ids.remove(name)
            yield from ((of[name], edge) for edge in line.get("edges", []))
        if open_ids:
            raise ProviderError(f"{len(open_ids)} documents got no result")

    def extract(doc: str, body: str) -> Iterator[dict]:
        yield from (edge for _, edge in many([(doc, body)]))

    extract.many = many
    return extract


def apply_verdicts(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges with each verdict applied as metadata; bodies are never rewritten.

    verdicts: write_cursor, verdict, at. Every edge of a judged (from, kind) cluster must have exactly one
    verdict, and none may lie outside: else ProviderError. ``at`` is when an edge stops being valid (0 if NULL).
    """
    judged = verdicts.groupBy("write_cursor").agg(F.count(F.lit(1)).alias("n"), F.max("verdict").alias("verdict"), F.max("at").alias("at"))
    both = edges.where("superseded_at IS NULL").select("write_cursor", "from_id", "kind").join(judged, "write_cursor", "full_outer")
    w = Window.partitionBy("from_id", "kind")
    touched = both.withColumn("touched", F.count("n").over(w) > 0)
    bad = touched.where(
        F.col("from_id").isNull() | (F.col("touched") & F.col("n").isNull()) | (F.col("n") > 1) | ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(True))
    )
    if not bad.isEmpty():
        raise ProviderError("every edge of a cluster has exactly one verdict, and no other edge has one")
    ended = F.col("verdict").isin("supersede", "merge", "invalidate")
    out = edges.join(judged.select("write_cursor", "verdict", "at"), "write_cursor", "left")
    return out.withColumn("t_invalid", F.when(ended, F.coalesce("at", F.lit(0).cast("bigint"))).otherwise(F.col("t_invalid"))).select(edges.columns)
