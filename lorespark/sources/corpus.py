"""Corpus documents as JSON lines: deterministic writing, reading, connectors, freezing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.schema import CORPUS, struct


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Corpus documents of one or more JSON-lines files; lines that are no JSON give a row of NULLs."""
    return spark.read.schema(struct(schema)).json(path)


def json_lines(df: DataFrame) -> DataFrame:
    """(line, sha256): each row as JSON with its keys in order, and the digest of the line's bytes."""
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    return df.select(line.alias("line")).withColumn("sha256", F.sha2("line", 256))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).select("line").write.mode("overwrite").text(path)


def derived_id(*parts: str) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by |; NULL parts are left out."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def freeze(df: DataFrame, source: str = "provenance") -> DataFrame:
    """(source, docs, digest): count and content digest per source; order and repeated rows do not matter.

    A row's digest covers id, version and body. A source's is the SHA-256 of its sorted row digests:
    64 bytes a document gather in one task, so freeze sources of more than some ten million
    documents by a finer column.
    """
    digest = F.sha2(F.concat_ws("|", F.col("doc_id"), F.coalesce("modified_at", F.lit("")), F.coalesce("body", F.lit(""))), 256)
    rows = df.select("doc_id", source, digest.alias("h")).distinct()
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("docs"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("digest")
    )


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, doc_ids, relation) of a folder of chain files, one JSON object each."""
    kinds = "chain_id string, doc_ids array<string>, relation_type string"
    return spark.read.schema(kinds).json(path, multiLine=True).select("chain_id", "doc_ids", F.coalesce("relation_type", F.lit("follows_up_on")).alias("relation"))


def corpus_items(docs: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for bulk writing: a node per corpus document, and an edge from each document of a chain to the one before.

    docs: corpus documents; of several versions the latest is taken, rows without an id are left out. chains: doc_ids (in order),
    relation. Links of NULL ids are left out, repeated ones count once.
    """
    last = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.struct(F.coalesce("modified_at", F.lit("")).alias("m"), "source_type", "title", "body", "provenance")).alias("x")
    )
    nodes = last.select(
        F.col("x.source_type").alias("kind"), F.to_json(F.struct("x.title", "x.body")).alias("body"), F.col("doc_id").alias("logical_id"),
        F.concat(F.lit("corpus:"), F.coalesce("x.provenance", F.lit("unknown"))).alias("source_id"),
    )
    pairs = F.transform(F.sequence(F.lit(1), F.size("doc_ids") - 1), lambda i: F.struct(F.get("doc_ids", i).alias("a"), F.get("doc_ids", i - 1).alias("b")))
    links = chains.where(F.size("doc_ids") > 1).select("relation", F.explode(pairs).alias("p")).where("p.a IS NOT NULL AND p.b IS NOT NULL")
    edges = links.select(F.col("relation").alias("kind"), F.col("p.a").alias("from_id"), F.col("p.b").alias("to_id"), F.lit("corpus:chains").alias("source_id")).distinct()
    return nodes, edges


#: An instant as performance records must write it.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, rejected) of a folder of performance records, one JSON object a file.

    runs: series (ac_id and n), at, sha, metric (p50_ms, p99_ms or recall), value: a row per metric. rejected: file, reason: a record
    must have a commit, an id and a size, a strict RFC 3339 instant that exists, and at least one metric.
    """
    kinds = "commit_sha string, ac_id string, n bigint, p50_ms double, p99_ms double, recall double, timestamp string"
    rows = spark.read.schema(kinds).json(path, multiLine=True).withColumn("file", F.input_file_name())
    at = F.when(F.col("timestamp").rlike(_RFC3339), F.try_to_timestamp("timestamp"))
    reason = (
        F.when(F.col("commit_sha").isNull() | F.col("ac_id").isNull() | F.col("n").isNull(), "incomplete")
        .when(at.isNull(), "timestamp")
        .when(F.coalesce("p50_ms", "p99_ms", "recall").isNull(), "no metric")
    )
    rows = rows.withColumn("reason", reason).withColumn("at", at)
    metrics = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("p50_ms", "p99_ms", "recall"))))
    good = rows.where("reason IS NULL").select(F.concat_ws("/", "ac_id", "n").alias("series"), "at", F.col("commit_sha").alias("sha"), metrics.alias("m"))
    return good.select("series", "at", "sha", "m.metric", "m.value").where("value IS NOT NULL"), rows.where("reason IS NOT NULL").select("file", "reason")


def differences(now: DataFrame, manifest: DataFrame, source: str = "provenance") -> DataFrame:
    """Sources whose count or digest is not that of the manifest; no rows mean the corpus is reproduced."""
    a, b = now.alias("a"), manifest.alias("b")
    return (
        a.join(b, F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")), "full_outer")
        .where(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | ~F.col("a.docs").eqNullSafe(F.col("b.docs")))
        .select(F.coalesce(f"a.{source}", f"b.{source}").alias(source), F.col("b.docs").alias("expected"), F.col("a.docs").alias("found"))
    )


#: Which columns of an upstream table become which of a corpus document, by kind of source.
CONNECTORS = {
    "email": {"title": "subject", "body": "body", "author_or_sender": "from", "created_at": "date", "native": "message_id"},
    "article": {"title": "headline", "body": "article", "author_or_sender": "byline", "created_at": "published", "native": "id"},
    "paper": {"title": "title", "body": "full_text", "author_or_sender": "authors", "created_at": "published", "native": "id"},
    "meeting": {"title": "topic", "body": "transcript", "author_or_sender": "host", "created_at": "date", "native": "meeting_id"},
    "todo": {"title": "text", "body": "text", "author_or_sender": "owner", "created_at": "created", "native": "id"},
    "event": {"title": "name", "body": "description", "author_or_sender": "organizer", "created_at": "start", "native": "id"},
    "note": {"title": "title", "body": "content", "author_or_sender": "author", "created_at": "created", "native": "id"},
}


def connect(df: DataFrame, kind: str, provenance: str, license: str) -> DataFrame:
    """Rows of an upstream table as corpus documents; columns it lacks are NULL."""
    mapping = CONNECTORS[kind]
    have = set(df.columns)

    def column(name: str) -> Column:
        source = mapping.get(name)
        return F.col(source).cast("string") if source in have else F.lit(None).cast("string")

    rows = df.select(
        F.substring(F.sha2(F.concat_ws("|", F.lit(provenance), column("native")), 256), 1, 16).alias("doc_id"),
        F.lit(kind).alias("source_type"),
        *(column(c).alias(c) for c in ("title", "body", "author_or_sender", "created_at")),
        F.lit(license).alias("license"),
        F.lit(provenance).alias("provenance"),
    )
    fields = struct(CORPUS).fields
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
