"""Explicit schemas of the stored tables."""

from pyspark.sql.types import StructType

SCHEMA_VERSION = 26

NODES = (
    "write_cursor bigint, kind string, body string, source_id string, logical_id string, superseded_at bigint, "
    "row_kind string, importance double, state string, reason string, valid_from bigint, valid_until bigint"
)
EDGES = (
    "write_cursor bigint, kind string, from_id string, to_id string, source_id string, logical_id string, "
    "superseded_at bigint, body string, t_valid bigint, t_invalid bigint, confidence double, "
    "extractor_model_id string, temporal_fallback boolean"
)
COLLECTIONS = "name string, kind string, schema_json string, retention_json string, format_version int, created_at bigint"
MUTATIONS = (
    "id bigint, collection_name string, record_key string, op_kind string, payload_json string, schema_id string, "
    "write_cursor bigint"
)
ATTRIBUTES = "write_cursor bigint, attr_name string, attr_value string"
VECTORS = (
    "write_cursor bigint, embedding array<float>, source_type string, kind string, created_at bigint, status string"
)
CORPUS = (
    "doc_id string, source_type string, title string, body string, created_at string, modified_at string, "
    "author_or_sender string, recipients array<string>, people_mentions array<string>, "
    "project_mentions array<string>, tags array<string>, url_or_external_id string, thread_id string, "
    "parent_doc_id string, license string, provenance string, "
    "entity_ids array<struct<id:string,kind:string,surface:string>>"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
