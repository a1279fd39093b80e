"""Validation of JSON payloads against the part of JSON Schema that the op-store needs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}
KEYWORDS = {
    "type", "required", "properties", "items", "enum", "const", "minimum", "maximum", "minLength", "maxLength",
    "additionalProperties", "title", "description", "$schema", "$id", "default",
}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def check_schema(schema, path: str = "$") -> None:
    """Refuse a schema with keywords that would be ignored, patterns, or references (local or not)."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: a schema is an object or a boolean")
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"{path}: unsupported keywords {sorted(unknown)}")
    for name, part in (schema.get("properties") or {}).items():
        check_schema(part, f"{path}.{name}")
    for key in ("items", "additionalProperties"):
        if key in schema:
            check_schema(schema[key], f"{path}.{key}")


def violations(value, schema, path: str = "$") -> list[str]:
    """What of a value breaks the schema; an empty list if nothing does."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{path}: not allowed"]
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: is no {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not among the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the allowed value")
    if _is(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{path}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{path}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: length out of bounds")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{k}]")
    if isinstance(value, dict):
        out += [f"{path}: lacks {k}" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        for k, x in value.items():
            if k in known:
                out += violations(x, known[k], f"{path}.{k}")
            elif "additionalProperties" in schema:
                out += violations(x, schema["additionalProperties"], f"{path}.{k}")
    return out


def payload_violations(payload: Column, schema_json: str) -> Column:
    """Array of violations of each payload; text that is no JSON is one."""
    schema = json.loads(schema_json)
    check_schema(schema)

    @F.pandas_udf(ArrayType(StringType()))
    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return violations(json.loads(t), schema)
            except (TypeError, ValueError):
                return ["$: no JSON"]

        return texts.map(one)

    return check(payload)
