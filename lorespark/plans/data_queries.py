"""Queries on attribute rows: wide tables and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.incremental import changed_since, last_successful
from lorespark.operators.widen import filled_cells, widen
from lorespark.runtime import prepare, scratch_path


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def _declared(spark: SparkSession, sf: str) -> dict[str, str]:
    rows = _read(spark, sf, "attribute_types").select("attr_name", "value_type").collect()  # a fixed table
    return {r.attr_name: r.value_type for r in rows}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    declared = _declared(spark, sf)
    return filled_cells(widen(_read(spark, sf, "canonical_attributes"), declared), declared)


def p2_wide(spark: SparkSession, sf: str) -> DataFrame:
    return widen(_read(spark, sf, "canonical_attributes"), _declared(spark, sf))


def p2_wide_text(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table with its typed columns; days as text, so that SQL results compare."""
    wide = p2_wide(spark, sf)
    return wide.select(*(F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "date" else F.col(f.name) for f in wide.schema))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = last_successful(_read(spark, sf, "projection_runs"), "attributes")
    found = changed_since(
        _read(spark, sf, "canonical_attributes"),
        snapshot,
        scratch_path(spark, "incremental"),
        "write_cursor",
        "attr_name",
        "attr_value",
        "landed_at",
    )
    return found.select("write_cursor", "attr_name")


_CELLS = r"""
WITH named AS (
  SELECT write_cursor, t.attr_name, value_type, attr_value, landed_at
  FROM canonical_attributes a JOIN attribute_types t
    ON lower(replace(regexp_replace(a.attr_name, '^\s+|\s+$', '', 'g'), '-', '_')) = t.attr_name
  WHERE write_cursor IS NOT NULL),
last AS (
  SELECT *, regexp_replace(attr_value, '^\s+|\s+$', '', 'g') AS v FROM named
  QUALIFY row_number() OVER (PARTITION BY write_cursor, attr_name
                             ORDER BY landed_at DESC NULLS LAST, attr_value DESC NULLS LAST) = 1),
cells AS (
  SELECT write_cursor, attr_name, value_type,
    CASE value_type
      WHEN 'text' THEN nullif(v, '')
      WHEN 'integer' THEN CASE WHEN regexp_full_match(v, '[+-]?(\d{1,3}(,\d{3})+|\d+)(\.0*)?')
        THEN CAST(try_cast(ltrim(split_part(replace(v, ',', ''), '.', 1), '+') AS BIGINT) AS VARCHAR) END
      WHEN 'number' THEN CASE WHEN regexp_full_match(v, '[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][+-]?\d+)?')
                               AND regexp_matches(v, '^[+-]?[0-9,.]*[0-9]')
        THEN CAST(CAST(round(CAST(replace(v, ',', '') AS DOUBLE) * 1000) AS HUGEINT) AS VARCHAR) END
      WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', 'on', '1') THEN 'true'
                               WHEN lower(v) IN ('false', 'f', 'no', 'n', 'off', '0') THEN 'false' END
      WHEN 'date' THEN strftime(CASE
        WHEN regexp_full_match(v, '\d{10}') THEN CAST(to_timestamp(CAST(v AS BIGINT)) AT TIME ZONE 'UTC' AS DATE)
        WHEN regexp_full_match(v, '\d{4}-\d{1,2}-\d{1,2}([T ]\d\d:\d\d(:\d\d)?Z?)?') THEN try_cast(split_part(replace(v, 'T', ' '), ' ', 1) AS DATE)
        WHEN regexp_full_match(v, '\d{4}/\d{1,2}/\d{1,2}') THEN try_cast(replace(v, '/', '-') AS DATE)
        WHEN regexp_full_match(v, '\d{8}') THEN CAST(try_strptime(v, '%Y%m%d') AS DATE)
        WHEN regexp_full_match(v, '\d{1,2} [A-Za-z]{3} \d{4}') THEN CAST(try_strptime(v, '%d %b %Y') AS DATE)
        WHEN regexp_full_match(v, '\d{1,2} [A-Za-z]+ \d{4}') THEN CAST(try_strptime(v, '%d %B %Y') AS DATE)
        WHEN regexp_full_match(v, '[A-Za-z]{3} \d{1,2}, \d{4}') THEN CAST(try_strptime(v, '%b %d, %Y') AS DATE)
        WHEN regexp_full_match(v, '[A-Za-z]+ \d{1,2}, \d{4}') THEN CAST(try_strptime(v, '%B %d, %Y') AS DATE)
      END, '%Y-%m-%d')
    END AS cell
  FROM last)
SELECT write_cursor, attr_name, cell FROM cells WHERE cell IS NOT NULL
"""

#: The declared attributes and their types, in the order of the fixed table attribute_types.
_TYPES = {
    "status": "text", "priority": "integer", "owner": "text", "due_on": "date", "effort_hours": "number", "is_blocked": "boolean", "reviewed": "boolean",
    "opened_on": "date", "score": "number", "retries": "integer", "locale": "text", "budget": "number", "headcount": "integer", "confidential": "boolean",
    "sunset_on": "date",
}


def _wide_sql() -> str:
    """The cells as SQL reads them, one column each; numbers from their digits."""
    form = {"text": "{}", "integer": "CAST({} AS BIGINT)", "boolean": "CAST({} AS BOOLEAN)", "date": "{}"}
    columns = []
    for name, kind in _TYPES.items():
        mine = f"FILTER (attr_name = '{name}')"
        cell = f"max(CASE WHEN cell IS NOT NULL THEN TRY_CAST(replace(v, ',', '') AS DOUBLE) END) {mine}" if kind == "number" else form[kind].format(f"max(cell) {mine}")
        columns.append(f"{cell} AS {name}")
    cells = _CELLS[: _CELLS.rindex("SELECT write_cursor, attr_name, cell FROM cells")].replace("SELECT write_cursor, attr_name, value_type,\n    CASE value_type", "SELECT write_cursor, attr_name, v,\n    CASE value_type")
    return cells + f"SELECT write_cursor, {', '.join(columns)} FROM cells GROUP BY write_cursor"


_CHANGED = """
WITH snap AS (SELECT max(snapshot_at) AS snap_at FROM projection_runs WHERE projection = 'attributes' AND status = 'succeeded'),
now AS (
  SELECT write_cursor, attr_name, attr_value FROM canonical_attributes
  QUALIFY row_number() OVER (PARTITION BY write_cursor, attr_name ORDER BY landed_at DESC NULLS LAST, attr_value DESC NULLS LAST) = 1),
old AS (
  SELECT write_cursor, attr_name, attr_value FROM canonical_attributes, snap WHERE landed_at <= snap_at
  QUALIFY row_number() OVER (PARTITION BY write_cursor, attr_name ORDER BY landed_at DESC, attr_value DESC NULLS LAST) = 1)
SELECT now.write_cursor, now.attr_name FROM now
LEFT JOIN (SELECT *, true AS there FROM old) o
  ON now.write_cursor IS NOT DISTINCT FROM o.write_cursor AND now.attr_name IS NOT DISTINCT FROM o.attr_name
WHERE there IS NULL OR now.attr_value IS DISTINCT FROM o.attr_value
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_wide": p2_wide, "p2_wide_text": p2_wide_text, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _CELLS, "p2_wide_text": _wide_sql(), "p5_found": _CHANGED}
