"""Read views, closed predicates and unified filters, each compiled to one Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.errors import InvalidFilterError, InvalidLimitError

#: The JSON paths a predicate may name.
ALLOWED_PATHS = ("$.status", "$.priority", "$.tags", "$.kind", "$.created_at")
#: Kinds of record that have a place in the vector index, and the source type each has there.
SOURCE_TYPES = {
    "email": "email", "article": "article", "paper": "paper", "meeting": "meeting", "note": "note", "todo": "todo",
    "doc": "article", "edge_fact": "edge_fact",
}
OPERATORS = ("eq", "gt", "gte", "lt", "lte")


@dataclass(frozen=True)
class ReadView:
    """Which rows a read sees; each axis is relaxed by itself."""

    include_superseded: bool = False
    include_inactive: bool = False
    include_out_of_window: bool = False
    valid_as_of: int | None = None

    def existence(self) -> Column:
        parts = []
        if not self.include_superseded:
            parts.append(F.col("superseded_at").isNull())
        if not self.include_inactive:
            parts.append(F.col("state") == "active")
        return all_of(parts)

    def column(self, now: int) -> Column:
        """The view as one condition; ``now`` is read once per query by the caller."""
        parts = [self.existence()]
        if not self.include_out_of_window:
            at = now if self.valid_as_of is None else self.valid_as_of
            parts.append(valid_at(at))
        return all_of(parts)


@dataclass(frozen=True)
class Predicate:
    """One comparison of a scalar in a JSON body; types must agree, nothing is coerced."""

    path: str
    op: str
    value: str | int | bool

    def column(self, body: str = "body") -> Column:
        if self.path not in ALLOWED_PATHS:
            raise InvalidFilterError(f"path {self.path!r} is not one of {ALLOWED_PATHS}")
        return json_compare(body, self.path, self.op, self.value)


@dataclass(frozen=True)
class SearchFilter:
    """Metadata conditions of a search; all that are given must hold."""

    source_type: str | None = None
    kind: str | None = None
    created_after: int | None = None
    status: str | None = None
    attributes: tuple[tuple[str, str], ...] = field(default=())


@dataclass(frozen=True)
class Term:
    """One term of the unified filter: name is SourceType, Kind, CreatedAfter, Status or Json."""

    name: str
    value: object


@dataclass(frozen=True)
class Filter:
    """The unified filter: terms joined by AND, compiled for search or for list reads."""

    terms: tuple[Term, ...] = ()

    @classmethod
    def from_search_filter(cls, f: SearchFilter) -> Filter:
        if f.attributes:
            raise InvalidFilterError("attribute conditions have no unified form")
        named = (("SourceType", f.source_type), ("Kind", f.kind), ("CreatedAfter", f.created_after), ("Status", f.status))
        return cls(tuple(Term(n, v) for n, v in named if v is not None))

    def for_search(self) -> SearchFilter:
        names = {"SourceType": "source_type", "Kind": "kind", "CreatedAfter": "created_after", "Status": "status"}
        found = {}
        for t in self.terms:
            if t.name not in names:
                raise InvalidFilterError(f"{t.name} cannot be used in a search")
            found[names[t.name]] = t.value
        return SearchFilter(**found)

    def for_list(self, kind: str) -> Column:
        """For a list of one kind: Kind and SourceType fold to constants, the rest reads the JSON body."""
        parts = []
        for t in self.terms:
            if t.name == "Kind":
                parts.append(F.lit(t.value == kind))
            elif t.name == "SourceType":
                parts.append(F.lit(SOURCE_TYPES.get(kind) == t.value))
            elif t.name == "Status":
                parts.append(json_compare("body", "$.status", "eq", t.value))
            elif t.name == "CreatedAfter":
                parts.append(json_compare("body", "$.created_at", "gte", t.value))
            elif t.name == "Json":
                parts.append(t.value.column())
            else:
                raise InvalidFilterError(f"unknown term {t.name}")
        return all_of(parts)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def valid_at(at: int) -> Column:
    """Whether [valid_from, valid_until) holds the instant; NULL bounds are open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(at))) & (
        F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(at))
    )


def json_compare(body: str, path: str, op: str, value) -> Column:
    """Type-strict comparison with a JSON scalar; text that is no JSON, and a missing path, are false."""
    if op not in OPERATORS:
        raise InvalidFilterError(f"unknown operator {op}")
    found = F.try_variant_get(F.try_parse_json(F.col(body)), path, "variant")
    kind = F.schema_of_variant(found)
    if isinstance(value, bool):
        if op != "eq":
            raise InvalidFilterError("booleans have no order")
        typed, guard = F.try_variant_get(found, "$", "boolean"), kind == "BOOLEAN"
    elif isinstance(value, int):
        number = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
        typed, guard = F.try_variant_get(found, "$", "double" if op != "eq" else "bigint"), (kind == "BIGINT") if op == "eq" else number
    elif isinstance(value, str):
        typed, guard = F.try_variant_get(found, "$", "string"), kind == "STRING"
    else:
        raise InvalidFilterError("a value is a text, a whole number or a boolean")
    literal = F.lit(value)
    test = {"eq": typed == literal, "gt": typed > literal, "gte": typed >= literal, "lt": typed < literal, "lte": typed <= literal}[op]
    return F.coalesce(guard & test, F.lit(False))


def source_type(kind: str = "kind") -> Column:
    """The source type of a kind, or NULL for kinds the vector index does not take."""
    pairs = [F.lit(x) for item in SOURCE_TYPES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(kind))


def canonical_text(value) -> str:
    """A scalar as it is stored in an attribute: booleans are true and false."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def with_attributes(hits: DataFrame, attributes: DataFrame, wanted: tuple[tuple[str, str], ...], declared: set[str]) -> DataFrame:
    """Hits that have every wanted (attribute, text): one semi-join each, before any limit."""
    for name, value in wanted:
        if name not in declared:
            raise InvalidFilterError(f"{name} is not a filterable projection")
        rows = attributes.where((F.col("attr_name") == name) & (F.col("attr_value") == F.lit(canonical_text(value))))
        hits = hits.join(rows.select("write_cursor"), "write_cursor", "left_semi")
    return hits


def checked_limit(limit, low: int = 1, high: int = 100) -> int:
    """A limit is a whole number within its bounds; it is refused otherwise, never clamped."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not low <= limit <= high:
        raise InvalidLimitError(f"limit must be a whole number in {low}..{high}")
    return limit
