"""Entity, attribute, value rows to one wide, typed row per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import values

#: Spark type of the wide column of each declared type. Numbers are doubles; 15 digits hold exactly.
SPARK_TYPES = {"text": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date"}
#: White space that does not matter at the ends of a name.
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_ENDS = f"^{_SPACE}|{_SPACE}$"


def plain_name(name):
    """The form in which stored and declared names are compared."""
    return F.lower(F.translate(F.regexp_replace(name, _ENDS, ""), "-", "_"))


def latest(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key with the value of its latest row.

    NULL order counts as earliest; among equal orders a value beats NULL and the greater value wins.
    """
    last = F.max(F.struct(F.col(order).alias("o"), F.col(value).isNotNull().alias("f"), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, F.col("__last.v").alias(value))


class _Block:
    """Scatters the rows of whole entities into one numpy array per column."""

    def __init__(self, names: list[str], types: list[str], entity: pa.DataType):
        self.names, self.types, self.entity = names, types, entity

    def table(self, entity: np.ndarray, attr: np.ndarray, value: pa.Array) -> pa.RecordBatch | None:
        """entity: sorted keys; attr: column indexes; value: strings."""
        starts = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])
        row = np.cumsum(np.r_[False, entity[1:] != entity[:-1]])
        coded = value.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_pylist()
        n = len(starts)
        columns = [pa.array(entity[starts], type=self.entity)]
        for k, kind in enumerate(self.types):
            mine = np.flatnonzero(attr == k)
            used, back = np.unique(codes[mine], return_inverse=True)
            read = values.READERS[kind]
            cells = [read(words[c]) for c in used.tolist()]  # each distinct value is read once
            good = np.array([c is not None for c in cells], dtype=bool)[back] if len(mine) else np.zeros(0, bool)
            to, empty = row[mine[good]], np.ones(n, dtype=bool)
            empty[to] = False
            if kind == "text":
                out = np.full(n, None, dtype=object)
                out[to] = np.array(cells, dtype=object)[back[good]]
                columns.append(pa.array(out, type=pa.string()))
                continue
            dtype = {"integer": np.int64, "number": np.float64, "boolean": bool, "date": np.int32}[kind]
            out = np.zeros(n, dtype=dtype)
            if len(used):
                out[to] = np.array([dtype(c) if c is not None else dtype(0) for c in cells])[back[good]]
            if kind == "date":
                columns.append(pa.array(out, type=pa.int32(), mask=empty).cast(pa.date32()))
            else:
                columns.append(pa.array(out, mask=empty))
        return pa.RecordBatch.from_arrays(columns, names=["entity", *self.names])


def widen(
    df: DataFrame,
    declared: dict[str, str],
    entity: str = "write_cursor",
    name: str = "attr_name",
    value: str = "attr_value",
    order: str = "landed_at",
) -> DataFrame:
    """One row per entity, with one column of the declared type for each declared attribute.

    ``declared`` maps attribute names to text, integer, number, boolean or date. A stored name means
    a declared one if it differs only in case, white space at its ends, or ``-`` for ``_``; other
    names are left out. Of the rows of an entity and attribute the latest by ``order`` decides (NULL
    is earliest; of equal ones a value beats NULL, the greater value wins); if its value is NULL or
    denotes no value of the type, the cell is NULL. Entities all of whose cells are NULL still have
    a row; NULL entities have none; repeated rows change nothing; an empty table gives no rows.
    Entities must be whole numbers. Other columns of df are ignored.

    Rows are reduced to one per entity and attribute first, with partial aggregation, so that an
    entity has at most one row per declared attribute however often it was written. Those are
    bucketed by a hash of the entity and sorted; each Arrow batch then has its values dictionary-encoded,
    each distinct value read once, and the cells scattered into numpy arrays by row and column.
    An entity that straddles batches is carried over, so memory is that of a batch.
    """
    names = list(declared)
    kinds = [declared[n] for n in names]
    code: dict[str, int] = {}
    for k, n in enumerate(names):
        code.setdefault(n.strip().replace("-", "_").lower(), k)
    pairs = [x for n, k in code.items() for x in (F.lit(n), F.lit(k))]
    column = F.try_element_at(F.create_map(*pairs), plain_name(F.col(name))) if pairs else F.lit(None).cast("int")
    cells = latest(
        df.select(F.col(entity).cast("bigint").alias("e"), column.alias("a"), F.col(value).alias("v"), F.col(order).alias("o"))
        .where("e IS NOT NULL AND a IS NOT NULL"),
        ["e", "a"],
        "v",
        "o",
    )

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rest = _Block(names, kinds, pa.int64()), None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            e = table.column("e").to_numpy()
            if not len(e):
                continue
            cut = int(np.searchsorted(e, e[-1], side="left"))  # the last entity may go on
            rest = table.slice(cut)
            if cut:
                done = table.slice(0, cut)
                yield block.table(e[:cut], done.column("a").to_numpy(), done.column("v").combine_chunks())
        if rest is not None and rest.num_rows:
            rest = rest.combine_chunks()
            yield block.table(rest.column("e").to_numpy(), rest.column("a").to_numpy(), rest.column("v").combine_chunks())

    # NULL values stay as rows, so that their entity has a row; no reader takes the empty text.
    ready = cells.select("e", "a", F.coalesce("v", F.lit("")).alias("v")).repartition("e").sortWithinPartitions("e")
    schema = ", ".join(["entity bigint", *(f"`{n}` {SPARK_TYPES[k]}" for n, k in zip(names, kinds))])
    wide = ready.mapInArrow(scatter, schema)
    return wide.withColumnRenamed("entity", entity)


def filled_cells(wide: DataFrame, declared: dict[str, str], entity: str = "write_cursor") -> DataFrame:
    """(entity, attr_name, cell): the filled cells of a wide table in one text form.

    Text as it is, integers in plain digits, numbers times 1,000 as a whole number, true or false,
    and days as YYYY-MM-DD.
    """
    def form(n: str, kind: str):
        c = F.col(f"`{n}`")
        if kind == "number":
            small = F.round(c.try_cast("decimal(38,12)") * 1000, 0).cast("decimal(38,0)").cast("string")
            return F.coalesce(small, F.concat(F.translate(F.format_number(c, 0), ",", ""), F.lit("000")))
        return c.cast("string")

    cells = F.array(*(F.struct(F.lit(n).alias("attr_name"), form(n, k).alias("cell")) for n, k in declared.items()))
    return (
        wide.select(entity, F.explode(cells).alias("x"))
        .where("x.cell IS NOT NULL")
        .select(entity, "x.attr_name", "x.cell")
    )
