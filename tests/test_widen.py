import datetime as dt
import random

import pytest

from lorespark.functions import values
from lorespark.operators.widen import filled_cells, widen

DECLARED = {"status": "text", "retries": "integer", "score": "number", "ok": "boolean", "due_on": "date"}
SCHEMA = "write_cursor bigint, attr_name string, attr_value string, landed_at timestamp"
AT = dt.datetime(2026, 3, 1)


@pytest.mark.parametrize(
    "kind, value, want",
    [
        ("integer", " +1,936.00\t", 1936), ("integer", "-0", 0), ("integer", "1,2,3", None), ("integer", "2.5", None),
        ("integer", "0x1f", None), ("integer", "", None), ("integer", "٣", None), ("integer", "9" * 25, None),
        ("number", "-8.92E-01", values.Decimal("-0.892")), ("number", "358,926.511", values.Decimal("358926.511")),
        ("number", "NaN", None), ("number", "1e", None), ("number", ".", None), ("number", "1e999", None),
        ("boolean", "Off", False), ("boolean", " Y ", True), ("boolean", "tru", None), ("boolean", "-1", None),
        ("date", "2026/02/29", None), ("date", "20240229", 19782), ("date", "May 12, 2025", 20220), ("date", "2 Apr 2026", 20545),
        ("date", "1759159918", 20360), ("date", "2026-12-04 03:43:00", 20791), ("date", "2025-04-07T13:45:32Z", 20185),
        ("date", "2026-4", None), ("date", "next week", None), ("date", "12 Foo 2025", None),
        ("text", "  ", None), ("text", " a b ", "a b"),
    ],
)
def test_readers(kind, value, want):
    assert values.READERS[kind](value) == want


def brute(rows):
    last = {}
    for e, n, v, at in rows:
        if e is None or n is None:
            continue
        k = n.strip().replace("-", "_").lower()
        if k in DECLARED:
            key = (at or dt.datetime.min, v is not None, v or "")
            last[e, k] = max(last.get((e, k), key), key)
    out = {}
    for (e, k), (_, there, v) in last.items():
        cell = values.READERS[DECLARED[k]](v) if there else None
        if cell is not None:
            if k == "score":
                cell = int(round(cell * 1000))
            elif k == "due_on":
                cell = dt.date.fromordinal(cell + dt.date(1970, 1, 1).toordinal())
            out[e, k] = str(cell).lower() if k == "ok" else str(cell)
    return out


def sample(seed):
    rng = random.Random(seed)
    words = {
        "status": ["open", " done ", "", "x" * 5000, "日本"], "retries": ["1", "+2.0", "n/a", "-3", "1,000"],
        "score": ["1.5", "2e3", "NaN", "-0.25", "7"], "ok": ["yes", "F", "maybe", "1"], "due_on": ["2026-01-02", "3 Mar 2025", "tbd"],
        "other": ["z"],
    }
    rows = []
    for _ in range(3000):
        n = rng.choice(list(words))
        e = 7 if rng.random() < 0.35 else rng.choice([None, *range(400)])
        v = rng.choice([None, *words[n]])
        at = rng.choice([None, AT + dt.timedelta(seconds=rng.randrange(50))])
        rows.append((e, rng.choice([n, n.upper(), f" {n}\t", n.replace("_", "-")]), v, at))
    return rows + rows[:300] + [(3, None, "1", AT)]


def test_wide_table_matches_brute_force(spark):
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for batch in ("4096", "7"):  # entities straddle batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        wide = widen(df, DECLARED)
        got = {(r.write_cursor, r.attr_name): r.cell for r in filled_cells(wide, DECLARED).collect()}
        assert got == brute(rows)
        entities = [r.write_cursor for r in wide.collect()]
        assert len(entities) == len(set(entities))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert dict(wide.dtypes) == {
        "write_cursor": "bigint", "status": "string", "retries": "bigint", "score": "double", "ok": "boolean", "due_on": "date"
    }


def test_large_and_tiny_numbers_in_cells(spark):
    rows = [(1, "score", "1e300", AT), (2, "score", "1e-300", AT), (3, "score", "-123456789012.345", AT)]
    wide = widen(spark.createDataFrame(rows, SCHEMA), DECLARED)
    got = {r.write_cursor: r.cell for r in filled_cells(wide, DECLARED).collect()}
    assert got[2] == "0" and got[3] == "-123456789012345" and got[1] == "1" + "0" * 303


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "status", "a", AT, "x", 5)], SCHEMA + ", e string, status int")
    assert [tuple(r) for r in widen(df, DECLARED).collect()] == [(1, "a", None, None, None, None)]
    assert widen(df.where("false"), DECLARED).collect() == []
    assert widen(df, {}).collect() == []
