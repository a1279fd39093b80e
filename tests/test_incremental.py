import datetime as dt
import random

import pytest

from lorespark.operators.incremental import IncrementalStore, changed_since
from lorespark.runtime import filesystem, scratch_path

SCHEMA = "k bigint, a string, v string, at timestamp"
T0 = dt.datetime(2026, 3, 1)
ARGS = ("k", "a", "v", "at")


def log(rng, n, start, keys=5000):
    out = []
    for i in range(n):
        k = 77 if rng.random() < 0.3 else rng.choice([None, *range(0, keys, 7)])
        out.append((k, rng.choice([None, "x", "y", f"z{rng.randrange(50)}"]), rng.choice([None, "null", "1", "2"]), T0 + dt.timedelta(seconds=start + i)))
    return out


def state(rows):
    last = {}
    for k, a, v, at in rows:
        key = (at or dt.datetime.min, v is not None, v or "")
        last[k, a] = max(last.get((k, a), key), key)
    return {x: (v if there else None) for x, (_, there, v) in last.items()}


def pairs(df):
    return sorted(((r.k, r.a) for r in df.collect()), key=str)


def differing(old, new):
    return sorted((x for x in new if x not in old or old[x] != new[x]), key=str)


def test_changes_match_brute_force(spark):
    rng = random.Random(2)
    rows = log(rng, 3000, 0) + [(5, "late", "1", None)]
    rows += rows[:200]
    cut = T0 + dt.timedelta(seconds=2800)
    df = spark.createDataFrame(rows, SCHEMA)
    found = changed_since(df, cut, scratch_path(spark, "inc"), *ARGS)
    assert pairs(found) == differing(state([r for r in rows if r[3] and r[3] <= cut]), state(rows))


def test_nothing_changed_and_no_run(spark):
    rows = log(random.Random(3), 300, 0)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", node int")
    assert changed_since(df, T0 + dt.timedelta(days=9), scratch_path(spark, "inc"), *ARGS).collect() == []
    assert pairs(changed_since(df, None, scratch_path(spark, "inc"), *ARGS)) == sorted(state(rows), key=str)
    assert changed_since(df.where("false"), None, scratch_path(spark, "inc"), *ARGS).collect() == []


STEPS = ["_write_blocks", "_changes", "publish"]


@pytest.mark.parametrize("step, when", [("_write_blocks", "after"), ("_changes", "after"), ("publish", "before"), ("publish", "after")])
def test_a_run_killed_at_any_step_loses_and_repeats_nothing(spark, monkeypatch, step, when):
    """Each change is in the published outputs exactly once, wherever an earlier try was killed."""
    rng = random.Random(STEPS.index(step))
    store = IncrementalStore(spark, scratch_path(spark, "inc"), *ARGS, block_bits=12)
    rows = log(rng, 150, 0, 9000)
    store.run(spark.createDataFrame(rows, SCHEMA))
    rows += log(rng, 60, 1000, 9000)
    df, real = spark.createDataFrame(rows, SCHEMA), getattr(IncrementalStore, step)

    def dies(self, *args):
        if when == "after":
            out = real(self, *args)
            if step == "_changes":
                out.collect()
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(IncrementalStore, step, dies)
        with pytest.raises(RuntimeError):
            store.run(df)
    store.run(df)
    values, seen = {}, []
    for version in store.manifest()["outputs"]:
        part = {(r.k, r.a): r.v for r in store.output(version).collect()}
        seen.append(part)
        values |= part
    assert values == state(rows)
    assert sum(map(len, seen[1:])) == len(differing(state(rows[:150]), state(rows)))
    fs, place = filesystem(spark, store.path)
    names = {s.getPath().getName() for s in fs.listStatus(place)} - {"CURRENT"}
    assert names <= {store.current(), *store.manifest()["outputs"], *store._holders(store.current())}


def test_runs_write_in_proportion_to_what_changed(spark):
    """Of 40 blocks one changes: it is written anew, the others stay where they are, and reading them back gives the whole state."""
    store = IncrementalStore(spark, scratch_path(spark, "inc"), *ARGS, block_bits=12)
    rows = [(k, a, "1", T0) for k in range(0, 40 * 4096, 64) for a in ("x", "y")]
    store.run(spark.createDataFrame(rows, SCHEMA))
    first = store.current()
    rows.append((5 * 4096 + 64, "x", "2", T0 + dt.timedelta(seconds=1)))
    assert [(r.k, r.a, r.v, r.change) for r in store.run(spark.createDataFrame(rows, SCHEMA)).collect()] == [(5 * 4096 + 64, "x", "2", "changed")]
    assert {r.version: r["count"] for r in store._index(store.current()).groupBy("version").count().collect()} == {first: 39, store.current(): 1}
    fs, place = filesystem(spark, store.path)
    size = {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(place)}
    assert size[store.current()] < size[first] / 4
    assert {(r.k, r.a): r.v for r in store.state(store.current()).collect()} == state(rows)


def test_transform_is_what_is_published_and_versions_are_gathered(spark, monkeypatch):
    monkeypatch.setattr("lorespark.operators.incremental.MOST_VERSIONS", 2)
    store = IncrementalStore(spark, scratch_path(spark, "inc"), *ARGS, block_bits=12)
    rows = [(k * 4096, "x", "1", T0) for k in range(6)]
    for step in range(4):
        rows.append((step * 4096, "x", f"n{step}", T0 + dt.timedelta(seconds=step + 1)))
        store.run(spark.createDataFrame(rows, SCHEMA), lambda c: c.groupBy("change").count())
        assert {(r.k, r.a): r.v for r in store.state(store.current()).collect()} == state(rows)
        assert len(store._holders(store.current())) <= 3
    assert [sum(r["count"] for r in store.output(v).collect()) for v in store.manifest()["outputs"]] == [6, 1, 1, 1]


def test_removed_keys_are_reported(spark):
    store = IncrementalStore(spark, scratch_path(spark, "inc"), *ARGS)
    df = spark.createDataFrame([(1, "x", "1", T0), (900, "y", None, T0)], SCHEMA)
    store.run(df)
    found = store.run(df.where("k = 1")).collect()
    assert [(r.k, r.a, r.change) for r in found] == [(900, "y", "removed")]
