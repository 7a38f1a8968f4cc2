"""The keyed store: what runs read and write, versions, and rows against a plain dictionary."""

import random

import pytest

from tidemark.sources import keyed_store


def stored(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_runs_rewrite_touched_buckets_only(spark, tmp_path):
    store, r, want = str(tmp_path / "store"), random.Random(1), {}
    schema = "k long, name string, v int"
    for run in range(4):
        rows = [(None if i == 7 else r.randrange(200), "x", run * 1000 + i) for i in range(60)] * (1 if run % 2 else 2)
        before = keyed_store.manifest(spark, store)["buckets"]
        out = keyed_store.upsert(spark.createDataFrame(rows, schema), store, ["k"], ["v"], replace=run == 3, buckets=16)
        for k in {row[0] for row in rows}:
            first = min(row for row in rows if row[0] == k) if k is not None else min((row for row in rows if row[0] is None), key=lambda x: x[2])
            if k not in want or run == 3:
                want[k] = first
        assert stored(out) == sorted(want.values(), key=str)
        assert keyed_store.manifest(spark, store)["number"] == run + 1
    few = spark.createDataFrame([(1, "new", 5)], schema)
    before = keyed_store.manifest(spark, store)["buckets"]
    out = keyed_store.upsert(few, store, ["k"], ["v"], replace=True)
    after = keyed_store.manifest(spark, store)["buckets"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and len(after) == 16 and (1, "new", 5) in stored(out)
    # A later run of the same key reads that bucket's file and no other.
    plan = keyed_store.read(spark, store, [int(changed[0])]).inputFiles()
    assert plan and all(f"_bucket={changed[0]}/" in f for f in plan)


def test_a_run_without_rows_and_one_that_was_overtaken(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 2)], "k int, v int")
    keyed_store.upsert(rows, store, ["k"], ["v"])
    assert stored(keyed_store.upsert(rows.limit(0), store, ["k"], ["v"])) == [(1, 2)]
    assert keyed_store.manifest(spark, store)["number"] == 1
    with pytest.raises(RuntimeError, match="another run"):
        keyed_store._commit(spark, store, keyed_store.manifest(spark, store))
    with pytest.raises(ValueError, match="other columns"):
        keyed_store.upsert(rows.withColumnRenamed("v", "w"), store, ["k"], ["w"])
    with pytest.raises(ValueError, match="nothing is stored"):
        keyed_store.read(spark, str(tmp_path / "none"))
