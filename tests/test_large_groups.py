"""Ranks, adjustments and quantiles of large groups against pandas and Spark's own functions; a hot key goes over many tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import large_groups


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(4)
    parts = [("hot", r.normal(size=4000)), ("ties", r.integers(-3, 4, 1500).astype(float)), ("one", np.array([2.5])), ("same", np.full(300, 7.0)),
             ("wide", np.concatenate([[1e308, -1e308, 5e-324, -0.0, 0.0], 10.0 ** r.integers(-300, 300, 200)]))]
    own = pd.DataFrame([(k, float(v)) for k, x in parts for v in x] + [("hot", float("nan"))], columns=["k", "v"])
    rows = [(k, None if v != v else v) for k, v in own.itertuples(index=False)] + [("none", None), ("hot", float("inf"))]
    return own.dropna(), spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_quantiles(spark, values):
    own, df = values
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {(r["k"], r["share"]): r["quantile"] for r in large_groups.quantiles(df, ["k"], "v", shares).collect()}
    assert len(got) == 5 * len(shares)
    for k, rows in own.groupby("k"):
        x = np.sort(rows["v"].to_numpy())
        for s in shares:
            place = s * (len(x) - 1)
            a, b = x[int(np.floor(place))], x[int(np.ceil(place))]
            with np.errstate(over="ignore"):
                assert got[k, s] == a + (b - a) * (place - np.floor(place)) or np.isclose(got[k, s], a + (b - a) * (place - np.floor(place)), rtol=1e-12)
    assert large_groups.quantiles(df.limit(0), ["k"], "v", shares).collect() == []


def test_adjustment(spark, values):
    own, df = values
    p = own[own["k"].isin(["hot", "ties", "one", "same"])].assign(p=lambda x: 1 / (1 + np.exp(-x["v"])))
    got = {(r["k"], r["value"]): (r["n"], r["p_bh"]) for r in large_groups.adjusted_values(spark.createDataFrame(p).repartition(3), ["k"], "p").collect()}
    for k, rows in p.groupby("k"):
        x = np.sort(rows["p"].to_numpy())
        q = np.minimum(1, np.minimum.accumulate((x * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1])
        for v in np.unique(x):
            n, bh = got[k, v]
            assert n == (x == v).sum() and np.isclose(bh, q[x == v].min(), rtol=1e-12)


def test_signed_ranks(spark, values):
    own, df = values
    got = {r["k"]: r for r in large_groups.signed_ranks(df, ["k"], "v").collect()}
    for k, rows in own.groupby("k"):
        x = rows["v"].to_numpy()
        x = x[x != 0]
        assert got[k]["n"] == len(x) and np.isclose(got[k]["w_plus"], pd.Series(np.abs(x)).rank().to_numpy()[x > 0].sum())


def test_a_hot_key_goes_over_many_tasks(spark):
    """A million values of one key are dealt over all shuffle partitions (adaptive execution merges small ones, so not here)."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.xxhash64("id") % 500_000).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = large_groups.value_ranks(df, ["k"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n"] for r in ranks.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert len(parts) >= 3 and max(parts) < 500_000 and sum(parts) == 1_000_000
    assert ranks.agg(F.max(F.col("before") + F.col("n"))).first()[0] == 1_000_000
