"""Ranks, suffix minima and exact quantiles of groups too large for a task.

Equal values are one row with a count before anything is sorted, so that a value that repeats without end is a sum. What is
left is dealt by ranges of (key, value): running sums are taken within each range, and what earlier or later ranges add is
carried over a table with a row for each key and range. Quantiles need no sort: counts by parts of the range of values narrow
to the part that holds a rank, again and again, until it holds one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.sources.shared import discard, settle

#: Parts of a range of values that a pass counts.
PARTS = 1024


def _finite(df: DataFrame, by: list[str], value: str) -> DataFrame:
    # Adding zero makes the negative zero equal to zero.
    x = F.col(value).cast("double") + F.lit(0.0)
    return df.select(*by, x.alias("value")).filter(F.col("value").isNotNull() & (F.abs("value") < float("inf")))


def value_ranks(df: DataFrame, by: list[str], value: str, sums: dict | None = None) -> DataFrame:
    """by, value (double), n (rows of it), before (rows of lesser values), total (rows of the key), part (its range) and ``sums`` (name:
    aggregate over the rows of a value), written to the shared folder. Nulls and values that aren't finite take no part.

    Ranges follow a sample that another attempt would draw anew, so ranges are written before they are counted."""
    x = F.col(value).cast("double") + F.lit(0.0)
    rows = df.withColumn("_value", x).filter(F.col("_value").isNotNull() & (F.abs("_value") < float("inf")))
    each = rows.groupBy(*by, F.col("_value").alias("value")).agg(F.count(F.lit(1)).alias("n"), *[a.alias(c) for c, a in (sums or {}).items()])
    dealt = settle(each.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*by, "part").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*by)
    parts = parts.withColumns({"_start": F.coalesce(F.sum("_n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(w)}).drop("_n")
    inside = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, [*by, "part"])
    out = settle(found.withColumn("before", F.col("_start") + F.col("_inside")).drop("_start", "_inside"), "ranks")
    discard(dealt)
    return out


def adjusted_values(df: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """By, value (each different p), n and p_bh, the Benjamini-Hochberg adjustment over the key's rows: the least p * m / rank of this and
    all greater p. The rows meet it by equality on p."""
    ranks = value_ranks(df, by, p).withColumn("_q", F.col("value") * F.col("total") / (F.col("before") + F.col("n")))
    after = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranks.groupBy(*by, "part").agg(F.min("_q").alias("_least")).withColumn("_later", F.min("_least").over(after)).drop("_least")
    here = Window.partitionBy(*by, "part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranks.withColumn("_here", F.min("_q").over(here)).join(parts, [*by, "part"])
    return out.select(*by, "value", "n", F.least(F.lit(1.0), "_here", F.coalesce("_later", F.lit(1.0))).alias("p_bh"))


def signed_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A15 of large groups: n (zeros dropped), w_plus, z and p_two_sided by the normal approximation with the correction for ties."""
    x = F.col(value).cast("double")
    ranks = value_ranks(df.filter(x != 0).withColumn("_size", F.abs(x)), by, "_size", {"_plus": F.count_if(x > 0)})
    n, t = F.col("n").cast("double"), F.col("total").cast("double")
    sums = ranks.groupBy(*by).agg(F.max("total").alias("n"), F.sum(F.col("_plus") * (F.col("before") + (n + 1) / 2)).alias("w_plus"), F.sum(n * n * n - n).alias("_ties"), F.max(t).alias("_t"))
    t = F.col("_t")
    mean, var = t * (t + 1) / 4, t * (t + 1) * (2 * t + 1) / 24 - F.col("_ties") / 48
    out = sums.withColumn("z", F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var)))
    return out.select(*by, "n", "w_plus", "z", dist.two_sided_normal(F.col("z")).alias("p_two_sided"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """By, share and quantile (linear between the two neighbouring ranks) of each key's values, exact.

    Every pass is a count by (key, range, part), combined before the shuffle, with at most PARTS rows for each range that still
    holds several values; the first and the last value of a range fall into different parts, so each pass narrows. Nulls and
    values that aren't finite take no part; keys without values give no row."""
    rows = _finite(df, by, value)
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("low"), F.max("value").alias("high"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    place = F.col("share") * (F.col("_n") - 1)
    wanted = ends.withColumn("share", share).withColumn("rank", F.explode(F.array(F.floor(place), F.ceil(place)))).withColumn("at", F.col("rank"))
    state = settle(wanted.select(*by, "share", "rank", "at", "_n", "low", "high").distinct(), "narrowed")
    while True:
        open_ranges = state.filter("low < high").select(*by, "low", "high").distinct()
        if open_ranges.isEmpty():
            break
        inside = rows.join(open_ranges, by).filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
        # Halves, so that no difference overflows.
        share_of = F.coalesce(F.try_divide(F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), F.lit(0.0))
        part = F.when(F.col("value") == F.col("high"), PARTS - 1).when(F.col("value") == F.col("low"), 0).otherwise(F.least(F.lit(PARTS - 1), F.floor(share_of * PARTS)))
        counts = inside.groupBy(*by, "low", "high", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
        w = Window.partitionBy(*by, "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        met = state.filter("low < high").join(counts, [*by, "low", "high"]).filter("at >= before AND at < before + n")
        narrowed = met.select(*by, "share", "rank", (F.col("at") - F.col("before")).alias("at"), "_n", F.col("a").alias("low"), F.col("b").alias("high"))
        last, state = state, settle(narrowed.unionByName(state.filter("low = high")), "narrowed")
        discard(last)
    place = F.col("share") * (F.col("_n") - 1)
    low, high = F.min("low"), F.max("low")
    return state.groupBy(*by, "share").agg((low + (high - low) * F.max(place - F.floor(place))).alias("quantile"))
