"""Multiple testing and small-sample tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dist


def adjust(tests: DataFrame, p: str = "p_value", status: str = "status", family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """p_bh, p_bonferroni and their verdicts over each family of rows with status OK; other rows get null and false.

    Families are result tables, not data; without ``family`` all rows are one.
    """
    keys = [F.col(c) for c in family or []] or [F.lit(0)]
    ok = (F.col(status) == "OK") & F.col(p).isNotNull()
    w = Window.partitionBy(*keys, ok)
    ranked = tests.withColumns({"_m": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(p))})
    later = w.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(later))
    out = ranked.withColumns({"p_bh": F.when(ok, bh), "p_bonferroni": F.when(ok, F.least(F.lit(1.0), F.col(p) * F.col("_m")))}).drop("_m", "_k")
    return out.withColumns({f"reject_{n}": F.coalesce(F.col(f"p_{n}") <= alpha, F.lit(False)) for n in ("bh", "bonferroni")})


def tallies(adjusted: DataFrame, p: str = "p_value", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """How many tests there are, and how many are significant raw and adjusted."""
    count = lambda c: F.count_if(F.col(c) < alpha)
    return adjusted.groupBy(*(by or [])).agg(F.count(p).alias("tests"), count(p).alias("raw"), count("p_bh").alias("bh"), count("p_bonferroni").alias("bonferroni"))


def t_statistic(x: Column) -> Column:
    """A14 as an aggregate: mean over its standard error; null below two rows or without spread."""
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) > 0), F.avg(x) / (F.stddev_samp(x) / F.sqrt(F.count(x))))


def t_test(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """N, mean, statistic and two-sided p_value."""
    x = F.col(value)
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), t_statistic(x).alias("statistic"))
    return out.withColumn("p_value", dist.t_two_sided(F.col("statistic"), F.col("n") - 1))


def _exact_less(n: Column, w: Column) -> Column:
    """P(W+ <= w) without ties: counts of rank sums grow rank by rank in an array of n(n+1)/2 + 1 places."""
    top = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda c, r: F.transform(c, lambda v, i: v + F.when(i >= r, F.element_at(c, F.greatest(i - r, F.lit(0)) + 1)).otherwise(0.0)))
    return F.aggregate(F.slice(counts, 1, w.cast("int") + 1), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), n)


def wilcoxon(df: DataFrame, by: list[str], value: str, exact_most: int = 50) -> DataFrame:
    """Signed-rank test: n (zeros dropped), w_plus, z, p_two_sided and p_less.

    Exact for at most ``exact_most`` values without ties or zeros, else the normal approximation with the correction for ties. Below two
    rows p is null; if all values are zero it is 1.
    """
    x = F.col(value)
    rows = df.filter(x.isNotNull())
    every = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    w = Window.partitionBy(*by)
    size = w.orderBy(F.abs(x))
    same = Window.partitionBy(*by, F.abs(x))
    ranked = rows.filter(x != 0).withColumns({"_t": F.count(F.lit(1)).over(same), "_r": F.rank().over(size)})
    ranked = ranked.withColumn("_rank", F.col("_r") + (F.col("_t") - 1) / 2)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(x > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"), F.sum(t * t - 1).alias("_ties"), (F.max("_t") > 1).alias("_tied"))
    out = every.join(sums, by, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "w_plus": F.coalesce("w_plus", F.lit(0.0))})
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("_ties", F.lit(0.0)) / 48
    out = out.withColumn("z", F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var)))
    exact = (F.col("n") <= exact_most) & ~F.coalesce("_tied", F.lit(False)) & (F.col("n") == F.col("_all")) & (F.col("n") > 0)
    less = F.when(exact, _exact_less(F.col("n"), F.col("w_plus")))
    least = F.least(F.col("w_plus"), n * (n + 1) / 2 - F.col("w_plus"))
    both = F.when(exact, F.least(F.lit(1.0), 2 * _exact_less(F.col("n"), least)))
    few, zero = F.col("_all") < 2, F.col("n") == 0
    return out.select(*by, "n", "w_plus", "z", F.when(few, None).when(zero, 1.0).otherwise(F.coalesce(both, dist.two_sided_normal(F.col("z")))).alias("p_two_sided"),
                      F.when(few, None).when(zero, 1.0).otherwise(F.coalesce(less, dist.normal_cdf(F.col("z")))).alias("p_less"))


def sign_test(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values that aren't zero, the positive ones, P(at least so many) and the two-sided p."""
    x = F.col(value)
    out = df.groupBy(*by).agg(F.count_if(x != 0).alias("n"), F.count_if(x > 0).alias("positive"))
    n, k = F.col("n"), F.col("positive")
    return out.withColumns({"p_greater": F.when(n > 0, dist.binomial_tail(n, k)), "p_two_sided": F.when(n > 0, dist.binomial_two_sided(n, k))})


def bias_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts by sign, share of negatives among all, mean, median and deviation, and the one-sided tests that negatives prevail."""
    x = F.col(value)
    known = df.filter(x.isNotNull())
    base = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x < 0).alias("negative"), F.count_if(x > 0).alias("positive"), F.count_if(x == 0).alias("zero"),
        F.avg((x < 0).cast("double")).alias("negative_ratio"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std"))
    tail = dist.binomial_tail(F.col("negative") + F.col("positive"), F.col("negative"))
    signed = wilcoxon(known, by, value).select(*by, F.col("p_less").alias("p_wilcoxon"))
    return base.withColumn("p_sign", tail).join(signed, by)
