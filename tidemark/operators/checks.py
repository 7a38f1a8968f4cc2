"""Quality checks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """K1: raises with the number of surplus rows where keys repeat."""
    extra = df.groupBy(*keys).count().agg(F.sum(F.col("count") - 1)).first()[0] or 0
    if extra:
        raise ValueError(f"{extra} rows repeat the keys {keys}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def flag_conflicts(df: DataFrame, sessions: tuple[str, ...] = ("intraday", "overnight"), by: str = "instrument") -> DataFrame:
    """K2: rows of each instrument whose count and no_posts flag disagree."""
    return df.groupBy(by).agg(*[F.count_if((F.col(f"{s}_item_count") == 0) != (F.col(f"{s}_no_posts") == 1)).alias(f"{s}_conflicts") for s in sessions])


def require_flags(df: DataFrame) -> DataFrame:
    total = flag_conflicts(df).agg(F.sum(F.col("intraday_conflicts") + F.col("overnight_conflicts"))).first()[0] or 0
    if total:
        raise ValueError(f"{total} rows have flags that disagree with their counts")
    return df


def drop_missing_prices(df: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume"), by: str = "instrument") -> tuple[DataFrame, DataFrame]:
    """rows with all prices, and how many each instrument lost."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.filter(~missing), df.groupBy(by).agg(F.count_if(missing).alias("missing_price_rows"))


def qa_summary(df: DataFrame, by: str = "instrument") -> DataFrame:
    """K3: one row per instrument in one pass; where the filled sentiments are columns, also how many analysed rows still have none."""
    missing = F.col("close").isNull()
    filled = [s for s in ("intraday", "overnight") if f"{s}_sentiment_index_ffill" in df.columns]
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(~missing).alias("analysis_rows"), F.count_if(missing).alias("excluded_rows"),
        F.min(F.when(~missing, F.col("date"))).alias("first_date"), F.max(F.when(~missing, F.col("date"))).alias("last_date"),
        (F.count("date") - F.count_distinct("date")).alias("duplicate_dates"),
        F.count_if(F.col("intraday_no_posts") == 1).alias("intraday_no_post_days"), F.count_if(F.col("overnight_no_posts") == 1).alias("overnight_no_post_days"),
        *[F.count_if(~missing & F.col(f"{s}_sentiment_index_ffill").isNull()).alias(f"{s}_missing_after_fill") for s in filled],
    )


def distribution(df: DataFrame, columns: list[str], by: str = "instrument", near: float = 0.05) -> DataFrame:
    """K4: mean, deviation, ends and the share of values nearer to zero than ``near``; one row per instrument and column."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(by, "x.*")
    value = F.col("value")
    return long.filter(value.isNotNull()).groupBy(by, "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg((F.abs(value) < near).cast("double")).alias("near_zero_share"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 15, by: str = "instrument") -> DataFrame:
    """K5: counts of equal bins, the last one closed at the right; values outside are dropped, empty bins are rows."""
    x = F.col(column).cast("double")
    inside = df.filter((x >= low) & (x <= high))
    number = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def pooled(*frames: DataFrame) -> DataFrame:
    """K6: all rows, columns that one side lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def span(df: DataFrame, by: str, on: str) -> DataFrame:
    """K8."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("first"), F.max(on).alias("last"))


def candles(bars: DataFrame) -> DataFrame:
    """K9: direction, low edge and height of each body."""
    return bars.select("instrument", "date", (F.col("close") >= F.col("open")).alias("up"), F.least("open", "close").alias("body_low"), F.abs(F.col("close") - F.col("open")).alias("body_height"), "high", "low")
