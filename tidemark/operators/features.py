"""Column and window features over daily rows of each instrument (F1-F21); windows are over (instrument, date)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(by: str = "instrument", on: str = "date") -> WindowSpec:
    return Window.partitionBy(by).orderBy(on)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); null where either isn't positive."""
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def price_features(bars: DataFrame, by: str = "instrument") -> DataFrame:
    """Returns, their size, Parkinson volatility and the sample deviation of 5 rows (null unless all 5 are there)."""
    w = over(by)
    w5 = w.rowsBetween(-4, 0)
    before = F.lag("close").over(w)
    out = bars.withColumns({
        "cc_return": log_ratio(F.col("close"), before), "overnight_return": log_ratio(F.col("open"), before), "intraday_return": log_ratio(F.col("close"), F.col("open")),
        "parkinson_volatility": F.abs(log_ratio(F.col("high"), F.col("low"))) / math.sqrt(4 * math.log(2)),
    })
    return out.withColumns({
        "abs_return": F.abs("cc_return"), "squared_return": F.pow("cc_return", F.lit(2)),
        "rolling_volatility": F.when(F.count("cc_return").over(w5) == 5, F.stddev_samp("cc_return").over(w5)),
    })


def market_change(bars: DataFrame, name: str, drop_incomplete: bool = False, by: str | None = None) -> DataFrame:
    """log change of the close over the market's own rows, columns prefixed with its name. F8: over all rows, so that a null row
    makes its day and the next null, with drop_incomplete false."""
    if drop_incomplete:
        bars = bars.na.drop(subset=["open", "high", "low", "close"])
    w = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy("date")
    out = bars.withColumn("change", log_ratio(F.col("close"), F.lag("close").over(w)))
    return out.withColumnsRenamed({c: f"{name}_{c}" for c in out.columns if c not in ("date", by)})


def forward_fill(df: DataFrame, columns: list[str], by: str = "instrument", suffix: str = "_ffill") -> DataFrame:
    """the last known value so far."""
    w = over(by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}{suffix}": F.last(c, ignorenulls=True).over(w) for c in columns})


def mask_no_posts(df: DataFrame, sessions: tuple[str, ...] = ("intraday", "overnight")) -> DataFrame:
    """the index of a session without posts becomes null; the stored value stays as _raw."""
    out = df
    for s in sessions:
        c = f"{s}_sentiment_index"
        out = out.withColumns({f"{c}_raw": F.col(c), c: F.when(F.col(f"{s}_no_posts") == 0, F.col(c))})
    return out


def previous_known(df: DataFrame, columns: list[str], by: str = "instrument") -> DataFrame:
    """the last known value of earlier rows takes the column's name; the row's own stays as _reported_same_date."""
    w = over(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{c}_reported_same_date": F.col(c) for c in columns} | {c: F.last(c, ignorenulls=True).over(w) for c in columns})


def lags(df: DataFrame, steps: dict[str, list[int]], by: str = "instrument") -> DataFrame:
    """F13."""
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(over(by)) for c, ks in steps.items() for k in ks})


def leads(df: DataFrame, targets: dict[str, str], by: str = "instrument") -> DataFrame:
    """new column from the next row."""
    return df.withColumns({new: F.lead(c, 1).over(over(by)) for new, c in targets.items()})


def first_difference(df: DataFrame, column: str, by: str = "instrument") -> DataFrame:
    """F16."""
    return df.withColumn(f"{column}_diff", F.col(column) - F.lag(column).over(over(by)))


def numeric(text: Column) -> Column:
    """trimmed, without commas, null where it isn't a number."""
    return F.regexp_replace(F.trim(text.cast("string")), ",", "").try_cast("double")


def date_value(text: Column) -> Column:
    """a date of yyyy-MM-dd, yyyy.MM.dd or yyyy/MM/dd; null where it can't be read."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(text.cast("string")), "[./]", "-"), F.lit("yyyy-MM-dd")))


def require_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """raises with the number of rows whose text in one of the columns isn't a date; null texts pass."""
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & date_value(F.col(c)).isNull()).alias(c) for c in columns]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"unreadable dates: { {c: n for c, n in bad.items() if n} }")
    return df


def position(df: DataFrame, by: str = "instrument") -> DataFrame:
    """0-based place in date order."""
    return df.withColumn("position", F.row_number().over(over(by)) - 1)


#: M8: the nine base features of the models, and those with the sentiments.
BASE_FEATURES = ("rolling_volatility", "rolling_volatility_lag1", "rolling_volatility_lag2", "rolling_volatility_lag3", "cc_return_lag1", "vix_change", "vix_change_lag1", "market_change", "second_change")
SENTIMENT_FEATURES = (*BASE_FEATURES, "sentiment_intraday", "sentiment_overnight")
TARGETS = ("target_vol_5d", "target_vol_pk")
#: Rows with a null in one of these go; the lags before the third follow from it, and the intraday sentiment may be null.
COMPLETE = ("rolling_volatility_lag3", "vix_change_lag1", "market_change", "second_change", "sentiment_overnight", *TARGETS)


def feature_table(bars: DataFrame, market: DataFrame, sentiment: DataFrame, by: str = "instrument") -> DataFrame:
    """Lags of volatility, return and the volatility index's change, both markets' changes of the day, the sentiments known
    before the target (the next day's overnight session), next-row targets; complete cases only."""
    rows = price_features(bars, by).join(market.select("date", "market_change", "second_change", "vix_change"), "date", "left").join(sentiment, [by, "date"], "left")
    rows = lags(rows, {"rolling_volatility": [1, 2, 3], "cc_return": [1], "vix_change": [1]}, by)
    rows = leads(rows, {"sentiment_overnight": "overnight_sentiment_index", "target_vol_5d": "rolling_volatility", "target_vol_pk": "parkinson_volatility"}, by)
    return rows.withColumn("sentiment_intraday", F.col("intraday_sentiment_index")).na.drop(subset=list(COMPLETE))
