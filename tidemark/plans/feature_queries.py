"""Queries over daily bars: features and quality checks (F, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.operators import features as X
from tidemark.plans import tables as T
from tidemark.plans.base import registry, rounded

QUERIES, ORACLES, register = registry()


def _rounds(*names: str) -> str:
    return ", ".join(f"round({n}, 8) AS {n}" for n in names)


_RETURNS = ("cc_return", "overnight_return", "intraday_return", "abs_return", "squared_return", "parkinson_volatility", "rolling_volatility")


@register(f"WITH {T.BARS} SELECT instrument, date, open, high, low, close, round(volume, 6) AS volume FROM bars")
def d3_daily_bars(spark, d):
    return rounded(T.bars(spark, d), 6)


@register(f"WITH {T.RETURNS} SELECT instrument, date, {_rounds(*_RETURNS)} FROM featured")
def f1_f6_price_features(spark, d):
    return rounded(X.price_features(T.bars(spark, d)).select("instrument", "date", *_RETURNS))


@register(f"WITH {T.MARKET}, k AS (SELECT * FROM market WHERE volume > 100) SELECT date, round(ln(close / lag(close) OVER (ORDER BY date)), 8) AS market_change FROM k")
def f7_market_change(spark, d):
    """Incomplete days (here: of small volume) go first, so changes bridge them."""
    ok = F.col("volume") > 100
    gaps = T.market_bars(spark, d).withColumns({c: F.when(ok, F.col(c)) for c in ("open", "high", "low", "close")})
    return rounded(X.market_change(gaps, "market", drop_incomplete=True).select("date", "market_change"))


@register(f"WITH {T.MARKET}, k AS (SELECT date, CASE WHEN volume > 100 THEN close END AS close FROM market) SELECT date, round(ln(close / lag(close) OVER (ORDER BY date)), 8) AS market_change FROM k")
def f8_market_change_outer(spark, d):
    gaps = T.market_bars(spark, d).withColumn("close", F.when(F.col("volume") > 100, F.col("close")))
    return rounded(X.market_change(gaps, "market").select("date", "market_change"))


@register(f"WITH {T.MARKET} SELECT date, open AS market_open, high AS market_high, low AS market_low, close AS market_close FROM market")
def f9_prefixed_market(spark, d):
    return X.market_change(T.market_bars(spark, d), "market").select("date", "market_open", "market_high", "market_low", "market_close")


@register(f"WITH {T.ANALYSIS} SELECT instrument, date, round(last_value(intraday_sentiment_index IGNORE NULLS) OVER w, 8) AS intraday_sentiment_index_ffill, round(last_value(overnight_sentiment_index IGNORE NULLS) OVER w, 8) AS overnight_sentiment_index_ffill FROM analysis WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def f10_forward_fill(spark, d):
    return rounded(T.analysis(spark, d).select("instrument", "date", "intraday_sentiment_index_ffill", "overnight_sentiment_index_ffill"))


@register(f"WITH {T.SENTIMENT} SELECT instrument, date, round(CASE WHEN intraday_no_posts = 0 THEN intraday_sentiment_index END, 8) AS intraday_sentiment_index, round(intraday_sentiment_index, 8) AS intraday_sentiment_index_raw FROM sentiment")
def f11_mask_no_posts(spark, d):
    return rounded(X.mask_no_posts(T.sentiment(spark, d)).select("instrument", "date", "intraday_sentiment_index", "intraday_sentiment_index_raw"))


@register(f"WITH {T.BARS}, b AS (SELECT *, CASE WHEN volume > 60 THEN close END AS vix FROM bars) SELECT instrument, date, vix AS vix_reported_same_date, last_value(vix IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vix FROM b")
def f12_previous_known(spark, d):
    rows = T.bars(spark, d).withColumn("vix", F.when(F.col("volume") > 60, F.col("close")))
    return X.previous_known(rows, ["vix"]).select("instrument", "date", "vix", "vix_reported_same_date")


_TABLE = f"""{T.ANALYSIS.replace("analysis AS (", "analysis_rows AS (")}, b AS (
  SELECT f.instrument, f.date, f.cc_return, f.rolling_volatility, f.parkinson_volatility, c.market_change, c.second_change, c.vix_change, s.intraday_sentiment_index,
         CASE WHEN s.overnight_no_posts = 0 THEN s.overnight_sentiment_index END AS overnight_sentiment_index
  FROM featured f LEFT JOIN change c ON c.date = f.date LEFT JOIN sentiment s ON s.instrument = f.instrument AND s.date = f.date),
l AS (SELECT *, lag(rolling_volatility, 1) OVER w AS rolling_volatility_lag1, lag(rolling_volatility, 2) OVER w AS rolling_volatility_lag2, lag(rolling_volatility, 3) OVER w AS rolling_volatility_lag3,
  lag(cc_return) OVER w AS cc_return_lag1, lag(vix_change) OVER w AS vix_change_lag1, lead(overnight_sentiment_index) OVER w AS sentiment_overnight, intraday_sentiment_index AS sentiment_intraday,
  lead(rolling_volatility) OVER w AS target_vol_5d, lead(parkinson_volatility) OVER w AS target_vol_pk FROM b WINDOW w AS (PARTITION BY instrument ORDER BY date)),
table_rows AS (SELECT * FROM l WHERE rolling_volatility_lag3 IS NOT NULL AND vix_change_lag1 IS NOT NULL AND market_change IS NOT NULL AND second_change IS NOT NULL AND sentiment_overnight IS NOT NULL AND target_vol_5d IS NOT NULL AND target_vol_pk IS NOT NULL)"""
FEATURE_TABLE = _TABLE


def feature_table(spark, d, sentiment=None):
    """Days without overnight posts have no overnight index here, so complete cases leave out the days before them."""
    sentiment = (T.sentiment(spark, d) if sentiment is None else sentiment).withColumn("overnight_sentiment_index", F.when(F.col("overnight_no_posts") == 0, F.col("overnight_sentiment_index")))
    return X.feature_table(T.bars(spark, d), T.market_change(spark, d), sentiment)


@register(f"WITH {_TABLE} SELECT instrument, date, {_rounds(*X.SENTIMENT_FEATURES, *X.TARGETS)} FROM table_rows")
def f13_f15_feature_table(spark, d):
    return rounded(feature_table(spark, d).select("instrument", "date", *X.SENTIMENT_FEATURES, *X.TARGETS))


@register(f"WITH {T.SENTIMENT} SELECT instrument, date, round(overnight_sentiment_index - lag(overnight_sentiment_index) OVER (PARTITION BY instrument ORDER BY date), 8) AS overnight_sentiment_index_diff FROM sentiment")
def f16_first_difference(spark, d):
    return rounded(X.first_difference(T.sentiment(spark, d), "overnight_sentiment_index").select("instrument", "date", "overnight_sentiment_index_diff"))


@register(f"WITH {T.BARS} SELECT instrument, count(*) FILTER (WHERE volume <= 60) AS missing_price_rows, count(*) FILTER (WHERE volume > 60) AS analysis_rows FROM bars GROUP BY instrument")
def f17_missing_prices(spark, d):
    rows = T.bars(spark, d).withColumn("close", F.when(F.col("volume") > 60, F.col("close")))
    kept, lost = checks.drop_missing_prices(rows)
    return lost.join(kept.groupBy("instrument").agg(F.count(F.lit(1)).alias("analysis_rows")), "instrument")


@register("SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 10 = 0")
def f18_numeric(spark, d):
    p = F.col("o_totalprice")
    text = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.floor(p / 1000).cast("string"), F.lit(","), F.format_string("%s", F.substring(F.format_string("%06.2f", p % 1000), 1, 6)), F.lit(" ")))
    return T.read(spark, d, "orders").select("o_orderkey", X.numeric(text).alias("price"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def f19_dates(spark, d):
    t, n = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(n == 0, F.date_format(t, "yyyy-MM-dd")).when(n == 1, F.date_format(t, "yyyy.MM.dd")).when(n == 2, F.date_format(t, " yyyy/MM/dd")).otherwise(F.date_format(t, "dd MMM"))
    return T.read(spark, d, "orders").select("o_orderkey", X.date_value(text).alias("date"))


@register(f"WITH {T.BARS} SELECT instrument, date, CAST(row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS INTEGER) AS position FROM bars")
def f21_position(spark, d):
    return X.position(T.bars(spark, d)).select("instrument", "date", "position")


@register(f"WITH {T.BARS}, b AS (SELECT instrument, date_trunc('month', date) AS month FROM bars) SELECT instrument, CAST(month AS DATE) AS month, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1")
def k1_duplicate_keys(spark, d):
    rows = T.bars(spark, d).select("instrument", F.trunc("date", "month").alias("month"))
    return checks.duplicate_keys(rows, ["instrument", "month"])


@register(f"WITH {T.BARS}, {T.SENTIMENT}, m AS (SELECT s.instrument, s.date, CASE WHEN b.volume > 60 THEN close END AS close, intraday_no_posts, overnight_no_posts, min(s.date) FILTER (WHERE intraday_no_posts = 0) OVER w AS first_intraday, min(s.date) FILTER (WHERE overnight_no_posts = 0) OVER w AS first_overnight FROM sentiment s LEFT JOIN bars b ON b.instrument = s.instrument AND b.date = s.date WINDOW w AS (PARTITION BY s.instrument)) SELECT instrument, count(*) FILTER (WHERE close IS NOT NULL AND (first_intraday IS NULL OR date < first_intraday)) AS intraday_missing_after_fill, count(*) FILTER (WHERE close IS NOT NULL AND (first_overnight IS NULL OR date < first_overnight)) AS overnight_missing_after_fill, count(*) AS input_rows, count(close) AS analysis_rows, count(*) - count(close) AS excluded_rows, min(date) FILTER (WHERE close IS NOT NULL) AS first_date, max(date) FILTER (WHERE close IS NOT NULL) AS last_date, count(date) - count(DISTINCT date) AS duplicate_dates, count(*) FILTER (WHERE intraday_no_posts = 1) AS intraday_no_post_days, count(*) FILTER (WHERE overnight_no_posts = 1) AS overnight_no_post_days FROM m GROUP BY instrument")
def k3_qa_summary(spark, d):
    bars = T.bars(spark, d).withColumn("close", F.when(F.col("volume") > 60, F.col("close")))
    rows = X.forward_fill(X.mask_no_posts(T.sentiment(spark, d)), ["intraday_sentiment_index", "overnight_sentiment_index"])
    return checks.qa_summary(rows.join(bars, ["instrument", "date"], "left"))


@register(f"WITH {T.SENTIMENT}, l AS (SELECT instrument, 'intraday_sentiment_index' AS variable, intraday_sentiment_index AS v FROM sentiment UNION ALL SELECT instrument, 'overnight_sentiment_index', overnight_sentiment_index FROM sentiment) SELECT instrument, variable, count(v) AS n, round(avg(v), 7) AS mean, round(stddev_samp(v), 7) AS std, round(min(v), 7) AS min, round(max(v), 7) AS max, round(avg(CASE WHEN abs(v) < 0.0333 THEN 1.0 ELSE 0.0 END), 7) AS near_zero_share FROM l GROUP BY ALL")
def k4_distribution(spark, d):
    return rounded(checks.distribution(T.sentiment(spark, d), ["intraday_sentiment_index", "overnight_sentiment_index"], near=0.0333), 7)


@register("WITH b AS (SELECT event_type AS instrument, least(CAST(floor((value - 1.0) / ((100.0 - 1.0) / 15)) AS INTEGER), 14) AS bin, count(*) AS n FROM events WHERE value BETWEEN 1 AND 100 GROUP BY ALL), s AS (SELECT instrument, bin FROM (SELECT DISTINCT event_type AS instrument FROM events), (SELECT CAST(unnest(range(15)) AS INTEGER) AS bin)) SELECT s.instrument, s.bin, coalesce(n, 0) AS n FROM s LEFT JOIN b ON b.instrument = s.instrument AND b.bin = s.bin")
def k5_histogram(spark, d):
    rows = T.read(spark, d, "events").select(F.col("event_type").alias("instrument"), "value")
    return checks.histogram(rows, "value", 1.0, 100.0)


@register(f"WITH {T.BARS}, {T.MARKET} SELECT instrument, date, close, volume FROM bars UNION ALL SELECT NULL, date, close, NULL FROM market")
def k6_pooled(spark, d):
    return checks.pooled(T.bars(spark, d).select("instrument", "date", "close", "volume"), T.market_bars(spark, d).select("date", "close"))


@register(f"WITH {T.BARS} SELECT instrument, date, close >= open AS up, least(open, close) AS body_low, round(abs(close - open), 8) AS body_height, high, low FROM bars")
def k9_candles(spark, d):
    return rounded(checks.candles(T.bars(spark, d)))


@register(f"WITH {T.BARS}, {T.SENTIMENT} SELECT s.instrument, s.date, round(CASE WHEN intraday_no_posts = 0 AND overnight_no_posts = 0 THEN (intraday_sentiment_index + overnight_sentiment_index) / 2 WHEN intraday_no_posts = 0 THEN intraday_sentiment_index WHEN overnight_no_posts = 0 THEN overnight_sentiment_index END, 8) AS daily_sentiment, close FROM sentiment s JOIN bars b ON b.instrument = s.instrument AND b.date = s.date")
def k10_sentiment_and_close(spark, d):
    from tidemark.operators.calendar import combined_sentiment

    rows = combined_sentiment(T.sentiment(spark, d)).join(T.bars(spark, d), ["instrument", "date"])
    return rounded(rows.select("instrument", "date", "daily_sentiment", "close"))
