"""The tables that queries derive from the given ones, and the same as SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a time and a score in [-1, 1): instrument is the event type."""
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id"), ((v - 100) / (v + 100)).alias("score"))


POSTS = "posts AS (SELECT event_type AS instrument, event_id AS item_id, ts, user_id, (value - 100) / (value + 100) AS score FROM events)"


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays with events but the last, so that the provisional day is needed; the dates of every instrument."""
    days = read(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), F.to_date("ts").alias("date")).distinct().filter(~F.dayofweek("date").isin(1, 7))
    last = days.agg(F.max("date").alias("last"))
    return days.join(F.broadcast(last), F.col("date") < F.col("last")).select("instrument", "date")  # one row


CALENDAR = (
    "days AS (SELECT DISTINCT event_type AS instrument, CAST(ts AS DATE) AS date FROM events WHERE dayofweek(ts) NOT IN (0, 6)), "
    "calendar AS (SELECT * FROM days WHERE date < (SELECT max(date) FROM days))"
)

#: Calendar with the provisional day (C2) and posts with their sessions.
SESSIONS = f"""{POSTS}, {CALENDAR},
last_day AS (SELECT instrument, max(date) AS last FROM calendar GROUP BY instrument),
last_post AS (SELECT instrument, max(ts) AS last_post FROM posts GROUP BY instrument),
full_calendar AS (
  SELECT instrument, date, 1 AS price_available FROM calendar UNION ALL
  SELECT l.instrument, CAST(last + CAST(CASE dayofweek(last) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS DATE), 0 FROM last_day l JOIN last_post p ON p.instrument = l.instrument
  WHERE last_post >= CAST(last AS TIMESTAMP) + INTERVAL 930 MINUTES),
following AS (SELECT d.instrument, d.day, min(c.date) AS next_date FROM (SELECT DISTINCT instrument, CAST(ts AS DATE) AS day FROM posts) d
  LEFT JOIN full_calendar c ON c.instrument = d.instrument AND c.date > d.day GROUP BY d.instrument, d.day),
timed AS (SELECT p.*, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m FROM posts p),
assigned AS (
  SELECT t.instrument, t.item_id, t.ts, t.score, CASE WHEN c.date IS NOT NULL AND m < 930 THEN t.day ELSE f.next_date END AS session_date,
         CASE WHEN c.date IS NOT NULL AND m >= 540 AND m < 930 THEN 'intraday' WHEN (c.date IS NOT NULL AND m < 930) OR f.next_date IS NOT NULL THEN 'overnight' END AS session
  FROM timed t LEFT JOIN full_calendar c ON c.instrument = t.instrument AND c.date = t.day JOIN following f ON f.instrument = t.instrument AND f.day = t.day)"""

INDEX = f"""{SESSIONS},
means AS (SELECT instrument, session_date AS date, session, avg(score) AS s, count(*) AS n FROM assigned WHERE session_date IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
index AS (
  SELECT c.instrument, c.date, coalesce(a.s, 0) AS intraday_sentiment_index, coalesce(a.n, 0) AS intraday_item_count, CASE WHEN a.n IS NULL THEN 1 ELSE 0 END AS intraday_no_posts,
         coalesce(b.s, 0) AS overnight_sentiment_index, coalesce(b.n, 0) AS overnight_item_count, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END AS overnight_no_posts, price_available
  FROM full_calendar c LEFT JOIN means a ON a.instrument = c.instrument AND a.date = c.date AND a.session = 'intraday'
  LEFT JOIN means b ON b.instrument = c.instrument AND b.date = c.date AND b.session = 'overnight')"""

#: Order key, line number, part and supplier key as the digits of one number: a key of fixed width, which a hash aggregate can hold (a struct can't).
_ORDER = "((CAST(l_orderkey AS DECIMAL(13, 0)) * 10 + CAST(l_linenumber AS DECIMAL(1, 0))) * 1000000000000BD + CAST(l_partkey AS DECIMAL(12, 0))) * 1000000000000BD + CAST(l_suppkey AS DECIMAL(12, 0))"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by return flag; one grouped aggregate, combined before the shuffle."""
    return _bars(read(spark, sf_dir, "lineitem").withColumn("instrument", F.col("l_returnflag")), ["instrument"])


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars over all flags; with them the close of a second market (even line numbers; no row on some days) and the level of a volatility
    index (the mean quantity)."""
    even = F.col("l_linenumber") % 2 == 0
    more = [F.max_by(F.when(even, F.col("l_extendedprice")), F.when(even, F.expr(_ORDER))).alias("second_close"), F.avg("l_quantity").alias("vix_close")]
    return _bars(read(spark, sf_dir, "lineitem"), [], more)


def _bars(rows: DataFrame, by: list[str], more: list | None = None) -> DataFrame:
    return rows.groupBy(*by, F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("l_extendedprice", F.expr(_ORDER)).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.max_by("l_extendedprice", F.expr(_ORDER)).alias("close"), F.sum("l_quantity").alias("volume"), *(more or []))


def _bars_sql(name: str, by: str) -> str:
    k = "ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    by = f"{by}, " if by else ""
    return (
        f"{name} AS (SELECT {by}CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice, {k}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, "
        f"arg_max(l_extendedprice, {k}) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"
    )


BARS = _bars_sql("bars", "l_returnflag AS instrument")
_MORE = ", arg_max(l_extendedprice, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_linenumber % 2 = 0) AS second_close, avg(l_quantity) AS vix_close FROM lineitem"
MARKET = _bars_sql("market", "").replace(" FROM lineitem", _MORE)
MARKET_CHANGE = f"{MARKET}, change AS (SELECT date, close, ln(close / lag(close) OVER w) AS market_change, ln(second_close / lag(second_close) OVER w) AS second_change, ln(vix_close / lag(vix_close) OVER w) AS vix_change FROM market WINDOW w AS (ORDER BY date))"


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sessions of each flag from discounts: line status F is intraday, O overnight."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("s"), (F.col("l_discount") - 0.05).alias("v"))
    parts = []
    for name, status in (("intraday", "F"), ("overnight", "O")):
        own = F.when(F.col("s") == status, F.col("v"))
        parts += [F.coalesce(F.avg(own), F.lit(0.0)).alias(f"{name}_sentiment_index"), F.count(own).alias(f"{name}_item_count"), (F.count(own) == 0).cast("int").alias(f"{name}_no_posts")]
    return rows.groupBy("instrument", "date").agg(*parts)


def _sentiment_sql() -> str:
    parts = ", ".join(
        f"coalesce(avg(l_discount - 0.05) FILTER (WHERE l_linestatus = '{s}'), 0) AS {n}_sentiment_index, count(*) FILTER (WHERE l_linestatus = '{s}') AS {n}_item_count, "
        f"CASE WHEN count(*) FILTER (WHERE l_linestatus = '{s}') = 0 THEN 1 ELSE 0 END AS {n}_no_posts"
        for n, s in (("intraday", "F"), ("overnight", "O"))
    )
    return f"sentiment AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS date, {parts} FROM lineitem GROUP BY ALL)"


SENTIMENT = _sentiment_sql()


def both_sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sessions of each flag from discounts where both occur on most days: odd line numbers are intraday, even ones overnight."""
    rows = read(spark, sf_dir, "lineitem")
    parts = []
    for name, rest in (("intraday", 1), ("overnight", 0)):
        own = F.when(F.col("l_linenumber") % 2 == rest, F.col("l_discount") - 0.05)
        parts += [F.avg(own).alias(f"{name}_sentiment_index"), F.count(own).alias(f"{name}_item_count"), (F.count(own) == 0).cast("int").alias(f"{name}_no_posts")]
    return rows.groupBy(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("date")).agg(*parts)


BOTH_SENTIMENTS = "sentiment AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS date, " + ", ".join(
    f"avg(l_discount - 0.05) FILTER (WHERE l_linenumber % 2 = {r}) AS {n}_sentiment_index, count(*) FILTER (WHERE l_linenumber % 2 = {r}) AS {n}_item_count, "
    f"CASE WHEN count(*) FILTER (WHERE l_linenumber % 2 = {r}) = 0 THEN 1 ELSE 0 END AS {n}_no_posts" for n, r in (("intraday", 1), ("overnight", 0))
) + " FROM lineitem GROUP BY ALL)"


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign index of another calendar: daily mean order price."""
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("vix_close"))


FOREIGN = "abroad AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS vix_close FROM orders GROUP BY ALL)"


def market_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, market_close, market_change, second_change and vix_change; a day without a second close has no change, nor has the next (F8)."""
    from pyspark.sql import Window

    from tidemark.operators.features import log_ratio

    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    rows = market_bars(spark, sf_dir)
    change = lambda c: log_ratio(F.col(c), F.lag(c).over(w))
    return rows.select("date", F.col("close").alias("market_close"), change("close").alias("market_change"), change("second_close").alias("second_change"), change("vix_close").alias("vix_change"))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with features, masked and filled sentiment, and the market's change."""
    from tidemark.operators import features as X

    rows = X.price_features(bars(spark, sf_dir)).join(sentiment(spark, sf_dir), ["instrument", "date"], "left").join(market_change(spark, sf_dir), "date", "left")
    return X.forward_fill(X.mask_no_posts(rows), ["intraday_sentiment_index", "overnight_sentiment_index"])


RETURNS = f"""{BARS}, returns AS (
  SELECT *, ln(close / lag(close) OVER w) AS cc_return, ln(open / lag(close) OVER w) AS overnight_return, ln(close / open) AS intraday_return,
         abs(ln(high / low)) / sqrt(4 * ln(2)) AS parkinson_volatility FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date)),
featured AS (SELECT *, abs(cc_return) AS abs_return, cc_return * cc_return AS squared_return,
  CASE WHEN count(cc_return) OVER w = 5 THEN stddev_samp(cc_return) OVER w END AS rolling_volatility
  FROM returns WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""

ANALYSIS = f"""{RETURNS}, {SENTIMENT}, {MARKET_CHANGE},
analysis AS (
  SELECT f.*, CASE WHEN intraday_no_posts = 0 THEN intraday_sentiment_index END AS intraday_sentiment_index,
         CASE WHEN overnight_no_posts = 0 THEN overnight_sentiment_index END AS overnight_sentiment_index,
         intraday_item_count, overnight_item_count, intraday_no_posts, overnight_no_posts, market_change, second_change, vix_change
  FROM featured f LEFT JOIN sentiment s ON s.instrument = f.instrument AND s.date = f.date LEFT JOIN change c ON c.date = f.date)"""
