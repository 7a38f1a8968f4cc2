"""Event study (E1-E11): events, market models, abnormal returns and their windows, for all instruments at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import asof, features, testing

#: Windows of days after the event by session.
WINDOWS = {"overnight": ((0, 0), (0, 1), (0, 3), (0, 5)), "intraday": ((1, 1), (1, 3), (1, 5))}


def candidates(rows: DataFrame, sessions: dict[str, str], by: str = "instrument", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows in the tails of each session's sentiment. sessions: name and column. Quantiles interpolate linearly, over the whole series."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("session"), F.col(c).cast("double").alias("sentiment")) for s, c in sessions.items()]))
    long = features.position(rows, by).select(by, "date", "position", each.alias("x")).select(by, "date", "position", "x.*").filter(F.col("sentiment").isNotNull())
    ends = long.groupBy(by, "session").agg(F.percentile("sentiment", F.lit(low)).alias("low"), F.percentile("sentiment", F.lit(high)).alias("high"))
    s = F.col("sentiment")
    direction = F.when(s <= F.col("low"), "negative").when(s >= F.col("high"), "positive")
    out = long.join(ends, [by, "session"]).withColumn("direction", direction).filter(F.col("direction").isNotNull())
    return out.withColumns({"extremeness": F.when(F.col("direction") == "negative", -s).otherwise(s), "threshold": F.when(F.col("direction") == "negative", F.col("low")).otherwise(F.col("high"))}).drop("low", "high")


def select_events(tagged: DataFrame, by: str = "instrument", spacing: int = 5) -> DataFrame:
    """Per instrument, session and direction the most extreme first (then the earliest); one is left out if an accepted one is at most ``spacing`` rows away.

    A group is at most a tenth of one instrument's days, folded as one array."""
    keys = [by, "session", "direction"]
    item = F.struct((-F.col("extremeness")).alias("e"), F.col("position").alias("p"))
    ordered = tagged.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    near = lambda acc, x: F.exists(acc, lambda q: F.abs(q - x["p"]) <= spacing)
    chosen = F.aggregate("all", F.expr("cast(array() as array<int>)"), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.array_append(acc, x["p"])))
    kept = ordered.select(*keys, F.explode(chosen).alias("position"))
    return tagged.join(kept, [*keys, "position"])


def market_models(rows: DataFrame, by: str = "instrument", y: str = "cc_return", x: str = "market_change", first: int = 65, last: int = 6, least: int = 30) -> DataFrame:
    """Market model of every row over rows position-65 to position-6, null where fewer than 30 of them are complete (E5: the market of the row is in x)."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(-first, -last)
    n = F.regr_count(y, x).over(w)
    value = lambda f: F.when(n >= least, f.over(w))
    return features.position(rows, by).withColumns({"alpha": value(F.regr_intercept(y, x)), "beta": value(F.regr_slope(y, x)), "r_squared": value(F.regr_r2(y, x)), "estimation_n": n})


def own_market(rows: DataFrame, markets: dict[str, str], default: str, by: str = "instrument", name: str = "own_market") -> DataFrame:
    """E5: the change of each instrument's market, by a table of instruments and the market columns that aren't the default."""
    choice = F.col(default)
    for instrument, column in markets.items():
        choice = F.when(F.col(by) == instrument, F.col(column)).otherwise(choice)
    return rows.withColumn(name, choice)


def events(rows: DataFrame, sessions: dict[str, str], by: str = "instrument", spacing: int = 5, x: str = "market_change") -> DataFrame:
    """Selected events that have a market model, with event_id: instrument_session_direction_number; the number runs over the whole
    result by instrument, session and position. It is counted within each instrument and session, after the events of those before it."""
    chosen = select_events(candidates(rows, sessions, by), by, spacing)
    models = market_models(rows, by, x=x).select(by, "position", "alpha", "beta", "r_squared", "estimation_n").filter("alpha IS NOT NULL")
    out = chosen.join(models, [by, "position"])
    before = Window.partitionBy(F.lit(0)).orderBy(by, "session").rowsBetween(Window.unboundedPreceding, -1)  # a row for each instrument and session
    starts = out.groupBy(by, "session").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(by, "session").orderBy("position")) + F.col("_start")
    return out.join(starts, [by, "session"]).withColumn("event_id", F.concat_ws("_", by, "session", "direction", number.cast("string"))).drop("_start")


def abnormal_returns(chosen: DataFrame, rows: DataFrame, by: str = "instrument", y: str = "cc_return", x: str = "market_change", span: int = 5) -> DataFrame:
    """Return less what the market model expects, from 5 rows before to 5 after; rows without returns are left out."""
    days = features.position(rows, by).select(by, "position", F.col("date").alias("day"), F.col(y).alias("stock_return"), F.col(x).alias("market_return"))
    keep = chosen.select("event_id", by, "session", "direction", F.col("date").alias("event_date"), "position", "alpha", "beta")
    out = asof.offset_join(keep, days, [by], before=span, after=span).filter("stock_return IS NOT NULL AND market_return IS NOT NULL")
    expected = F.col("alpha") + F.col("beta") * F.col("market_return")
    return out.withColumns({"expected_return": expected, "abnormal_return": F.col("stock_return") - expected}).drop("alpha", "beta", "position")


def car(returns: DataFrame, by: str = "instrument") -> DataFrame:
    """Sums over the session's windows, only of events that have every day of the window."""
    spec = [F.struct(F.lit(s).alias("session"), F.lit(a).alias("first"), F.lit(b).alias("last")) for s, ws in WINDOWS.items() for a, b in ws]
    each = returns.withColumn("w", F.explode(F.array(*spec))).filter((F.col("session") == F.col("w.session")) & F.col("tau").between(F.col("w.first"), F.col("w.last")))
    sums = each.groupBy("event_id", by, "session", "direction", F.col("w.first").alias("first"), F.col("w.last").alias("last")).agg(F.sum("abnormal_return").alias("car"), F.count(F.lit(1)).alias("days"))
    return sums.filter(F.col("days") == F.col("last") - F.col("first") + 1).drop("days")


def car_summary(cars: DataFrame, by: str = "instrument") -> DataFrame:
    """Per instrument, session, direction and window: n, mean, median, deviation, t-test, signed-rank test, and p adjusted over all rows."""
    keys = [by, "session", "direction", "first", "last"]
    x = F.col("car")
    base = cars.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), testing.t_statistic(x).alias("t"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std"))
    base = base.withColumn("p_value", dist.t_two_sided(F.col("t"), F.col("n") - 1))
    signed = testing.wilcoxon(cars, keys, "car").select(*keys, F.col("p_two_sided").alias("p_wilcoxon"))
    out = base.join(signed, keys).withColumn("status", F.when(F.col("n") >= 2, "OK").otherwise("SKIP_TOO_FEW"))
    return testing.adjust(out)


def average_path(returns: DataFrame, by: list[str]) -> DataFrame:
    """Mean abnormal return by day around the event, and its running sum."""
    means = returns.groupBy(*by, "tau").agg(F.avg("abnormal_return").alias("mean_ar"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("mean_car", F.sum("mean_ar").over(Window.partitionBy(*by).orderBy("tau")))


def significant(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Rows significant before adjustment, with the verdict after it."""
    return tests.filter(F.col(p) < alpha)
