"""Trading calendars and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_MINUTE, CLOSE_MINUTE = 9 * 60, 15 * 60 + 30
INTRADAY, OVERNIGHT = "intraday", "overnight"


def trading_calendar(prices: DataFrame, by: str = "instrument", date: str = "date") -> DataFrame:
    """Distinct dates of each instrument."""
    return prices.select(F.col(by), F.col(date)).filter(F.col(date).isNotNull()).distinct()


def next_weekday(date: Column) -> Column:
    return F.date_add(date, F.when(F.dayofweek(date) == 6, 3).when(F.dayofweek(date) == 7, 2).otherwise(1))


def with_provisional(calendar: DataFrame, posts: DataFrame, by: str = "instrument", ts: str = "ts") -> DataFrame:
    """The calendar with price_available = 1, and the weekday after its last date (0) where posts reach that date's close."""
    last_post = posts.groupBy(by).agg(F.max(ts).alias("_last_post"))
    last = calendar.groupBy(by).agg(F.max("date").alias("_last"))
    reached = last.join(last_post, by).filter(F.col("_last_post") >= F.col("_last").cast("timestamp_ntz") + F.expr(f"INTERVAL {CLOSE_MINUTE} MINUTES"))
    return calendar.withColumn("price_available", F.lit(1)).unionByName(reached.select(by, next_weekday(F.col("_last")).alias("date"), F.lit(0).alias("price_available")))


def _day_map(posts: DataFrame, calendar: DataFrame, by: str) -> DataFrame:
    """For every day with posts whether it is a trading date, and the next trading date after it.

    Windows run over distinct days, as many as instruments times days, not over posts.
    """
    days = posts.select(F.col(by), F.col("_day").alias("date"), F.lit(0).alias("_t")).distinct()
    w = Window.partitionBy(by).orderBy(F.col("date").desc())  # against time, so that the frame grows by a row at each row
    both = days.unionByName(calendar.select(by, "date", F.lit(1).alias("_t"))).groupBy(by, "date").agg(F.max("_t").alias("trades"))
    later = F.last(F.when(F.col("trades") == 1, F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("next_date", later).select(F.col(by).alias("_by"), F.col("date").alias("_date"), "trades", "next_date")


def assign_session(posts: DataFrame, calendar: DataFrame, by: str = "instrument", ts: str = "ts", max_gap_days: int | None = None) -> DataFrame:
    """session_date and session of each post.

    On a trading date, 09:00 to 15:29 is that date's intraday session, earlier its overnight session; every other post
    belongs to the overnight session of the next trading date (null after the last). Whole minutes decide. Posts are joined to
    a table of days by equality, so a hot instrument is only a skewed join.
    """
    rows = posts.withColumn("_day", F.to_date(ts))
    days = _day_map(rows, calendar, by)
    minute = F.hour(ts) * 60 + F.minute(ts)
    joined = rows.join(days, (F.col(by) == F.col("_by")) & (F.col("_day") == F.col("_date")), "left")
    today = (F.col("trades") == 1) & (minute < CLOSE_MINUTE)
    date = F.when(today, F.col("_day")).otherwise(F.col("next_date"))
    if max_gap_days is not None:
        date = F.when(F.datediff(date, F.col("_day")) <= max_gap_days, date)
    session = F.when(today & (minute >= OPEN_MINUTE), INTRADAY).otherwise(OVERNIGHT)
    return joined.withColumns({"session_date": date, "session": F.when(date.isNotNull(), session)}).drop("_day", "_by", "_date", "trades", "next_date")


def unassigned(assigned: DataFrame, by: str = "instrument") -> DataFrame:
    """C4: posts after the last date."""
    return assigned.groupBy(by).agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("session_date").isNull()).alias("unassigned"))


def session_means(assigned: DataFrame, by: str = "instrument", score: str = "score") -> DataFrame:
    """Mean and number of scored posts by date and session."""
    kept = assigned.filter(F.col("session_date").isNotNull() & F.col(score).isNotNull())
    return kept.groupBy(by, F.col("session_date").alias("date"), "session").agg(F.avg(score).alias("sentiment_index"), F.count(F.lit(1)).alias("item_count"))


def session_index(means: DataFrame, calendar: DataFrame, by: str = "instrument") -> DataFrame:
    """One row per trading date with both sessions; without posts index 0, count 0 and no_posts 1; price_available from the calendar."""
    wide = means.groupBy(by, "date").agg(
        *[F.max(F.when(F.col("session") == s, F.col(c))).alias(f"{s}_{c}") for s in (INTRADAY, OVERNIGHT) for c in ("sentiment_index", "item_count")]
    )
    out = calendar.join(wide, [by, "date"], "left")
    for s in (INTRADAY, OVERNIGHT):
        n = F.coalesce(f"{s}_item_count", F.lit(0))
        out = out.withColumns({f"{s}_sentiment_index": F.coalesce(f"{s}_sentiment_index", F.lit(0.0)), f"{s}_item_count": n.cast("long"), f"{s}_no_posts": (n == 0).cast("int")})
    names = [f"{s}_{c}" for s in (INTRADAY, OVERNIGHT) for c in ("sentiment_index", "item_count", "no_posts")]
    return out.select(by, "date", *names, "price_available")


def combined_sentiment(index: DataFrame) -> DataFrame:
    """Mean of the sessions that had posts, null without any."""
    masked = [F.when(F.col(f"{s}_no_posts") == 0, F.col(f"{s}_sentiment_index")) for s in (INTRADAY, OVERNIGHT)]
    known = sum((m.isNotNull().cast("int") for m in masked), F.lit(0))
    return index.withColumn("daily_sentiment", F.try_divide(sum((F.coalesce(m, F.lit(0.0)) for m in masked), F.lit(0.0)), known))


def holiday_gaps(index: DataFrame, by: str = "instrument") -> DataFrame:
    """Previous trading date, days since, and whether more than one."""
    before = F.lag("date").over(Window.partitionBy(by).orderBy("date"))
    gap = F.datediff("date", before)
    return index.withColumns({"previous_date": before, "gap_days": gap, "after_gap": F.coalesce(gap > 1, F.lit(False))})


def gap_summary(gaps: DataFrame, by: str = "instrument", value: str = "overnight_sentiment_index", count: str = "overnight_item_count", mask: str = "overnight_no_posts") -> DataFrame:
    """C11: overnight sentiment after gaps and after ordinary nights, days without posts left out."""
    return gaps.filter(F.col(mask) == 0).groupBy(by, "after_gap").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_sentiment"), F.stddev_samp(value).alias("std_sentiment"), F.avg(count).alias("mean_items"))


def window_size(least: int, most: int, seed: int = 0, date: str = "session_date", session: str = "session") -> Column:
    """How many posts a date's session is to have, from least to most, drawn by a hash of both and the seed."""
    drawn = F.md5(F.concat_ws(":", F.col(date).cast("string"), F.col(session), F.lit(str(seed))))
    return F.lit(least) + F.conv(F.substring(drawn, 1, 7), 16, 10).cast("long") % (most - least + 1)


def sample_posts(assigned: DataFrame, n: int | Column, seed: int = 0, by: str = "instrument", key: str = "item_id") -> DataFrame:
    """N posts (such as ``window_size(3, 8)``) of each instrument, date and session, chosen by a hash of key and seed (the same at every run)."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    w = Window.partitionBy(by, "session_date", "session").orderBy(*order)
    return assigned.filter(F.col("session_date").isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= (n if isinstance(n, Column) else F.lit(n))).drop("_r")


#: Start and length of the two windows of a day in minutes; the overnight one goes on to the next morning.
WINDOWS = {"intraday": (540, 390), "overnight": (930, 1050)}


def target_times(days: DataFrame, least: int = 3, most: int = 8, seed: int = 0, by: str = "instrument", on: str = "date") -> DataFrame:
    """By, on, session, k and target: from ``least`` to ``most`` times within each day's two windows, to the second.

    How many and which follow from a hash of key, day, session and seed, so they are the same at every run and in every task."""
    session = F.explode(F.array(*[F.struct(F.lit(n).alias("session"), F.lit(start * 60).alias("_start"), F.lit(length * 60).alias("_length")) for n, (start, length) in WINDOWS.items()]))
    rows = days.select(by, on, session.alias("_w")).select(by, on, "_w.*")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), window_size(least, most, seed, on, "session").cast("int"))))
    drawn = F.md5(F.concat_ws(":", F.col(by), F.col(on).cast("string"), F.col("session"), F.col("k").cast("string"), F.lit(str(seed))))
    seconds = F.col("_start") + F.conv(F.substring(drawn, 1, 7), 16, 10).cast("long") % F.col("_length")
    target = F.col(on).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return rows.select(by, on, "session", "k", target.alias("target"))


def id_rate(posts: DataFrame, by: str = "instrument", key: str = "item_id", ts: str = "ts") -> DataFrame:
    """C14: ids a day, between the first and the last post; null within one day."""
    days = F.datediff(F.max(F.to_date(ts)), F.min(F.to_date(ts)))
    return posts.groupBy(by).agg(F.try_divide((F.max(key) - F.min(key)).cast("double"), days).alias("ids_per_day"))
