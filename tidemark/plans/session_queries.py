"""Queries over posts, calendars and sessions (C, J, S16-S18, T12, T18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, calendar, checks, matching, posts
from tidemark.plans import tables as T
from tidemark.plans.base import registry, rounded
from tidemark.sources import keyed_store
from tidemark.sources.shared import shared_path

QUERIES, ORACLES, register = registry()


def _full_calendar(spark, d):
    return calendar.with_provisional(calendar.trading_calendar(T.calendar(spark, d)), T.posts(spark, d))


def _assigned(spark, d):
    return calendar.assign_session(T.posts(spark, d), _full_calendar(spark, d).select("instrument", "date"))


def _index(spark, d):
    return calendar.session_index(calendar.session_means(_assigned(spark, d)), _full_calendar(spark, d))


@register(f"WITH {T.CALENDAR} SELECT instrument, date FROM calendar")
def c1_trading_calendar(spark, d):
    return calendar.trading_calendar(T.calendar(spark, d))


@register(f"WITH {T.SESSIONS} SELECT instrument, date, price_available FROM full_calendar")
def c2_provisional_day(spark, d):
    return _full_calendar(spark, d)


@register(f"WITH {T.SESSIONS} SELECT instrument, item_id, session_date, session FROM assigned")
def c3_session_assignment(spark, d):
    return _assigned(spark, d).select("instrument", "item_id", "session_date", "session")


@register(f"WITH {T.POSTS}, {T.CALENDAR} SELECT p.instrument, count(*) AS posts, count(*) FILTER (WHERE CAST(ts AS DATE) > last OR (CAST(ts AS DATE) = last AND hour(ts) * 60 + minute(ts) >= 930)) AS unassigned FROM posts p JOIN (SELECT instrument, max(date) AS last FROM calendar GROUP BY instrument) l ON l.instrument = p.instrument GROUP BY p.instrument")
def c4_unassigned_posts(spark, d):
    return calendar.unassigned(calendar.assign_session(T.posts(spark, d), T.calendar(spark, d)))


@register(f"WITH {T.INDEX} SELECT instrument, date, session, round(s, 8) AS sentiment_index, n AS item_count FROM means")
def c5_session_means(spark, d):
    return rounded(calendar.session_means(_assigned(spark, d)))


_INDEX_COLUMNS = "instrument, date, round(intraday_sentiment_index, 8) AS intraday_sentiment_index, intraday_item_count, intraday_no_posts, round(overnight_sentiment_index, 8) AS overnight_sentiment_index, overnight_item_count, overnight_no_posts, price_available"


@register(f"WITH {T.INDEX} SELECT {_INDEX_COLUMNS} FROM index")
def c6_session_index(spark, d):
    return rounded(_index(spark, d))


@register(f"WITH {T.INDEX} SELECT instrument, date, price_available FROM index WHERE price_available = 0")
def c7_unpriced_days(spark, d):
    return _index(spark, d).filter("price_available = 0").select("instrument", "date", "price_available")


@register(f"WITH {T.BARS}, {T.SENTIMENT} SELECT s.instrument, s.date, intraday_item_count, overnight_item_count, close FROM sentiment s LEFT JOIN bars b ON b.instrument = s.instrument AND b.date = s.date")
def c8_merge_with_prices(spark, d):
    merged = asof.one_to_one(T.sentiment(spark, d), T.bars(spark, d), ["instrument", "date"])
    return merged.select("instrument", "date", "intraday_item_count", "overnight_item_count", "close")


_DAILY = "CASE WHEN intraday_no_posts = 0 AND overnight_no_posts = 0 THEN (intraday_sentiment_index + overnight_sentiment_index) / 2 WHEN intraday_no_posts = 0 THEN intraday_sentiment_index WHEN overnight_no_posts = 0 THEN overnight_sentiment_index END"


@register(f"WITH {T.INDEX} SELECT instrument, date, round({_DAILY}, 8) AS daily_sentiment FROM index")
def c9_daily_sentiment(spark, d):
    return rounded(calendar.combined_sentiment(_index(spark, d)).select("instrument", "date", "daily_sentiment"))


_GAPS = f"{T.INDEX}, gaps AS (SELECT *, lag(date) OVER (PARTITION BY instrument ORDER BY date) AS previous_date FROM index), gapped AS (SELECT *, CAST(date - previous_date AS INTEGER) AS gap_days, coalesce(date - previous_date > 1, false) AS after_gap FROM gaps)"


@register(f"WITH {_GAPS} SELECT instrument, date, previous_date, gap_days, after_gap FROM gapped")
def c10_holiday_gaps(spark, d):
    return calendar.holiday_gaps(_index(spark, d)).select("instrument", "date", "previous_date", "gap_days", "after_gap")


@register(f"WITH {_GAPS} SELECT instrument, after_gap, count(*) AS n, round(avg(overnight_sentiment_index), 8) AS mean_sentiment, round(stddev_samp(overnight_sentiment_index), 8) AS std_sentiment, round(avg(overnight_item_count), 8) AS mean_items FROM gapped WHERE overnight_no_posts = 0 GROUP BY ALL")
def c11_gap_summary(spark, d):
    return rounded(calendar.gap_summary(calendar.holiday_gaps(_index(spark, d))))


@register(f"WITH {T.SESSIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY instrument, session_date, session ORDER BY md5(item_id || ':0'), item_id) AS r FROM assigned WHERE session_date IS NOT NULL) SELECT instrument, item_id, session_date, session FROM ranked WHERE r <= 3 + CAST('0x' || substr(md5(CAST(session_date AS VARCHAR) || ':' || session || ':0'), 1, 7) AS BIGINT) % 6")
def c12_stratified_sample(spark, d):
    return calendar.sample_posts(_assigned(spark, d), calendar.window_size(3, 8)).select("instrument", "item_id", "session_date", "session")


_DRAWN = "CAST('0x' || substr(md5({0}), 1, 7) AS BIGINT)"
_TARGETS = f"""windows(session, s, n) AS (VALUES ('intraday', 32400, 23400), ('overnight', 55800, 63000)),
drawn AS (SELECT instrument, date, session, s, n, CAST(unnest(range(1, 4 + {_DRAWN.format("CAST(date AS VARCHAR) || ':' || session || ':0'")} % 6)) AS INTEGER) AS k FROM calendar, windows),
targets AS (SELECT instrument, date, session, k, CAST(date AS TIMESTAMP) + to_seconds(s + {_DRAWN.format("instrument || ':' || CAST(date AS VARCHAR) || ':' || session || ':' || k || ':0'")} % n) AS target FROM drawn),
stood AS (SELECT instrument, ts, max(item_id) AS item_id FROM posts GROUP BY ALL),
b AS (SELECT t.*, p.ts AS bt, p.item_id AS bi FROM targets t ASOF LEFT JOIN stood p ON p.instrument = t.instrument AND p.ts <= t.target),
f AS (SELECT b.*, p.ts AS ft, p.item_id AS fi FROM b ASOF LEFT JOIN stood p ON p.instrument = b.instrument AND p.ts >= b.target),
near AS (SELECT *, CASE WHEN epoch(target) - epoch(date_trunc('second', bt)) <= 3600 THEN epoch(target) - epoch(date_trunc('second', bt)) END AS bd, CASE WHEN epoch(date_trunc('second', ft)) - epoch(target) <= 3600 THEN epoch(date_trunc('second', ft)) - epoch(target) END AS fd FROM f)"""


@register(f"WITH {T.POSTS}, {T.CALENDAR}, {_TARGETS} SELECT instrument, date, session, k, target, CASE WHEN fd IS NULL OR bd <= fd THEN CASE WHEN bd IS NOT NULL THEN bi END ELSE fi END AS item_id FROM near")
def c12_target_times(spark, d):
    """Random times in both windows of every day, each with the nearest post within an hour."""
    targets = calendar.target_times(T.calendar(spark, d))
    at = T.posts(spark, d).groupBy("instrument", "ts").agg(F.max("item_id").alias("item_id"))
    out = asof.asof_join(targets, at.withColumnRenamed("ts", "target"), "target", ["instrument"], "nearest", tolerance=3600, bucket=F.date_trunc("hour", "_on"))
    return out.select("instrument", "date", "session", "k", "target", "item_id")


#: Every post that views, against the nearest purchase of the same user within an hour.
@register("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts),
b AS (SELECT v.event_id, v.user_id, v.ts, p.ts AS at, p.purchase_id FROM v ASOF LEFT JOIN p ON p.user_id = v.user_id AND p.ts <= v.ts),
f AS (SELECT v.event_id, p.ts AS at, p.purchase_id FROM v ASOF LEFT JOIN p ON p.user_id = v.user_id AND p.ts >= v.ts),
m AS (SELECT b.event_id, b.user_id, b.ts, CASE WHEN b.at IS NOT NULL AND epoch(date_trunc('second', b.ts)) - epoch(date_trunc('second', b.at)) <= 3600 THEN b.at END AS ba, b.purchase_id AS bp,
  CASE WHEN f.at IS NOT NULL AND epoch(date_trunc('second', f.at)) - epoch(date_trunc('second', b.ts)) <= 3600 THEN f.at END AS fa, f.purchase_id AS fp FROM b JOIN f ON f.event_id = b.event_id)
SELECT event_id, user_id, CASE WHEN fa IS NULL OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', ba)) <= epoch(date_trunc('second', fa)) - epoch(date_trunc('second', ts)) THEN CASE WHEN ba IS NOT NULL THEN bp END ELSE fp END AS purchase_id FROM m""")
def c13_nearest_in_time(spark, d):
    events = T.read(spark, d, "events")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return asof.asof_join(views, purchases, "ts", ["user_id"], "nearest", tolerance=3600).select("event_id", "user_id", "purchase_id")


@register(f"WITH {T.POSTS} SELECT instrument, round((max(item_id) - min(item_id)) / (max(CAST(ts AS DATE)) - min(CAST(ts AS DATE))), 8) AS ids_per_day FROM posts GROUP BY instrument")
def c14_id_rate(spark, d):
    return rounded(calendar.id_rate(T.posts(spark, d)))


@register(f"WITH {T.BARS}, {T.FOREIGN} SELECT b.instrument, b.date, a.date AS matched_on, round(vix_close, 6) AS vix_close FROM bars b ASOF LEFT JOIN abroad a ON a.date < b.date")
def j3_asof_backward_strict(spark, d):
    left = T.bars(spark, d).select("instrument", "date").withColumn("_all", F.lit(1))
    right = T.foreign(spark, d).withColumn("_all", F.lit(1))
    # The bars of all instruments meet one foreign index: its months are the buckets.
    return rounded(asof.asof_join(left, right, "date", ["_all"], allow_exact=False, bucket=F.trunc("_on", "month")).drop("_all"), 6)


@register(f"WITH {T.BARS}, {T.FOREIGN} SELECT b.instrument, b.date, b.volume AS embedded_vix_close, a.date AS matched_on, round(a.vix_close, 6) AS vix_close FROM bars b ASOF LEFT JOIN abroad a ON a.date < b.date")
def j4_replace_by_asof(spark, d):
    left = T.bars(spark, d).select("instrument", "date", F.col("volume").alias("vix_close"), F.lit(1).alias("_all"))
    out = asof.replace_by_asof(left, T.foreign(spark, d).withColumn("_all", F.lit(1)), ["vix_close"], "date", ["_all"])
    return rounded(out.drop("_all"), 6, embedded_vix_close=6)


@register(f"WITH {T.POSTS}, {T.CALENDAR} SELECT p.item_id, c.date AS matched_on FROM (SELECT *, CAST(ts AS DATE) AS date FROM posts) p ASOF LEFT JOIN calendar c ON c.instrument = p.instrument AND c.date > p.date")
def j5_asof_forward(spark, d):
    left = T.posts(spark, d).select("instrument", "item_id", F.to_date("ts").alias("date"))
    out = asof.asof_join(left, T.calendar(spark, d), "date", ["instrument"], "forward", allow_exact=False, bucket=F.trunc("_on", "week"))
    return out.select("item_id", "matched_on")


@register("SELECT p_partkey, d.word FROM part JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) d ON contains(p_name, d.word) OR contains(p_type, d.word)")
def j6_contains_join(spark, d):
    part = T.read(spark, d, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return matching.contains_join(part, names, ["p_name", "p_type"]).select("p_partkey", F.col("name").alias("word"))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def j7_anti_join(spark, d):
    big = T.read(spark, d, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.read(spark, d, "orders").join(big, "o_orderkey", "left_anti").select("o_orderkey")


@register("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j8_map_lookup(spark, d):
    nation = T.read(spark, d, "nation")
    return T.read(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name")


@register("""WITH o AS (SELECT event_id, user_id, event_type, ts, 0 AS prio FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, user_id, event_type, ts + INTERVAL 1 HOUR, 1 FROM events WHERE event_id % 3 <> 1),
b AS (SELECT * FROM o UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prio, ts) AS k FROM b) SELECT event_id, ts, event_type FROM r WHERE k = 1""")
def s16_accumulate(spark, d):
    events = T.read(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    new = events.filter("event_id % 3 <> 1").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return posts.accumulate(events.filter("event_id % 3 <> 0"), new, ["event_id"]).select("event_id", "ts", "event_type")


@register("""WITH o AS (SELECT event_id, event_type, ts, 0 AS prio FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, event_type, ts + INTERVAL 1 HOUR, 1 FROM events WHERE event_id % 3 <> 1),
b AS (SELECT * FROM o UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prio, ts) AS k FROM b) SELECT event_id, ts, event_type FROM r WHERE k = 1""")
def s16_keyed_store(spark, d):
    """The same rows through a store of buckets: a first run, and a second one that adds what the store lacks."""
    store = shared_path(spark, "store")
    events = T.read(spark, d, "events").select("event_id", "event_type", "ts")
    keyed_store.upsert(events.filter("event_id % 3 <> 0"), store, ["event_id"], ["ts"])
    later = events.filter("event_id % 3 <> 1").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return keyed_store.upsert(later, store, ["event_id"], ["ts"]).select("event_id", "ts", "event_type")


@register("""WITH c AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events), a AS (SELECT u.user_id, CAST(x AS DATE) AS date FROM (SELECT DISTINCT user_id FROM events) u, range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(x))
SELECT user_id, date FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = a.user_id AND c.date = a.date)""")
def s17_uncovered_days(spark, d):
    return posts.uncovered_days(T.read(spark, d, "events"), "2024-01-01", "2024-01-30", by="user_id")


@register(f"WITH {T.POSTS} SELECT instrument, count(*) AS n FROM posts WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) - 10 FROM posts) GROUP BY instrument")
def s18_retention(spark, d):
    rows = T.posts(spark, d)
    last = rows.agg(F.date_sub(F.max(F.to_date("ts")), 10).alias("start"))
    return rows.join(F.broadcast(last), F.to_date("ts") >= F.col("start")).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))  # one row


@register("SELECT source, count(*) AS n FROM documents GROUP BY source")
def t18_source_counts(spark, d):
    return T.read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT d.doc_id FROM documents d JOIN (SELECT source, lang FROM documents GROUP BY ALL HAVING count(*) >= 5) e ON e.source = d.source AND e.lang = d.lang")
def t12_eligible_sources(spark, d):
    docs = T.read(spark, d, "documents")
    pairs = docs.groupBy("source", "lang").count().filter("count >= 5")
    return posts.eligible(docs, pairs, ("source", "lang")).select("doc_id")


@register(f"WITH {T.INDEX} SELECT instrument, 0 AS intraday_conflicts, 0 AS overnight_conflicts FROM index GROUP BY instrument")
def k2_flag_consistency(spark, d):
    return checks.flag_conflicts(_index(spark, d))


@register(f"WITH {T.POSTS} SELECT instrument, count(*) AS n, min(ts) AS first, max(ts) AS last FROM posts GROUP BY instrument")
def k8_span(spark, d):
    return checks.span(T.posts(spark, d), "instrument", "ts")
