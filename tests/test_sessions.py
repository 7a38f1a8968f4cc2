import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, calendar, checks, posts
from tidemark.streaming import streams

D = dt.date
TS = lambda s: dt.datetime.fromisoformat(s)


def cal(spark, days):
    return spark.createDataFrame([("a", D.fromisoformat(x)) for x in days], "instrument string, date date")


def posts_at(spark, times, score=1.0):
    return spark.createDataFrame([("a", i, TS(t), score) for i, t in enumerate(times)], "instrument string, item_id int, ts timestamp_ntz, score double")


def test_session_boundaries(spark):
    times = ["2024-01-04T08:59:59", "2024-01-04T09:00:00", "2024-01-04T15:29:59", "2024-01-04T15:30:00", "2024-01-04T23:59:00", "2024-01-06T12:00:00", "2024-01-01T10:00:00", "2024-01-09T16:00:00", "2023-12-25T10:00:00"]
    out = {r.item_id: (str(r.session_date), r.session) for r in calendar.assign_session(posts_at(spark, times), cal(spark, ["2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09"])).collect()}
    assert out == {0: ("2024-01-04", "overnight"), 1: ("2024-01-04", "intraday"), 2: ("2024-01-04", "intraday"), 3: ("2024-01-05", "overnight"), 4: ("2024-01-05", "overnight"),
                   5: ("2024-01-08", "overnight"), 6: ("2024-01-04", "overnight"), 7: ("None", None), 8: ("2024-01-04", "overnight")}
    near = calendar.assign_session(posts_at(spark, times), cal(spark, ["2024-01-04"]), max_gap_days=5)
    assert near.filter("item_id = 8").first().session_date is None


def test_provisional_day(spark):
    friday = cal(spark, ["2024-01-04", "2024-01-05"])
    late = calendar.with_provisional(friday, posts_at(spark, ["2024-01-05T15:30:00"])).collect()
    assert ("a", D(2024, 1, 8), 0) in [tuple(r) for r in late]
    early = calendar.with_provisional(friday, posts_at(spark, ["2024-01-05T15:29:59"]))
    assert early.count() == 2


def test_index_zero_fill(spark):
    p = posts_at(spark, ["2024-01-04T10:00:00"], 0.0).union(posts_at(spark, ["2024-01-05T10:00:00"], None))
    c = cal(spark, ["2024-01-04", "2024-01-05"])
    rows = {str(r.date): r for r in calendar.session_index(calendar.session_means(calendar.assign_session(p, c)), c.withColumn("price_available", F.lit(1))).collect()}
    assert (rows["2024-01-04"].intraday_sentiment_index, rows["2024-01-04"].intraday_no_posts) == (0.0, 0)  # neutral, not unknown
    assert (rows["2024-01-05"].intraday_item_count, rows["2024-01-05"].intraday_no_posts) == (0, 1)
    assert rows["2024-01-04"].overnight_no_posts == 1


@pytest.mark.parametrize("bucket", [None, F.trunc])
def test_asof(spark, bucket):
    left = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 5)), (3, D(2024, 3, 9)), (4, D(2023, 1, 1))], "id int, date date").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(D(2024, 1, 1), 10), (D(2024, 1, 4), None), (D(2024, 1, 5), 30)], "date date, v int").withColumn("k", F.lit(1))
    b = bucket("_on", "month") if bucket else None
    get = lambda **o: {r.id: (str(r.matched_on), r.v) for r in asof.asof_join(left, right, "date", ["k"], bucket=b, **o).collect()}
    assert get() == {1: ("2024-01-01", 10), 2: ("2024-01-05", 30), 3: ("2024-01-05", 30), 4: ("None", None)}
    assert get(allow_exact=False) == {1: ("None", None), 2: ("2024-01-04", None), 3: ("2024-01-05", 30), 4: ("None", None)}
    assert get(direction="forward") == {1: ("2024-01-01", 10), 2: ("2024-01-05", 30), 3: ("None", None), 4: ("2024-01-01", 10)}
    assert get(direction="forward", allow_exact=False)[1] == ("2024-01-04", None)
    assert get(tolerance=86400)[3] == ("None", None)


def test_nearest(spark):
    left = spark.createDataFrame([(1, TS("2024-01-01T10:00:00")), (2, TS("2024-01-01T12:00:00"))], "id int, ts timestamp_ntz").withColumn("k", F.lit(1))
    left = left.union(left.filter("id = 1"))
    right = spark.createDataFrame([(TS("2024-01-01T09:50:00"), 1), (TS("2024-01-01T10:05:00"), 2)], "ts timestamp_ntz, v int").withColumn("k", F.lit(1))
    out = asof.asof_join(left, right, "ts", ["k"], "nearest", tolerance=3600)
    assert sorted((r.id, r.v or 0) for r in out.collect()) == [(1, 2), (1, 2), (2, 0)]


def test_guards(spark):
    one = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="right"):
        asof.one_to_one(one.filter("v = 2"), one.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(ValueError, match="1 rows"):
        checks.require_unique(one, ["k"])
    flags = spark.createDataFrame([("a", 0, 0, 1, 0)], "instrument string, intraday_item_count int, intraday_no_posts int, overnight_item_count int, overnight_no_posts int")
    with pytest.raises(ValueError):
        checks.require_flags(flags)


def test_accumulate_keeps_old(spark):
    old = spark.createDataFrame([(1, TS("2024-01-02T00:00:00"), "old"), (None, TS("2024-01-02T00:00:00"), "null")], "id int, ts timestamp_ntz, v string")
    new = spark.createDataFrame([(1, TS("2024-01-01T00:00:00"), "new"), (2, TS("2024-01-01T00:00:00"), "x"), (None, TS("2024-01-01T00:00:00"), "late")], "id int, ts timestamp_ntz, v string")
    assert {(r.id, r.v) for r in posts.accumulate(old, new, ["id"]).collect()} == {(1, "old"), (2, "x"), (None, "null")}


def test_stream_equals_batch(spark, tmp_path):
    times = [f"2024-01-0{d}T{h:02d}:10:00" for d in (4, 5, 6, 8) for h in (3, 10, 16)]
    rows = [(i, TS(t), 7, "a", float(i * 10)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    days = cal(spark, ["2024-01-04", "2024-01-05", "2024-01-08"])
    streamed = {(r.date, r.session): (round(r.sentiment_index, 9), r.item_count) for r in streams.session_index(spark, str(tmp_path), days).collect()}
    p = spark.createDataFrame([("a", r[1], (r[4] - 100) / (r[4] + 100)) for r in rows], "instrument string, ts timestamp_ntz, score double")
    batch = {(r.date, r.session): (round(r.sentiment_index, 9), r.item_count) for r in calendar.session_means(calendar.assign_session(p, days)).collect()}
    assert streamed == batch
    once = streams.run_once(spark, str(tmp_path), "events", lambda s: streams.accumulate_once(s.unionByName(s), ["event_id"]))
    assert once.count() == len(rows)


@pytest.mark.parametrize("bucket", [None, "minute", "hour"])
@pytest.mark.parametrize("exact", [True, False])
def test_nearest_of_a_long_key(spark, bucket, exact):
    """Equal times, several right rows of one time and buckets without right rows, against a plain search."""
    import random

    r = random.Random(5)
    at = lambda m: TS("2024-01-01T10:00:00") + dt.timedelta(seconds=m)
    marks = [(k, s, r.randrange(99)) for k in (1, 2) for s in [r.choice([r.randrange(300), r.randrange(9000, 9300)]) for _ in range(80)]]
    points = [(i, r.choice([1, 2, 3]), r.choice([r.randrange(400), r.randrange(12000)])) for i in range(300)]
    left = spark.createDataFrame([(i, k, at(s)) for i, k, s in points], "id int, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(k, at(s), v) for k, s, v in marks] + [(1, None, 5)], "k int, ts timestamp_ntz, v int")
    out = asof.asof_join(left, right, "ts", ["k"], "nearest", allow_exact=exact, tolerance=2000, bucket=bucket and F.date_trunc(bucket, "_on"))
    got = {x.id: (x.matched_on, x.v) for x in out.collect()}
    for i, k, s in points:
        near = [(abs(s - t), t, -v) for j, t, v in marks if j == k and abs(s - t) <= 2000 and (exact or s != t)]
        want = min(near, default=None)
        assert got[i] == ((None, None) if want is None else (at(want[1]), -want[2]))


def test_no_frame_up_to_the_last_row(spark):
    """Such a frame is summed up anew at each row, so a key's work would grow with the square of its rows."""
    rows = spark.range(10).select(F.lit("a").alias("instrument"), F.col("id").cast("int").alias("item_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    other = rows.withColumnRenamed("item_id", "v")
    days = rows.select("instrument", F.to_date("ts").alias("date")).distinct()
    for out in (asof.asof_join(rows, other, "ts", ["instrument"], "nearest", bucket=F.date_trunc("hour", "_on")), asof.asof_join(rows, other, "ts", ["instrument"], "nearest", allow_exact=False), calendar.assign_session(rows, days)):
        plan = out._jdf.queryExecution().analyzed().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
