import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.functions import text as X
from tidemark.operators import features, posts
from tidemark.sources import pages, readers


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [(None, ""), ("<b>a</b>b", "a b"), ("see https://x.y/z?q=1 now", "see now"), ("aaa", "aaa"), ("aaaa", "aaa"), ("ab!!!!!!c", "ab!!!c"), ("hi 🎉 you", "hi you"), ("a　b", "a b"), ("한국 주식 ㅋㅋ", "한국 주식")],
)
def test_clean(spark, text, want):
    assert one(spark, X.clean_text, text) == want


def test_low_signal(spark):
    test = lambda t: one(spark, lambda c: X.low_signal(c, ["[특징주]".strip("[]"), "속보"], ["severe"], ["meh"]), t)
    assert test("") and test("[ 속보 ]") and test("x severe y " * 9) and test("meh 12345678901") and not test("meh 123456789012") and not test("fine text")
    assert not one(spark, lambda c: X.holds_any(c, ["a.c"]), "abc") and one(spark, lambda c: X.holds_any(c, ["a.c"]), "xa.c")


def test_join_text(spark):
    row = spark.createDataFrame([("a", None)], "a string, b string").select(X.join_text(F.col("a"), F.col("b")).alias("x"), X.named_id("news", F.lit(3)).alias("i")).first()
    assert tuple(row) == ("a. ", "news_3")


def test_timestamps(spark):
    rows = ["202401021530", "2024.01.02 15:30", "2024.01.02", "Tue Jan 02 15:30:05 KST 2024", "2024-01-02T15:30:05+09:00", "x 1704209405000 y", "junk", None]
    got = [r.x for r in spark.createDataFrame([(r,) for r in rows], "t string").select(pages.any_timestamp(F.col("t")).alias("x")).collect()]
    t = dt.datetime(2024, 1, 2, 15, 30)
    assert got == [t, t, dt.datetime(2024, 1, 2), t.replace(second=5), t.replace(second=5), t.replace(second=5), None, None]


def test_pages(spark):
    html = '<tr><td>2024.01.02 10:00</td><td><a href="/r?code=1&amp;nid=77">T<b>x</b></a></td><td>me</td><td>5</td><td>1</td><td>0</td></tr><tr><td>2024.01.02</td><td>no link</td><td></td><td></td><td></td><td></td></tr><tr><td>short</td></tr>'
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert [tuple(r) for r in pages.table_rows(df).select("nid", "date", "title", "views").collect()] == [("77", "2024.01.02 10:00", "Tx", "5")]
    heads = spark.createDataFrame([(["a", "b"], ["x"])], "h array<string>, b array<string>")
    assert [(r.headline, r.body) for r in pages.paired(heads, F.col("h"), F.col("b")).collect()] == [("a", "x"), ("b", "")]
    items = spark.createDataFrame([('{"groups":[{"items":[{"id":1},{"id":2}]},{"items":[]}]}',)], "j string")
    assert [r.id for r in pages.groups_to_items(items, "j", "id: int").collect()] == [1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿코드,n\n000660,1\n".encode())
    (tmp_path / "b.csv").write_bytes("코드,n\n가나,x\n".encode("cp949"))
    schema = StructType([StructField("code", StringType()), StructField("n", IntegerType())])
    got = readers.read_csv_any(spark, str(tmp_path), schema, {"코드": "code"})
    assert {tuple(r) for r in got.collect()} == {("000660", 1), ("가나", None)}
    assert readers.optional(spark, str(tmp_path / "none.csv"), schema).count() == 0
    with pytest.raises(ValueError, match="volume"):
        readers.require_columns(got, ["code", "volume"])
    readers.write_csv(got.select(F.lit(1 / 3).alias("x")), str(tmp_path / "out"), digits=4)
    assert {r.x for r in readers.read_csv(spark, str(tmp_path / "out")).collect()} == {"0.3333"}
    spark.createDataFrame([("a", "pk", {"m": {"RMSE": 0.12345}})], "instrument string, target string, metrics map<string, map<string, double>>").write.json(str(tmp_path / "metrics"))
    wide = readers.metric_table(readers.read_metrics(spark, str(tmp_path / "metrics")), ["m"])
    assert wide.first().m == 0.1235
    readers.run_metadata(spark, {"rows": 3}, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first().rows == 3


def test_scan_reads_the_used_column_only(spark, tmp_path):
    readers.write_csv(spark.createDataFrame([(1, "x"), (2, "y")], "date int, text string"), str(tmp_path / "t"))
    plan = readers.read_csv(spark, str(tmp_path / "t")).select("date")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date:string>" in plan


def test_sorted_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "n int").repartition(7)
    readers.write_csv(rows, str(tmp_path / "t"), order=["n"])
    files = sorted((tmp_path / "t").glob("part-*.csv"))
    assert [int(x) for f in files for x in f.read_text().split()[1:]] == list(range(101))


def test_blocked_pages_raise(spark):
    df = spark.createDataFrame([(2, False), (0, True)], "n int, none boolean")
    status = pages.page_status(F.col("n"), F.col("none"))
    assert pages.require_pages(df, status).count() == 2
    with pytest.raises(ValueError, match="1 pages"):
        pages.require_pages(df.union(spark.createDataFrame([(0, False)], df.schema)), status)


def test_scorer_limit(spark):
    import pandas as pd

    def words():
        return lambda texts: pd.DataFrame({"negative": 0.0, "neutral": 0.0, "positive": [float(len(t.split())) for t in texts]})

    df = spark.createDataFrame([("a b  c d",), (" ",), ("a",), (None,)], "text string")
    score = lambda **limit: [r.sentiment_score for r in posts.score_texts(df.coalesce(1), words, batch=3, **limit).collect()]
    assert score() == [4.0, 1.0, 1.0, 1.0] and score(most_tokens=3) == [3.0, 1.0, 1.0, 1.0]


def test_normalise(spark):
    df = spark.createDataFrame([(" 1,234.5 ", "2024/01/02"), ("x", "2024.13.01"), (None, None)], "n string, d string")
    got = [tuple(r) for r in df.select(features.numeric(F.col("n")), features.date_value(F.col("d"))).collect()]
    assert got == [(1234.5, dt.date(2024, 1, 2)), (None, None), (None, None)]
