"""Queries through the readers and writers (S1-S7, S19, S20) and the instrument table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.plans import tables as T
from tidemark.plans.base import registry
from tidemark.sources import readers
from tidemark.streaming.streams import shared_folder

QUERIES, ORACLES, register = registry()
_ORDERS = StructType([StructField("o_orderkey", LongType()), StructField("code", StringType()), StructField("price", DoubleType()), StructField("date", DateType())])


@register("SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, o_totalprice AS price, CAST(o_orderdate AS DATE) AS date FROM orders")
def s1_s5_s7_s19_csv(spark, d):
    """Orders written as headered CSV, with keys of leading zeros and other header names, and read by schema."""
    out = shared_folder(spark)
    rows = T.read(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("종목코드"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("날짜"))
    readers.write_csv(rows, out)
    return readers.read_csv(spark, out, _ORDERS, {"종목코드": "code", "날짜": "date"})


@register("SELECT doc_id, md5(text || ' 가나다') AS text_md5 FROM documents")
def s2_encodings(spark, d):
    """All texts, with Korean letters at their ends, as CSV files in three encodings in one folder; each file is read in the first that fits.
    Texts of letters that the Korean encodings hold are dealt over all three, the others are written in UTF-8."""
    out = shared_folder(spark)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    text = F.concat("text", F.lit(" 가나다"))
    rows = T.read(spark, d, "documents").select("doc_id", text.alias("text"))
    dealt = F.when(F.col("text").rlike(r"^[\x00-\x7F가-힣]*$"), F.pmod("doc_id", F.lit(3))).otherwise(0)
    for k, encoding in enumerate(readers.ENCODINGS):
        rows.filter(dealt == k).write.option("header", True).option("encoding", encoding).option("escape", '"').csv(f"{out}/e{k}")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    # Texts hold line ends; several files of each encoding are read at once.
    return readers.read_csv_any(spark, f"{out}/*", schema, multi_line=True).select("doc_id", F.md5("text").alias("text_md5"))


@register("SELECT *, row_number() OVER (ORDER BY instrument, date) AS place FROM (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY ALL)")
def k7_sorted_sink(spark, d):
    """Daily counts written in the order of instrument and date; the place of each row follows from its file and its place there."""
    out = shared_folder(spark)
    rows = T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    readers.write_csv(rows, out, order=["instrument", "date"])
    schema = StructType([StructField("instrument", StringType()), StructField("date", DateType()), StructField("n", LongType())])
    raw = spark.read.option("header", True).schema(schema).csv(out)
    # The files are small result tables: one window numbers the rows as they stand.
    stood = raw.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    return stood.select("instrument", "date", "n", F.row_number().over(Window.orderBy("file", "at")).cast("long").alias("place"))


@register("SELECT c_custkey, c_name FROM customer")
def s3_optional_source(spark, d):
    """A source that isn't there adds no rows."""
    customer = T.read(spark, d, "customer").select("c_custkey", "c_name")
    return customer.unionByName(readers.optional(spark, f"{d}/no_such_file.csv", customer.schema))


@register("SELECT event_type AS instrument, 'value' AS target, 'all' AS model, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type")
def s20_metric_documents(spark, d):
    """Metrics as nested JSON documents, one per instrument, and read back as long rows."""
    out = shared_folder(spark)
    n = F.create_map(F.lit("all"), F.create_map(F.lit("n"), F.count(F.lit(1)).cast("double")))
    readers.write_json(T.read(spark, d, "events").groupBy(F.col("event_type").alias("instrument")).agg(n.alias("metrics")).withColumn("target", F.lit("value")), out)
    return readers.read_metrics(spark, out)


_DIM = [("A", "000001", "kospi"), ("N", "000002", "kosdaq"), ("R", "000003", "kospi")]


@register(f"WITH {T.BARS}, dim(instrument, code, market) AS (VALUES {', '.join(str(x) for x in _DIM)}) SELECT b.instrument, code, market, date, close FROM bars b JOIN dim ON dim.instrument = b.instrument")
def f20_instrument_columns(spark, d):
    dim = readers.require_columns(spark.createDataFrame(_DIM, "instrument string, code string, market string"), ["instrument", "code", "market"])
    return T.bars(spark, d).join(dim, "instrument").select("instrument", "code", "market", "date", "close")
