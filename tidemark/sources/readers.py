"""Readers and writers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

ENCODINGS = ("UTF-8", "x-windows-949", "EUC-KR")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, aliases: dict[str, str] | None = None, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Headered CSV as text, a byte-order mark dropped, headers renamed; with a schema its columns are cast, so ids keep their zeros.

    Columns that a query doesn't use are pruned by Spark. ``multi_line`` is for fields that hold line ends; it makes each file one task."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.removeprefix("﻿").strip() for c in raw.columns])
    raw = raw.withColumnsRenamed(aliases or {})
    if schema is None:
        return raw
    require_columns(raw, schema.fieldNames())
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


@F.pandas_udf(StructType([StructField(n, BooleanType()) for n in ("utf_8", "windows_949", "euc_kr")]))
def _decodes(line: pd.Series) -> pd.DataFrame:
    """Which encodings the bytes of each line can be in."""

    def fits(data: bytes, codec: str) -> bool:
        try:
            data.decode(codec)
        except UnicodeDecodeError:
            return False
        return True

    return pd.DataFrame({n: [fits(x, c) for x in line] for n, c in (("utf_8", "utf-8"), ("windows_949", "cp949"), ("euc_kr", "euc-kr"))})


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Path and first fitting encoding of each file. Lines are tested where they are read (no character's later bytes hold a line end), so
    files of any size are split and none is held whole."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), _decodes(F.col("value").cast("binary")).alias("fits"))
    found = lines.groupBy("path").agg(*[F.bool_and(f"fits.{c}").alias(c) for c in ("utf_8", "windows_949", "euc_kr")])
    first = F.coalesce(*[F.when(F.col(c), n) for c, n in zip(("utf_8", "windows_949", "euc_kr"), ENCODINGS)])
    return found.select("path", first.alias("encoding"))


def read_csv_any(spark: SparkSession, path: str, schema: StructType | None = None, aliases: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """Files of mixed encodings as one frame; raises where none fits. The driver learns each file's path and encoding, as Spark's own index
    of the files holds the paths. Encodings beyond Spark's list need spark.sql.legacy.javaCharsets, which is set for the session."""
    groups: dict = {}
    for r in file_encodings(spark, path).toLocalIterator():
        groups.setdefault(r.encoding, []).append(r.path)
    if None in groups:
        raise ValueError(f"no known encoding: {groups[None]}")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    out = None
    for encoding, paths in sorted(groups.items()):
        raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"').csv(paths)
        raw = raw.toDF(*[c.removeprefix("\ufeff").strip() for c in raw.columns]).withColumnsRenamed(aliases or {})
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    if schema is None:
        return out
    require_columns(out, schema.fieldNames())
    return out.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3: a missing file is an empty frame of the schema."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raises with the columns that are missing, before any job."""
    if missing := sorted(set(names).difference(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def write_csv(df: DataFrame, path: str, digits: int | None = None, order: list[str] | None = None) -> None:
    """Headered CSV; doubles rounded to significant digits, and the whole table in an order (files by ranges of it), on request."""
    if order:
        df = df.orderBy(*order)
    if digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """S20."""
    df.write.mode("overwrite").json(path)


def run_metadata(spark: SparkSession, facts: dict, path: str) -> None:
    """One nested document of a run."""
    spark.createDataFrame([(json.dumps(facts, default=str, ensure_ascii=False),)], StructType([StructField("value", StringType())])).coalesce(1).write.mode("overwrite").text(path)


def metric_table(metrics: DataFrame, models: list[str], digits: int = 4) -> DataFrame:
    """Long metrics (instrument, target, model, metric, value) as one row per instrument, target and metric."""
    return metrics.groupBy("instrument", "target", "metric").pivot("model", models).agg(F.round(F.first("value"), digits))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """{model: {metric: value}} documents with instrument and target, as long rows."""
    raw = spark.read.schema("instrument string, target string, metrics map<string, map<string, double>>").json(path)
    each = raw.select("instrument", "target", F.explode("metrics").alias("model", "m"))
    return each.select("instrument", "target", "model", F.explode("m").alias("metric", "value"))
