"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more; other tables are left alone."""
    for t in tables:
        path = getattr(t, "settled_at", None)
        if path:
            jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)
