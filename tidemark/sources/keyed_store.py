"""A store of rows by key that an ingest run extends without reading all of it.

Rows stand in buckets by a hash of their key. A run reads and rewrites only the buckets that its new rows fall into, under new
names, and then commits a manifest: one small file with the number of the version and the folder of each bucket. Readers take
the manifest of the greatest number, so they see a version as a whole; files of a run that failed belong to no manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 256


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def manifest(spark: SparkSession, store: str) -> dict:
    """The newest version: number, schema, key and buckets (folder by bucket); an empty one where nothing is stored."""
    fs, place = _files(spark, f"{store}/manifests")
    if not fs.exists(place):
        return {"number": 0, "schema": None, "key": None, "n_buckets": None, "buckets": {}}
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    newest = max(n for n in names if n.endswith(".json"))
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests/{newest}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, store: str, found: dict) -> None:
    """Writes the next manifest under a name of its own and renames it; a run that was overtaken raises."""
    fs, draft = _files(spark, f"{store}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(found), "utf-8"))
    out.close()
    _, final = _files(spark, f"{store}/manifests/{found['number']:012d}.json")
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {found['number']} of {store} was committed by another run")


def _bucket(key: list[str], n: int):
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(n)).cast("int")


def read(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the newest version, or of some of its buckets."""
    from pyspark.sql.types import StructType

    known = manifest(spark, store)
    if known["schema"] is None:
        raise ValueError(f"nothing is stored at {store}")
    schema = StructType.fromJson(known["schema"])
    paths = sorted({p for b, p in known["buckets"].items() if buckets is None or int(b) in buckets})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(new: DataFrame, store: str, key: list[str], order: list, replace: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Adds rows of keys that the store lacks and returns the newest version; with ``replace`` new rows take the place of stored ones.

    Of new rows of one key the first by ``order`` counts. Null keys are keys. ``new`` is read twice: for the buckets it touches and for
    its rows. Its columns must be those of the first run, the number of buckets too; a run without rows changes nothing."""
    spark = new.sparkSession
    known = manifest(spark, store)
    if known["schema"] is not None and (known["key"] != key or [f["name"] for f in known["schema"]["fields"]] != new.columns):
        raise ValueError(f"the rows of {store} have other columns or another key")
    n = known["n_buckets"] or buckets
    rows = new.withColumn("_bucket", _bucket(key, n))
    touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most n numbers
    if not touched:
        return read(spark, store) if known["schema"] else new
    held = rows.withColumn("_side", F.lit(0 if replace else 1))
    if any(str(b) in known["buckets"] for b in touched):
        stored = read(spark, store, touched)
        held = held.unionByName(stored.withColumn("_bucket", _bucket(key, n)).withColumn("_side", F.lit(1 if replace else 0)))
    first = F.row_number().over(Window.partitionBy("_bucket", *key).orderBy("_side", *order))
    kept = held.withColumn("_first", first).filter("_first = 1").drop("_first", "_side")
    folder = f"{store}/data/{uuid.uuid4().hex}"
    kept.write.partitionBy("_bucket").parquet(folder)
    _commit(spark, store, {"number": known["number"] + 1, "schema": new.schema.jsonValue(), "key": key, "n_buckets": n, "buckets": known["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}})
    return read(spark, store)
