"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, settle, shared_dir, shared_path  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What a cache of words holds in a Python worker: bytes with what dictionaries add, and the length up to which words are kept.
CACHE_BYTES, KEPT_LENGTH = 100_000_000, 64
#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\v\f\r"
#: Word characters of the ASCII-aware word pattern: everything but ASCII non-alphanumerics and capitals.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; a translation of 26 characters, other letters stay."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def weight(words: Collection[str | bytes], values: Iterable[bytes] = ()) -> int:
    """About the bytes that cached words and their values take at most."""
    return 200 * len(words) + 4 * sum(map(len, words)) + sum(map(len, values))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(id_col: str = "doc_id") -> Column:
    """True for rows that a model may learn labels from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def sampled(docs: DataFrame, labels: DataFrame, mark: str, sample: dict[int, int]) -> DataFrame:
    """text and mark of at most sample[mark] training rows of each mark, chosen by a hash of their ids; ids are broadcast (bounded by the sample)."""
    known = labels.select("doc_id", F.col(mark).cast("int").alias("mark")).filter(training_row() & F.col("mark").isin(*sample))
    known = known.groupBy("doc_id").agg(F.max("mark").alias("mark"))
    chosen = None
    for value, most in sample.items():
        part = known.filter(F.col("mark") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("text", "mark", F.xxhash64("doc_id", "text").alias("place"))
