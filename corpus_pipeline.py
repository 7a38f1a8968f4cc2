"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lsh_forest, packing, secrets, toxicity
from tidemark.llm.common import discard, settle, table, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the model learns from the labels of the same corpus.

    Null and empty texts score as texts without tokens. Null ids and repeated rows are scored like others. Columns of any
    names stay; an empty table stays empty."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each of ``keys``. rows: keys, text and row, a struct of the document's columns. The longest text stays, then
    the least by digests of the text and of the whole row; rows equal in all are one."""
    columns = rows.schema["row"].dataType.names
    own = F.struct(*[F.sha2("text", 256).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns], F.col("row.text").isNull().alias("none"))
    rank = F.struct((-F.length("text")).alias("size"), F.sha2("text", 256).alias("text"), F.sha2(F.to_json(own, {"ignoreNullFields": "false"}), 256).alias("row"))
    ranked = rows.withColumn("rank", rank)
    best = ranked.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min("rank").alias("best"))
    same = F.col("rank") == F.col("best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return ranked.join(best, same, "left_semi").dropDuplicates(keys).drop("rank")


def _rows_of(docs: DataFrame, **keys) -> DataFrame:
    """The document as one struct ``row`` beside its text and the keys, so that no column of it can clash with a stage's own."""
    return docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"), *[c.alias(k) for k, c in keys.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one that exact dedup keeps: one row of each group, also where ids
    are null or repeated, so rows equal in all leave one. Null and empty texts are one group. Columns of any names stay; an
    empty table stays empty."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_own")).agg(F.count(F.lit(1)).alias("times"))
    rows = _rows_of(docs, id=F.col("doc_id"), own=exact_dedup.digest(text_or_empty()))
    return _kept_once(rows, settle(kept, "kept"), (F.col("own") == F.col("kept_own")) & F.col("id").eqNullSafe(F.col("kept_id")), ["own"])


def _kept_once(rows: DataFrame, kept: DataFrame, same: Column, keys: list[str], free: str = "false") -> DataFrame:
    """The documents of the rows that ``kept`` names; where it names several rows (times), one of each of ``keys``, unless ``free``, a test on ``kept``, holds.

    Texts meet ``kept`` in one join; rows that several may claim take a second one, which is left out where there are none."""
    several = kept.filter(f"times > 1 AND NOT ({free})")
    if several.isEmpty():
        return rows.join(kept, same, "left_semi").select("row.*")
    single = rows.join(kept.filter(f"times = 1 OR ({free})"), same, "left_semi")
    return single.unionByName(_one_each(rows.join(several, same, "left_semi"), keys)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies. Of rows with one id and one text one stays; an id with several texts
    stays or goes as a whole; null ids are linked with nothing and stay. Null and empty texts are linked with nothing.
    Columns of any names stay; an empty table stays empty. Ids are integers."""
    kept = lsh_forest.near_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("times"))
    rows = _rows_of(docs, id=F.col("doc_id").cast("long")).withColumn("own", F.sha2("text", 256))
    return _kept_once(rows, settle(kept, "kept"), F.col("id").eqNullSafe(F.col("kept_id")), ["id", "own"], "kept_id IS NULL")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan finds replaced by its kind; see secrets.redact for edge cases."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences and their places in training sequences of 2048 ids.

    Null and empty texts are the end id alone; null ids and repeated rows are packed like others; columns other than doc_id
    and text end here; an empty table gives an empty result."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cut_last=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the first and the last stage; tests compare what leaves the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
