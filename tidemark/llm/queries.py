"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, gif, hard_negatives, language_id, licenses, lsh_forest, packing, periodic_runs, quality, secrets, sentence_pieces, toxicity, warc
from .common import table


def op1_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_ordinal_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels"), F.expr(quality.GRADE), quality.GRADES))


def op4_sentence_pieces(spark, sf_dir):
    import public_tokenizers

    return sentence_pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op5_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_lsh_forest(spark, sf_dir):
    return lsh_forest.near_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_gif(spark, sf_dir):
    return gif.gif_columns(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


def op12_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.fit(documents))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_ordinal_quality, op4_sentence_pieces, op5_license_scan, op6_secret_scan, op7_lsh_forest, op8_warc, op9_exact_dedup, op10_gif, op11_periodic_runs, op12_language_id, op13_hard_negatives)}
ORACLES = {"op8_warc": warc.ORACLE_SQL, "op7_lsh_forest": lsh_forest.ORACLE_SQL, "op5_license_scan": licenses.ORACLE_SQL, "op6_secret_scan": secrets.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
