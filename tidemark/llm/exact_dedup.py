"""Exact dedup with a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary (``DataFrame.stat.freqItems``) names at most 1/support digests that may hold more than ``support``
of all rows. Exact winners of those are counted with map-side combination and broadcast (the bound on their number
holds at any size), so a hot digest is never shuffled; all other digests are shuffled once, and none of them can hold
more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, settle, text_or_empty


def digest(text: Column) -> Column:
    """SHA-256 in lower-case hex of the UTF-8 text without characters of [\\x20\\x09-\\x0D]."""
    return F.sha2(F.translate(text, SPACES, ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text, the one with the most code points in its original text stays, then the smallest
    id. Null text counts as empty; empty texts are one group. Null ids sort last. Repeated rows all appear and count in
    group_size; those that carry the kept id are all marked kept. An empty table gives an empty result. Columns other
    than id and text are ignored, so names may clash. Ids of any one type; nothing is collected to the driver.
    """
    text = text_or_empty(text_col)
    rows = settle(
        docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("text_sha256"), F.length(text).alias("code_points")), "digests"
    )
    rank = F.struct((-F.col("code_points")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    hot = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    hot = F.broadcast(hot)  # at most 1/support rows
    winners = (
        rows.join(hot, "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    others = rows.join(hot, "text_sha256", "left_anti").withColumns(
        {"best": F.min(rank).over(group), "group_size": F.count(F.lit(1)).over(group)}
    )
    columns = (
        F.col("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), F.col("text_sha256"),
    )
    return frequent.select(*columns).unionByName(others.select(*columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
