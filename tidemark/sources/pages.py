"""Rows out of raw pages and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_tags


def groups_to_items(docs: DataFrame, column: str, item: str) -> DataFrame:
    """JSON pages {"groups": [{"items": [...]}]} as one row per item; ``item`` is its struct in DDL."""
    parsed = F.from_json(column, f"groups array<struct<items:array<struct<{item}>>>>")
    return docs.withColumn("_item", F.explode(F.flatten(F.transform(parsed["groups"], lambda g: g["items"])))).select(*[c for c in docs.columns if c != column], "_item.*")


COMMENT = "commentId string, createdAt string, author struct<nickname:string>, message string, holding struct<shareHoldingStatus:string>, statistic struct<likeCount:bigint,readCount:bigint,replyCount:bigint>"


def flatten_comments(docs: DataFrame, column: str) -> DataFrame:
    """Nested comments as flat columns; without a holding, is_holder is false."""
    c = F.from_json(column, COMMENT)
    return docs.withColumn("_c", c).select(
        *[x for x in docs.columns if x != column], F.col("_c.commentId").alias("comment_id"), F.col("_c.author.nickname").alias("author"), F.col("_c.message").alias("message"),
        F.coalesce(F.col("_c.holding.shareHoldingStatus") == "HOLDING", F.lit(False)).alias("is_holder"),
        F.col("_c.statistic.likeCount").alias("likes"), F.col("_c.statistic.readCount").alias("reads"), F.col("_c.statistic.replyCount").alias("replies"),
    )


def table_rows(pages: DataFrame, html: str = "html", cells: int = 6) -> DataFrame:
    """Rows of list tables that have exactly ``cells`` cells, a date in the first and in the second a link with an nid parameter.

    The title is the link's title attribute, where list pages keep what they shorten, or else its text."""
    row = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    rows = pages.withColumn("_row", row).withColumn("_td", F.regexp_extract_all("_row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)))
    rows = rows.filter(F.size("_td") == cells).withColumn("_a", F.regexp_extract(F.col("_td")[1], r"(?s)<a\s[^>]*>.*?</a>", 0))
    rows = rows.withColumn("_href", F.regexp_replace(F.regexp_extract("_a", r'^<a[^>]*\shref="([^"]*)"', 1), "&amp;", "&"))
    named = F.regexp_extract("_a", r'^<a[^>]*\stitle="([^"]*)"', 1)
    title = F.when(named == "", F.trim(strip_tags(F.col("_a"), ""))).otherwise(named)
    nid = F.regexp_extract("_href", r"[?&]nid=([^&#]*)", 1)
    cell = lambda i: F.trim(strip_tags(F.col("_td")[i], ""))
    out = rows.select(*[c for c in pages.columns if c != html], nid.alias("nid"), F.regexp_extract(cell(0), r"\d{4}\.\d{2}\.\d{2}(?: \d{2}:\d{2})?", 0).alias("date"), title.alias("title"),
                      cell(2).alias("author"), cell(3).alias("views"), cell(4).alias("likes"), cell(5).alias("dislikes"), F.col("_href").alias("url"))
    return out.filter((F.col("nid") != "") & (F.col("date") != ""))


def captures(pages: DataFrame, pattern: str, names: list[str], column: str = "html") -> DataFrame:
    """One row for every match of a pattern, its groups as columns, tags stripped."""
    groups = [F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    rows = pages.withColumn("_m", F.explode(F.arrays_zip(*groups)))
    return rows.select(*[c for c in pages.columns if c != column], *[strip_tags(F.col("_m")[n], "").alias(n) for n in names])


def paired(pages: DataFrame, heads: Column, bodies: Column) -> DataFrame:
    """The i-th headline with the i-th body, empty where there are fewer bodies."""
    rows = pages.withColumns({"_heads": heads, "_bodies": bodies}).select("*", F.posexplode("_heads").alias("place", "headline"))
    return rows.withColumn("body", F.coalesce(F.try_element_at("_bodies", F.col("place") + 1), F.lit(""))).drop("_heads", "_bodies")


def page_status(items: Column, none_marker: Column) -> Column:
    """Ok with items, end where the page says there are none, else blocked."""
    return F.when(items > 0, "ok").when(none_marker, "end").otherwise("blocked")


def require_pages(pages: DataFrame, status: Column) -> DataFrame:
    """Raises with the number of blocked pages, so that a block doesn't pass for a day without items."""
    blocked = pages.filter(status == "blocked").count()
    if blocked:
        raise ValueError(f"{blocked} pages have neither items nor a note that there are none")
    return pages


def any_timestamp(text: Column) -> Column:
    """Wall-clock times of yyyyMMddHHmm, yyyy.MM.dd HH:mm, yyyy.MM.dd, "Mon Jan 01 00:00:00 KST 2024", ISO with or without offset
    (the offset is dropped, the clock kept) and milliseconds since the epoch within a text; null otherwise."""
    t = F.trim(text)
    # Weekday and zone go before parsing.
    worded = F.regexp_replace(t, r"^[A-Za-z]{3} ([A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2}) [A-Z]+ (\d{4})$", "$1 $2")
    iso = F.regexp_replace(F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    parse = lambda x, f: F.try_to_timestamp(x, F.lit(f)).cast("timestamp_ntz")
    shaped = lambda x, shape, f: F.when(x.rlike(shape), parse(x, f))
    millis = F.regexp_extract(t, r"(\d{13})", 1)
    return F.coalesce(
        shaped(t, r"^\d{12}$", "yyyyMMddHHmm"), shaped(t, r"^\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}$", "yyyy.MM.dd HH:mm"), shaped(t, r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.MM.dd"),
        shaped(worded, r"^[A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2} \d{4}$", "MMM dd HH:mm:ss yyyy"), iso.try_cast("timestamp_ntz"),
        F.when(millis != "", F.timestamp_millis(millis.try_cast("long")).cast("timestamp_ntz")),
    )


def noon(date: Column) -> Column:
    """A day without a time is its noon."""
    return date.cast("date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
