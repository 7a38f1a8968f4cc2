"""Queries over texts, pages and nested documents (T, S8-S15, S21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import matching, posts
from tidemark.plans import tables as T
from tidemark.plans.base import registry, rounded
from tidemark.sources import pages as P
from tidemark.sources import readers

QUERIES, ORACLES, register = registry()

MARKERS, SEVERE, MILD = ["that", "inst", "von", "für"], ["idiot", "moron", "scum"], ["and", "the", "der"]
_SPACE = r"[\s\x{85}\p{Z}]"
_CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), 'https?://[^\s\x{{85}}\p{{Z}}]+', ' ', 'g'), "
    r"'[^가-힣a-zA-Z0-9\s\x{{85}}\p{{Z}}.,!?%()~\-À-ÖØ-öø-ÿ]', ' ', 'g'), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))"
)


def _clean(c: str) -> str:
    return _CLEAN.format(c)


def _docs(spark, d):
    return T.read(spark, d, "documents")


@register(f"SELECT doc_id, md5({_clean('text')}) AS clean_md5, length({_clean('text')}) AS clean_length FROM documents")
def t1_clean_text(spark, d):
    """Without the squeeze of repeats; t1_squeezed has it."""
    c = X.clean_text(F.col("text"), X.LATIN, squeeze=False)
    return _docs(spark, d).select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("clean_length"))


#: As _CLEAN, between the URLs and the alphabet: of each run of a character three at most stay.
_SQUEEZED = r"""WITH base AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), 'https?://[^\s\x{85}\p{Z}]+', ' ', 'g'), '') AS chars FROM documents),
c AS (SELECT doc_id, unnest(chars) AS ch, generate_subscripts(chars, 1) AS i FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
k AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ch, run ORDER BY i) AS place FROM r) WHERE place <= 3 GROUP BY doc_id),
f AS (SELECT d.doc_id, trim(regexp_replace(regexp_replace(coalesce(t, ''), '[^가-힣a-zA-Z0-9\s\x{85}\p{Z}.,!?%()~\-À-ÖØ-öø-ÿ]', ' ', 'g'), '[\s\x{85}\p{Z}]+', ' ', 'g')) AS t FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT doc_id, md5(t) AS clean_md5, length(t) AS clean_length FROM f"""


@register(_SQUEEZED)
def t1_squeezed(spark, d):
    c = X.clean_text(F.col("text"), X.LATIN)
    return _docs(spark, d).select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("clean_length"))


@register("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS stripped_md5 FROM pages")
def t2_strip_tags(spark, d):
    return T.read(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("stripped_md5"))


_FIRST = "lower(split_part(regexp_replace(text, '\n', ' ', 'g'), ' ', 1) || ' ' || split_part(regexp_replace(text, '\n', ' ', 'g'), ' ', 2))"


def _titles(spark, d):
    """The first two words of each text stand for a post's title."""
    words = F.split(F.regexp_replace("text", "\n", " "), " ")
    at = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    return _docs(spark, d).withColumn("title", F.lower(F.concat_ws(" ", at(1), at(2))))


_ANY = lambda words, c="title": "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_MARK = r"regexp_replace(title, '[\s()\[\]{}<>《》〈〉]', '', 'g') IN (" + ", ".join(f"'{m}'" for m in MARKERS) + ")"


@register(f"WITH t AS (SELECT *, {_FIRST} AS title FROM documents) SELECT doc_id, {_MARK} AS only_marker, {_ANY(SEVERE, 'lower(text)')} AS severe, length(title) <= 15 AND {_ANY(MILD)} AS short_mild, title = '' OR {_MARK} OR {_ANY(SEVERE)} OR (length(title) <= 15 AND {_ANY(MILD)}) AS low_signal FROM t")
def t3_t6_low_signal(spark, d):
    t = F.col("title")
    return _titles(spark, d).select(
        "doc_id", X.only_marker(t, MARKERS).alias("only_marker"), X.holds_any(F.lower("text"), SEVERE).alias("severe"), X.short_and_holds(t, MILD).alias("short_mild"),
        X.low_signal(t, MARKERS, SEVERE, MILD).alias("low_signal"))


@register(f"WITH t AS (SELECT *, {_FIRST} AS title FROM documents) SELECT doc_id FROM t WHERE length(title) >= 8")
def t7_minimum_length(spark, d):
    return _titles(spark, d).filter(F.length("title") >= 8).select("doc_id")


@register("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def t8_engagement(spark, d):
    return T.read(spark, d, "events").filter(F.get_json_object("props", "$.k").cast("long") >= 50).select("event_id")


@register(f"WITH t AS (SELECT doc_id, {_clean('text')} AS c FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS k FROM t) SELECT doc_id FROM r WHERE k = 1 AND length(c) > 0")
def t9_dedup_content(spark, d):
    """The key is a digest of the cleaned text: windows sort 32 bytes, not texts."""
    c = X.clean_text(F.col("text"), X.LATIN, squeeze=False)
    rows = _docs(spark, d).select("doc_id", F.sha2(c, 256).alias("key"), F.length(c).alias("n")).filter("n > 0")
    return posts.keep_first(rows, ["key"], ["doc_id"]).select("doc_id")


@register("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) SELECT event_id FROM r WHERE k = 1")
def t10_dedup_post_key(spark, d):
    rows = T.read(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return posts.keep_first(rows, ["user_id", "event_type", "hour"], ["ts", "event_id"]).select("event_id")


@register("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY text, role ORDER BY conv_id, turn) AS k FROM conversations) SELECT conv_id, turn FROM r WHERE k = 1")
def t11_dedup_turns(spark, d):
    rows = T.read(spark, d, "conversations").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    return posts.keep_first(rows, ["key", "role"], ["conv_id", "turn"]).select("conv_id", "turn")


_NAMES = [("apache", "A1"), ("gnu", "G1"), ("idiot", "I1"), ("password", "P1"), ("license", "L1")]


@register("WITH n(name, code) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NAMES) + ") SELECT doc_id, code FROM documents JOIN n ON contains(lower(substr(text, 1, 200)), name) OR contains(lower(text), name)")
def t13_route_entities(spark, d):
    names = spark.createDataFrame(_NAMES, "name string, code string")
    rows = _docs(spark, d).select("doc_id", F.lower(F.substring("text", 1, 200)).alias("headline"), F.lower("text").alias("body"))
    return matching.contains_join(rows, names, ["headline", "body"]).select("doc_id", "code")


@register("SELECT doc_id, md5(substr(coalesce(lang, '') || '. ' || coalesce(text, ''), 1, 500)) AS joined_md5, 'doc_' || doc_id AS item_id FROM documents")
def t14_t15_assemble(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.join_text(F.col("lang"), F.col("text"))).alias("joined_md5"), X.named_id("doc", F.col("doc_id")).alias("item_id"))


@register("""WITH u AS (SELECT 'doc_' || doc_id AS item_id, text, 0 AS prio FROM documents UNION ALL SELECT 'doc_' || conv_id, text, 1 FROM conversations WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY prio, text) AS k FROM u WHERE trim(text) <> '') SELECT item_id, prio, md5(text) AS text_md5 FROM r WHERE k = 1""")
def t16_union_sources(spark, d):
    a = _docs(spark, d).select(X.named_id("doc", F.col("doc_id")).alias("item_id"), "text", F.lit(0).alias("prio"))
    b = T.read(spark, d, "conversations").filter("role = 'user'").select(X.named_id("doc", F.col("conv_id")).alias("item_id"), "text", F.lit(1).alias("prio"))
    return posts.union_sources([a, b], ts="text").select("item_id", "prio", F.md5("text").alias("text_md5"))


_UP, _DOWN = ["the", "and", "of", "que", "der", "de"], ["idiot", "moron", "trash", "loser", "in", "en"]


@register(f"""WITH w AS (SELECT doc_id, list_transform(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: CASE WHEN w IN ({", ".join(f"'{w}'" for w in _UP)}) THEN 1 WHEN w IN ({", ".join(f"'{w}'" for w in _DOWN)}) THEN -1 ELSE 0 END) AS s FROM documents),
c AS (SELECT doc_id, len(list_filter(s, lambda x: x = 1)) AS u, len(list_filter(s, lambda x: x = -1)) AS v FROM w) SELECT doc_id, round(CASE WHEN u + v > 0 THEN (u - v) / (u + v) ELSE 0 END, 8) AS score FROM c""")
def t17_lexicon_score(spark, d):
    return rounded(_docs(spark, d).select("doc_id", X.lexicon_score(F.col("text"), _UP, _DOWN).alias("score")))


@register()
def t17_trained_score(spark, d):
    """Probability of quality = 1 by hashed words and logistic regression, trained on the labels table."""
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = docs.join(T.read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    from pyspark.ml.functions import vector_to_array

    return posts.fit_scorer(labelled).transform(docs).select("doc_id", F.round(vector_to_array("probability")[1], 4).alias("score"), F.col("prediction").cast("int").alias("predicted"))


def _uniform_model():
    import pandas as pd

    def model(texts):
        n = pd.Series([len(t) for t in texts], dtype="float64")
        return pd.DataFrame({"negative": 1 / (2 + n), "neutral": 1 / (2 + n), "positive": n / (2 + n)})

    return model


@register("SELECT doc_id, round((greatest(length(text), 1) - 1.0) / (2 + greatest(length(text), 1)), 8) AS sentiment_score FROM documents WHERE trim(text) <> ''")
def t17_batch_scorer(spark, d):
    """The batch interface with a model of text lengths in the place of a network."""
    rows = _docs(spark, d).filter(F.trim("text") != "").select("doc_id", "text")
    return rounded(posts.score_texts(rows, _uniform_model).select("doc_id", "sentiment_score"))


@register("SELECT source, lang, count(*) AS raw, count(*) FILTER (WHERE length(text) >= 200) AS long_enough, count(*) FILTER (WHERE length(text) >= 200 AND NOT contains(text, 'http')) AS without_links FROM documents GROUP BY ALL")
def t19_funnel(spark, d):
    return posts.funnel(_docs(spark, d), {"long_enough": F.length("text") >= 200, "without_links": ~F.contains("text", F.lit("http"))}, ["source", "lang"])


@register("SELECT user_id, event_id AS id, event_type AS kind, ts AS at FROM events")
def s8_json_pages(spark, d):
    """Events of a user and day as one JSON page of groups by type, taken apart again."""
    rows = T.read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at")).alias("item"))
    groups = rows.groupBy("user_id", "day", "event_type").agg(F.collect_list("item").alias("items"))
    pages = groups.groupBy("user_id", "day").agg(F.to_json(F.struct(F.collect_list(F.struct("items")).alias("groups")), {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("json")).drop("day")
    return P.groups_to_items(pages, "json", "id: bigint, kind: string, at: string").select("user_id", "id", "kind", F.col("at").cast("timestamp_ntz").alias("at"))


@register("SELECT event_id, 'c' || event_id AS comment_id, 'u' || user_id AS author, event_type AS message, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS is_holder, CAST(json_extract(props, '$.k') AS BIGINT) AS likes, event_id AS reads, 0 AS replies FROM events")
def s9_flatten_comments(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = T.read(spark, d, "events").select("event_id", F.to_json(F.struct(
        F.concat(F.lit("c"), "event_id").alias("commentId"), F.struct(F.concat(F.lit("u"), "user_id").alias("nickname")).alias("author"), F.col("event_type").alias("message"),
        F.when(k > 50, F.struct(F.lit("HOLDING").alias("shareHoldingStatus"))).alias("holding"), F.struct(k.alias("likeCount"), F.col("event_id").alias("readCount"), F.lit(0).alias("replyCount")).alias("statistic"),
    )).alias("json"))
    return P.flatten_comments(rows, "json")


@register("""SELECT event_id, CAST(event_id AS VARCHAR) AS nid, strftime(ts, '%Y.%m.%d %H:%M') AS date, CASE WHEN event_id % 3 = 0 THEN event_type || ' of ' || user_id ELSE event_type END AS title, CAST(value AS VARCHAR) AS views FROM events WHERE event_id % 7 <> 0""")
def s10_table_rows(spark, d):
    """Events of an hour as one list page, with rows that lack a cell, links in the first cell, and whole titles in the attribute of
    shortened links; the sound rows come back."""
    ok = F.col("event_id") % 7 != 0
    named = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(' title="'), F.col("event_type"), F.lit(" of "), F.col("user_id"), F.lit('"'))).otherwise("")
    cells = F.concat(F.lit('<tr><td><a href="/day?nid=0">'), F.date_format("ts", "yyyy.MM.dd HH:mm"), F.lit('</a></td><td class="t"><a href="/read.nhn?code=1&amp;nid='), F.col("event_id"), F.lit('&amp;page=1"'), named, F.lit("><b>"), F.col("event_type"), F.lit("</b></a></td><td>u"), F.col("user_id"),
                     F.lit("</td><td>"), F.col("value"), F.lit("</td><td>1</td>"), F.when(ok, F.lit("<td>0</td>")).otherwise(F.lit("")), F.lit("</tr>"))
    rows = T.read(spark, d, "events").select(F.date_trunc("hour", "ts").alias("h"), cells.alias("row"))
    pages = rows.groupBy("h").agg(F.concat(F.lit('<table class="type2">'), F.array_join(F.collect_list("row"), "\n"), F.lit("</table>")).alias("html")).drop("h")
    return P.table_rows(pages).select(F.col("nid").cast("long").alias("event_id"), "nid", "date", "title", "views")


@register("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 2)) AS label FROM pages)
SELECT page_id, href, regexp_replace(label, '<[^>]+>', '', 'g') AS label, count(*) AS n FROM l GROUP BY ALL""")
def s11_captures(spark, d):
    rows = P.captures(T.read(spark, d, "pages").select("page_id", "html"), r'<li><a href="([^"]*)">(.*?)</a></li>', ["href", "label"])
    return rows.groupBy("page_id", "href", "label").agg(F.count(F.lit(1)).alias("n"))


_TITLES, _PARAGRAPHS = r"(?s)<(?:title|h1|h2)[^>]*>(.*?)</(?:title|h1|h2)>", r"(?s)<p>(.*?)</p>"


@register(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '{_TITLES}', 1) AS h, regexp_extract_all(html, '{_PARAGRAPHS}', 1) AS b FROM pages),
x AS (SELECT page_id, h, b, unnest(range(1, len(h) + 1)) AS i FROM p) SELECT page_id, CAST(i - 1 AS INTEGER) AS place, md5(h[i]) AS headline_md5, md5(coalesce(b[i], '')) AS body_md5 FROM x""")
def s12_paired(spark, d):
    pages = T.read(spark, d, "pages").select("page_id", "html")
    rows = P.paired(pages, F.regexp_extract_all("html", F.lit(_TITLES), F.lit(1)), F.regexp_extract_all("html", F.lit(_PARAGRAPHS), F.lit(1)))
    return rows.select("page_id", "place", F.md5("headline").alias("headline_md5"), F.md5("body").alias("body_md5"))


@register("SELECT CASE WHEN len(regexp_extract_all(html, '<h2')) > 0 THEN 'ok' WHEN contains(html, 'class=\"ad\"') THEN 'end' ELSE 'blocked' END AS page_status, count(*) AS n FROM pages GROUP BY ALL")
def s13_page_health(spark, d):
    status = P.page_status(F.regexp_count("html", F.lit("<h2")), F.contains("html", F.lit('class="ad"')))
    return T.read(spark, d, "pages").groupBy(status.alias("page_status")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS parsed FROM events")
def s14_timestamps(spark, d):
    """Times written in five ways and read back."""
    t, n = F.col("ts"), F.col("event_id") % 5
    utc = F.unix_millis(t.cast("timestamp_ltz"))
    text = (F.when(n == 0, F.date_format(t, "yyyyMMddHHmm")).when(n == 1, F.date_format(t, "yyyy.MM.dd HH:mm")).when(n == 2, F.date_format(t, "yyyy.MM.dd"))
            .when(n == 3, F.concat(F.lit("Mon "), F.date_format(t, "MMM dd HH:mm:ss"), F.lit(" KST "), F.date_format(t, "yyyy"))).otherwise(F.concat(F.lit("/Date("), utc, F.lit(")/"))))
    return T.read(spark, d, "events").select("event_id", P.any_timestamp(text).alias("parsed"))


@register("SELECT event_id, date_trunc('day', ts) + INTERVAL 12 HOURS AS at FROM events")
def s15_noon(spark, d):
    return T.read(spark, d, "events").select("event_id", P.noon(F.to_date("ts")).alias("at"))


@register("""SELECT event_type AS instrument, 'value' AS target, metric, round(max(CASE WHEN model = 'early' THEN v END), 4) AS early, round(max(CASE WHEN model = 'late' THEN v END), 4) AS late FROM (
  SELECT event_type, CASE WHEN day(ts) <= 15 THEN 'early' ELSE 'late' END AS model, 'mean' AS metric, avg(value) AS v FROM events GROUP BY ALL UNION ALL
  SELECT event_type, CASE WHEN day(ts) <= 15 THEN 'early' ELSE 'late' END, 'max', max(value) FROM events GROUP BY ALL) GROUP BY ALL""")
def s21_metric_table(spark, d):
    model = F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late")
    wide = T.read(spark, d, "events").groupBy(F.col("event_type").alias("instrument"), model.alias("model")).agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    long = wide.select("instrument", F.lit("value").alias("target"), "model", F.expr("stack(2, 'mean', mean, 'max', max) AS (metric, value)"))
    return readers.metric_table(long, ["early", "late"])
