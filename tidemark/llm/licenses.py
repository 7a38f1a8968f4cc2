"""License scans by diagonal voting (DataFrame functions only).

Every rolling word k-gram of a text is hashed and joined to the k-gram positions of the license templates. A hit votes
for a diagonal, the word position of the text minus that of the template. Votes are aggregated by document, template and
diagonal as bit masks of template positions, neighbouring diagonals (inserted or dropped words) are merged, and the
merged spans are verified by their coverage of the template. Phrases count only where one diagonal holds every k-gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, text_or_empty

#: Phrase and label; a phrase counts where its words stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices in the words of the licenses' own recommended texts, at most 60 words each; they match with words missing or added.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("all rights reserved", "proprietary"),
)
K, COVERAGE, BAND = 2, 0.75, 3
_DOC = "#document"


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """label, template, exact, grams, at, gram: one row per k-gram position; as many rows as the templates have words."""
    rows = []
    for n, (text, label, exact) in enumerate([(*p, True) for p in phrases] + [(*x, False) for x in notices]):
        words = text.split(" ")
        if not k <= len(words) <= 60:
            raise ValueError(f"a template needs {k} to 60 words: {text!r}")
        rows += [(label, n, exact, len(words) - k + 1, i, words[i : i + k]) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "label string, template int, exact boolean, grams int, at int, gram array<string>")


def votes(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document version and template diagonal: n_words, mask of template positions, first and last word.

    A document version is an id and a hash of its text; one further row per version (template null) carries n_words and
    how many rows of docs it stands for (copies).
    The words stay in the row that they were split in: only hits leave the stage, combined before the shuffle.
    """
    text = text_or_empty(text_col)
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), F.filter(F.split(ascii_lower(text), NON_WORD), lambda w: w != "").alias("words"))
    # Position -1 stands for the document itself.
    each = words.select("*", F.explode_outer(F.sequence(F.lit(-1), F.greatest(F.size("words") - K, F.lit(-1)))).alias("i"))
    said = [F.when(F.col("i") < 0, _DOC).otherwise(F.try_element_at("words", F.col("i") + 1 + j)) for j in range(K)]
    each = each.select("doc_id", "version", F.size("words").alias("n_words"), "i", *[w.alias(f"w{j}") for j, w in enumerate(said)])
    each = each.withColumn("hash", F.xxhash64(*[f"w{j}" for j in range(K)]))
    grams = templates.unionByName(docs.sparkSession.createDataFrame([(None, None, None, None, 0, [_DOC] * K)], templates.schema))
    grams = grams.withColumn("hash", F.xxhash64(*[F.col("gram")[j] for j in range(K)]))
    hits = each.join(F.broadcast(grams), "hash")  # as large as the templates
    for j in range(K):
        hits = hits.filter(F.col(f"w{j}") == F.col("gram")[j])
    diagonal = F.when(F.col("template").isNotNull(), F.col("i") - F.col("at"))
    return hits.groupBy("doc_id", "version", "template", diagonal.alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.bit_or(F.when(F.col("template").isNotNull(), F.expr("shiftleft(1L, at)"))).alias("mask"),
        F.min("i").alias("first"), (F.max("i") + K).alias("end"), F.count_if(F.col("template").isNull()).alias("copies"),
    )


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; one row for each row of docs.

    Null text counts as empty (no words). Rows repeated with equal id and text are scanned as one and each get the result.
    Null ids are kept. An empty table gives an empty result. Columns other than doc_id and text are ignored. score is the
    largest coverage of a template (1 for a phrase), 0 without any hit; spans lists the verified merged spans as
    label:first:end in words. A diagonal that covers enough of its template by itself is a span of its own.
    """
    spark = docs.sparkSession
    found = votes(docs, template_grams(spark, phrases, notices))
    known = [(*p, True) for p in phrases] + [(*x, False) for x in notices]
    of = lambda k, values: F.element_at(F.array(*map(F.lit, values)), F.col(k) + 1)
    found = found.withColumns({"exact": of("template", [x for _, _, x in known]), "grams": of("template", [len(t.split(" ")) - K + 1 for t, _, _ in known])})
    full = F.bit_count("mask") == F.col("grams")
    places = F.col("exact") & full
    near = Window.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    alone = ~F.col("exact") & (F.bit_count("mask") / F.col("grams") >= coverage)
    apart = ((F.col("diagonal") - F.lag("diagonal").over(near) > band) | F.col("alone") | F.lag("alone").over(near)).cast("int")
    merged = (
        found.withColumn("alone", alone).withColumn("block", F.sum(F.coalesce(apart, F.lit(0))).over(near))
        .groupBy("doc_id", "version", "template", "block")
        .agg(
            F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("end").alias("end"),
            F.count_if(places).alias("n_base"), F.min(F.when(places, F.col("diagonal"))).alias("first_word"), F.max(F.when(places, F.col("diagonal"))).alias("last_word"),
        )
    )
    merged = merged.withColumns({"label": of("template", [x for _, x, _ in known]), "exact": of("template", [x for _, _, x in known]), "grams": of("template", [len(t.split(" ")) - K + 1 for t, _, _ in known])})
    share = F.bit_count("mask") / F.col("grams")
    notice = ~F.col("exact") & (share >= coverage) & (F.col("end") - F.col("first") <= 2 * (F.col("grams") + K - 1))
    base = F.col("n_base") > 0
    label = F.when(base | notice, F.col("label"))
    result = merged.groupBy("doc_id", "version").agg(
        F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("n_base"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.col("exact"), F.when(base, 1.0).otherwise(0.0)).otherwise(share)), F.lit(0.0)), 9).alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(notice, F.concat_ws(":", "label", F.col("first").cast("string"), F.col("end").cast("string"))))), ",").alias("spans"),
        F.max("copies").alias("copies"),
    )
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("version", "copies", "copy")


def _oracle() -> str:
    lines = ",\n  ".join(
        f"({n}, '{text}', '{label}', {exact})" for n, (text, label, exact) in enumerate([(*p, "true") for p in PHRASES] + [(*x, "false") for x in NOTICES])
    )
    return rf"""
WITH RECURSIVE t(template, said, label, exact) AS (VALUES
  {lines}),
tw AS (SELECT template, label, exact, string_split(said, ' ') AS ws FROM t),
tg AS (SELECT template, label, exact, len(ws) - 1 AS grams, unnest(range(0, len(ws) - 1)) AS pos, ws FROM tw),
g AS (SELECT template, label, exact, grams, pos, ws[pos + 1] || ' ' || ws[pos + 2] AS gram FROM tg),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 1)) AS i FROM d),
h AS (SELECT doc_id, template, label, exact, grams, pos, i, i - pos AS diagonal FROM p JOIN g ON g.gram = p.ws[p.i + 1] || ' ' || p.ws[p.i + 2]),
v AS (SELECT doc_id, template, label, exact, grams, diagonal, count(DISTINCT pos) AS n, min(i) AS a, max(i) + 2 AS e, list(DISTINCT pos) AS ats
      FROM h GROUP BY ALL),
u AS (SELECT *, NOT exact AND n / grams >= {COVERAGE} AS alone FROM v),
b AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x > {BAND} OR alone OR lag(alone) OVER x THEN 1 ELSE 0 END AS apart FROM u WINDOW x AS (PARTITION BY doc_id, template ORDER BY diagonal)),
k AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS block FROM b),
m AS (SELECT doc_id, template, label, exact, grams, block, len(list_distinct(flatten(list(ats)))) AS n, min(a) AS a, max(e) AS e,
        count(*) FILTER (WHERE exact AND n = grams) AS n_base,
        min(diagonal) FILTER (WHERE exact AND n = grams) AS f, max(diagonal) FILTER (WHERE exact AND n = grams) AS l
      FROM k GROUP BY ALL),
r AS (SELECT *, NOT exact AND n / grams >= {COVERAGE} AND e - a <= 2 * (grams + 1) AS notice FROM m),
o AS (SELECT doc_id, sum(n_base) AS n_base, min(f) AS first_word, max(l) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE n_base > 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE n_base > 0 OR notice) AS labels,
        max(CASE WHEN exact THEN CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END ELSE n / grams END) AS score,
        string_agg(DISTINCT label || ':' || a || ':' || e, ',' ORDER BY label || ':' || a || ':' || e) FILTER (WHERE notice) AS spans
      FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CAST(coalesce(score, 0) AS DOUBLE), 9) AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle()
