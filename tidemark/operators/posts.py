"""Posts: filters, dedup, sources, routing and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first in a total order. Null keys are a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def accumulate(old: DataFrame, new: DataFrame, key: list[str], ts: str = "ts") -> DataFrame:
    """Old and new rows, the old one where both have a key, then the earliest."""
    both = old.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, key, ["_prio", ts, *key]).drop("_prio")


def uncovered_days(posts: DataFrame, start: str, end: str, by: str = "instrument", ts: str = "ts") -> DataFrame:
    """Days from start to end on which an instrument has no posts."""
    days = posts.select(by).distinct().withColumn("date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return days.join(posts.select(by, F.to_date(ts).alias("date")).distinct(), [by, "date"], "left_anti")


def eligible(posts: DataFrame, pairs: DataFrame, columns: tuple[str, str] = ("source", "instrument")) -> DataFrame:
    """Posts whose source is listed for their instrument."""
    return posts.join(pairs, list(columns), "left_semi")


def union_sources(sources: list[DataFrame], key: str = "item_id", ts: str = "ts", text: str = "text") -> DataFrame:
    """Sources in their order; blank texts go, then repeated ids (the earlier source, then the earlier post stays)."""
    out = None
    for n, s in enumerate(sources):
        s = s.withColumn("_prio", F.lit(n))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return keep_first(out.filter(F.trim(text) != ""), [key], ["_prio", ts, text]).drop("_prio")


def score_texts(posts: DataFrame, score: Callable[[], Callable[[list[str]], pd.DataFrame]], text: str = "text", batch: int = 16, most_tokens: int | None = None) -> DataFrame:
    """Negative, neutral, positive and sentiment_score by a model that ``score()`` loads once in each task; blank texts are ".".

    The model gets lists of at most ``batch`` texts and gives a frame of three probabilities. A model with a limit (256 is usual) gets
    the first ``most_tokens`` words of each text; without a limit it gets whole texts.
    """
    names = ["negative", "neutral", "positive"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = score()
        for frame in frames:
            texts = [t if t and t.strip() else "." for t in frame[text]]
            if most_tokens is not None:
                texts = [" ".join(t.split(None, most_tokens)[:most_tokens]) for t in texts]
            parts = [model(texts[i : i + batch])[names] for i in range(0, len(texts), batch)]
            out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names, dtype=float)
            yield pd.concat([frame.reset_index(drop=True), out], axis=1)

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*posts.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return posts.mapInPandas(work, schema).withColumn("sentiment_score", F.col("positive") - F.col("negative"))


def fit_scorer(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14):
    """A Spark ML pipeline of hashed words and logistic regression, trained on a labels table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    hashed = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True)
    return Pipeline(stages=[words, hashed, LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01)]).fit(labelled)


def funnel(posts: DataFrame, stages: dict[str, Column], by: list[str]) -> DataFrame:
    """Rows left after each stage (stages apply one after another), by source and instrument, in one pass."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("raw")]
    for name, test in stages.items():
        passed = passed & test
        counts.append(F.count_if(passed).alias(name))
    return posts.groupBy(*by).agg(*counts)
