"""The trained scorer against a plain fit of the same objective."""

import random

import numpy as np
from pyspark.ml.functions import vector_to_array

from tidemark.operators import posts


def test_trained_scorer_equals_a_plain_fit(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    texts = [r.sample(words, r.randint(3, 12)) for _ in range(160)]
    labels = [float(sum(w in ("w1", "w2", "w3") for w in t) + r.random() > 1.2) for t in texts]
    rows = spark.createDataFrame([(" ".join(t), y) for t, y in zip(texts, labels)], "text string, label double")
    got = [x.p for x in posts.fit_scorer(rows).transform(rows).select(vector_to_array("probability")[1].alias("p")).collect()]
    # Mean log loss with a penalty of 0.01 / 2 on the weights of columns scaled to unit deviation, by Newton's method.
    x = np.array([[w in t for w in words] for t in texts], float)
    x = np.column_stack([np.ones(len(x)), x / x.std(axis=0, ddof=1)])
    y, w, ridge = np.array(labels), np.zeros(x.shape[1]), np.diag([0.0] + [0.01] * len(words))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
    assert np.abs(np.array(got) - 1 / (1 + np.exp(-x @ w))).max() < 0.02
