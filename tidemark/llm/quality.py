"""Quality grades by ordinal cumulative-link regression.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade > k) = logistic(w.x - threshold k). Features are the tokens' words and shapes (case, digits, punctuation around
them), by share of the text, and the share of the commonest token, repeated lines and the length, in steps. Expected grade
and tail probability follow for every text.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each grade) and runs as one task; scoring is a map.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, KEPT_LENGTH, sampled, training_row

SAMPLE_ROWS, DIMS, EPOCHS = 1500, 1 << 16, 60
_WORD = re.compile(r"[^\W_]+")


def slots(token: str) -> tuple[int, int]:
    """Slots of a token's lower-case words and of its shape: letters as A or a, digits as 0, runs as one; other characters stay."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token))
    return xxhash.xxh32_intdigest("w" + " ".join(_WORD.findall(token.lower()))) % DIMS, xxhash.xxh32_intdigest("s" + shape) % DIMS


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


class Reader(dict):
    """Slots by token of up to KEPT_LENGTH characters, kept between texts up to CACHE_BYTES."""

    held = 0

    def __missing__(self, token: str) -> tuple[int, int]:
        found = slots(token)
        if len(token) <= KEPT_LENGTH:
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[token] = found
            self.held += 320 + 4 * len(token)
        return found

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of a text: square roots of shares, and four facts about the whole."""
        text = text or ""
        tokens = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        n = max(len(tokens), 1)
        counts = Counter(tokens)
        top = max(counts.values(), default=0) / n
        facts = (
            f"length{_step(len(tokens), (1, 5, 10, 20, 50, 100, 200, 500, 1000, 5000))}", f"top{_step(top, (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8))}",
            f"distinct{_step(len(counts) / n, (0.05, 0.1, 0.2, 0.4, 0.6, 0.8))}", f"lines{_step(len(set(lines)) / max(len(lines), 1), (0.1, 0.3, 0.5, 0.7, 0.9, 1))}",
        )
        pairs = np.array([(*self[t], c) for t, c in counts.items()], np.int64).reshape(-1, 3)
        where = np.concatenate([pairs[:, 0], pairs[:, 1]])
        share = np.concatenate([pairs[:, 2], pairs[:, 2]]) / n
        where, place = np.unique(where, return_inverse=True)
        value = np.sqrt(np.bincount(place, share, len(where)))
        return np.concatenate([where, [xxhash.xxh32_intdigest(f) % DIMS for f in facts]]), np.concatenate([value, np.full(4, 0.5)])


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold, by row."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None], -30, 30)))


def slopes(score: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row the probability of its grade and the slope of -log of it by the score; and the slope of their sum by each threshold."""
    rows, n = np.arange(len(score)), len(thresholds) + 1
    over = np.concatenate([np.ones((len(score), 1)), tails(score, thresholds), np.zeros((len(score), 1))], axis=1)
    upper, lower = over[rows, grades], over[rows, grades + 1]
    likely = np.maximum(upper - lower, 1e-9)
    d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
    return likely, d_lower - d_upper, np.bincount(grades, d_upper, n)[1:] - np.bincount(grades, d_lower, n)[:-1]


def train(texts: list[str], grades: list[int], n_grades: int) -> dict:
    """Weights and ordered thresholds by gradient steps on the likelihood of the grades; gaps between thresholds stay positive."""
    reader = Reader()
    rows = [reader.features(t) for t in texts]
    y = np.array(grades)
    size = np.array([len(a) for a, _ in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    where, value = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in (0, 1))
    where = where.astype(np.int64)
    weights, squares = np.zeros(DIMS), np.full(DIMS, 1e-6)
    raw, raw_squares = np.zeros(n_grades - 1), np.full(n_grades - 1, 1e-6)  # first threshold, then logs of gaps
    for _ in range(EPOCHS if len(rows) else 0):
        gaps = np.exp(raw[1:])
        thresholds = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(owner, value * weights[where], len(rows))
        _, pull, by_threshold = (x / len(s) for x in slopes(s, y, thresholds))
        slope = np.bincount(where, value * pull[owner], DIMS) + 1e-5 * weights
        squares += slope * slope
        weights -= 0.4 * slope / np.sqrt(squares)
        by_raw = np.concatenate([[by_threshold.sum()], np.cumsum(by_threshold[::-1])[::-1][1:] * gaps])
        raw_squares += by_raw * by_raw
        raw = raw - 0.2 * by_raw / np.sqrt(raw_squares)
    return {"weights": weights, "thresholds": raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])}


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, sample: int = SAMPLE_ROWS) -> dict:
    """Train on at most ``sample`` rows of each grade 0 to n_grades-1, held-out ids excepted; one task, one small model."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["place"], r["mark"]))
        m = train([r["text"] for r in rows], [r["mark"] for r in rows], n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([m[k].tobytes()], pa.binary()) for k in ("weights", "thresholds")], names=["weights", "thresholds"])

    graded = labels.select("doc_id", grade.cast("int").alias("grade"))
    rows = sampled(docs, graded, "grade", dict.fromkeys(range(n_grades), sample))
    row = rows.repartition(1).mapInArrow(work, "weights binary, thresholds binary").first()
    if row is None:  # Spark runs no task where there are no training rows
        return train([], [], n_grades)
    return {k: np.frombuffer(bytes(row[k])) for k in ("weights", "thresholds")}


def score(docs: DataFrame, model: dict, least: int = 1, keep: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of grade >= least), predicted_grade, kept (tail >= keep) for every row.

    Null and empty texts have the facts of an empty text. Repeated rows and null ids are scored like others. An empty
    table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = shared.value, Reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                s = np.array([v @ m["weights"][w] for w, v in map(reader.features, part.column(1).to_pylist())])
                over = tails(s, m["thresholds"])
                each = np.column_stack([1 - over[:, 0], *(over[:, k] - over[:, k + 1] for k in range(over.shape[1] - 1)), over[:, -1]])
                columns = [pa.array(over.sum(axis=1)), pa.array(over[:, least - 1]), pa.array(each.argmax(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "expected_grade", "tail_probability", "predicted_grade"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(work, f"doc_id {kind.simpleString()}, expected_grade double, tail_probability double, predicted_grade int")
    return scored.select("doc_id", (~training_row()).alias("held_out"), "expected_grade", "tail_probability", "predicted_grade", (F.col("tail_probability") >= keep).alias("kept"))


#: Grades of the labels table: 0 low quality, 1 good but toxic, 2 good.
GRADE, GRADES = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END", 3
