"""Toxic spans with a linear-chain conditional random field.

The field has two states, clean and toxic, over the tokens of a text (what white space separates). Token labels for
training come from the document labels: in texts marked toxic, the tokens with a feature that stands almost only in such
texts. A token's features are hashed: its words, their prefixes of 4 to 6 letters, and the words of both neighbours.
Forward-backward marginals give each token's probability; their largest and their sum, calibrated on the same training
rows, give the score of the whole text, and tokens of at least 0.5 its offending offsets.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each label) and runs as one task; scoring is a map over
all texts. Sums along a text are taken in blocks, so that long texts cost what their length costs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, sampled, training_row
from .shingles import shingle_hashes

#: Most labelled rows that training takes of either label.
SAMPLE = {0: 2000, 1: 1000}
DIMS, BLOCK, EPOCHS = 1 << 17, 32, 5
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\S+")


def own_features(token: str) -> list[str]:
    """Words of a token in lower case, and their prefixes of 4 to 6 letters."""
    found = []
    for w in _WORD.findall(token.lower()):
        found.append(f"w{w}")
        found += [f"p{w[:k]}" for k in (4, 5, 6) if len(w) >= k]
    return found


def _slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % DIMS


def slots(token: str) -> tuple[list[int], int, int]:
    """Slots of the own features, and the slots that the token is for the token after and before it."""
    own = own_features(token)
    word = own[0] if own else "w"
    return [_slot(f) for f in own], _slot(f"<{word}"), _slot(f">{word}")


class Scores(dict):
    """Row numbers by token, kept between texts; row i of own, before and after has the token's weights. Bounded by bytes between groups of texts."""

    def __init__(self, weights: np.ndarray, most: int = CACHE_BYTES):
        super().__init__()
        self.weights, self.most, self.held = weights.tolist(), most, 0
        self.own, self.before, self.after = (np.zeros(1 << 16) for _ in range(3))

    def __missing__(self, token: str) -> int:
        row = len(self)
        if row >= len(self.own):
            self.own, self.before, self.after = (np.concatenate([x, np.zeros_like(x)]) for x in (self.own, self.before, self.after))
        own, before, after = slots(token)
        w = self.weights
        self.own[row], self.before[row], self.after[row] = sum([w[i] for i in own]), w[before], w[after]
        self[token] = row
        self.held += 224 + 4 * len(token)
        return row

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


def chain(emit: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state for the tokens of several texts, and the expected number of each move (2x2).

    emit: log-odds of each token; weights: 2x2 transition weights. Messages are odds of toxic against clean, so a token maps
    them by a fraction of linear forms. The products of these 2x2 forms are taken for all blocks at once, carried along each
    text, and the messages inside the blocks follow.
    """
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(len(emit)) + np.repeat(first * BLOCK - start, lengths)
    odds, real = np.zeros(total * BLOCK), np.zeros(total * BLOCK, bool)
    odds[at], real[at] = np.exp(np.clip(emit, -30, 30)), True
    odds, real = np.ascontiguousarray(odds.reshape(total, BLOCK).T), np.ascontiguousarray(real.reshape(total, BLOCK).T)
    (a, b), (c, d) = np.exp(weights - weights.max())
    heads = first[lengths > 0]
    # Forms of whole blocks: forward odds r -> (x + y r) / (u + v r), of all tokens but the first of a text.
    u, y, x, v = np.ones(total), np.ones(total), np.zeros(total), np.zeros(total)
    for t in range(BLOCK):
        o = odds[t]
        x, y, u, v = o * (b * u + d * x), o * (b * v + d * y), a * u + c * x, a * v + c * y
        scale = 1 / (u + v + x + y)
        x, y, u, v = x * scale, y * scale, u * scale, v * scale
    into, back = np.ones(total), np.ones(total)
    # A text starts with equal odds that no transition has touched: the first token's message is its own odds.
    into[heads] = np.nan
    inner = np.zeros(total)
    if len(heads):
        own = odds[:, heads]
        r = own[0]
        for t in range(1, BLOCK):
            r = own[t] * (b + d * r) / (a + c * r)
        inner[heads] = r
    for k in range(1, int(blocks.max(initial=0))):
        own = first[blocks > k] + k
        into[own] = inner[own - 1] if k == 1 else (x[own - 1] + y[own - 1] * into[own - 1]) / (u[own - 1] + v[own - 1] * into[own - 1])
    # Backward forms q -> (e + f q) / (g + h q) over the real tokens of each block, seen from the token before it.
    e, f, g, h = np.zeros(total), np.ones(total), np.ones(total), np.zeros(total)
    for t in range(BLOCK):
        o, m = odds[t], real[t]
        ne, nf, ng, nh = e * a + f * c, (e * b + f * d) * o, g * a + h * c, (g * b + h * d) * o
        scale = 1 / (ne + nf + ng + nh)
        e, f, g, h = (np.where(m, n * scale, old) for n, old in ((ne, e), (nf, f), (ng, g), (nh, h)))
    for k in range(1, int(blocks.max(initial=0))):
        own = (first + blocks - 1 - k)[blocks > k]
        back[own] = (e[own + 1] + f[own + 1] * back[own + 1]) / (g[own + 1] + h[own + 1] * back[own + 1])
    forward, r = np.empty((BLOCK, total)), into
    starts = np.isnan(into)
    for t in range(BLOCK):
        r = odds[t] * (b + d * r) / (a + c * r)
        if t == 0:
            r = np.where(starts, odds[0], r)
        forward[t] = r
    marginal, moves, q = np.empty((BLOCK, total)), np.zeros((2, 2)), back
    for t in range(BLOCK - 1, -1, -1):
        both = forward[t] * q
        marginal[t] = both / (1 + both)
        r = forward[t - 1] if t else into
        m = real[t] & ~starts if t == 0 else real[t]
        r, w = np.where(m, r, 1), odds[t] * q
        parts = (a, b * w, c * r, d * r * w)
        inv = m / (parts[0] + parts[1] + parts[2] + parts[3])
        moves += np.array([(z * inv).sum() for z in parts]).reshape(2, 2)
        q = np.where(real[t], (c + d * w) / (a + b * w), 1.0)
    return marginal.T.reshape(-1)[at], moves


def neighbours(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the tokens before and after, -1 at the ends of texts."""
    ends = np.cumsum(lengths)
    before, after = np.concatenate([[-1], x[:-1]]), np.concatenate([x[1:], [-1]])
    before[(ends - lengths)[lengths > 0]] = -1
    after[ends[lengths > 0] - 1] = -1
    return before, after


def _distinct(texts: list[str], marks: list[int]) -> list[int]:
    """Indexes without copies and near copies: texts that share one of three least shingle hashes with an earlier text of the label."""
    seen, kept = set(), []
    for i, t in enumerate(texts):
        h = shingle_hashes(t)
        if not len(h):
            continue
        keys = {(marks[i], k, int((h * np.uint64(f)).min())) for k, f in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def telling(tokens: list[list[str]], marks: list[int]) -> set[str]:
    """Own features that stand almost only in toxic texts: precision 0.9 or more, and a log-likelihood ratio of 30 or more."""
    count = {0: Counter(), 1: Counter()}
    for words, mark in zip(tokens, marks):
        count[mark].update({f for w in set(words) for f in own_features(w)})
    n1, n0 = marks.count(1), marks.count(0)
    found = set()
    for f, t in count[1].items():
        c = count[0][f]
        share = (t + c) / (n1 + n0)
        ratio = 2 * sum(o * np.log(o / e) for o, e in ((t, n1 * share), (c, n0 * share), (n1 - t, n1 * (1 - share)), (n0 - c, n0 * (1 - share))) if o > 0)
        if t * max(n0, 1) >= 9 * c * max(n1, 1) and t / max(n1, 1) > c / max(n0, 1) and ratio >= 30 and t >= 0.02 * n1:
            found.add(f)
    return found


def train(texts: list[str], marks: list[int], seed: int = 7) -> dict:
    """Weights (DIMS), bias, transitions (2x2) and the calibration (3) from labelled texts."""
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, marks = [texts[i] or "" for i in order], [int(marks[i]) for i in order]
    tokens = [t.split() for t in texts]
    own = _distinct(texts, marks)
    words = telling([tokens[i] for i in own], [marks[i] for i in own])
    weights, bias, moves = np.zeros(DIMS), -3.0, np.array([[0.5, -0.5], [0.5, -0.5]])
    squares, bias_square, move_square = np.full(DIMS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    sequences = [i for i in own if tokens[i]]
    distinct = {t: n for n, t in enumerate(sorted({t for i in sequences for t in tokens[i]}))}
    toxic_token = np.array([bool(words.intersection(own_features(t))) for t in distinct], float)
    of = [slots(t) for t in distinct]
    sizes = np.array([len(s) for s, _, _ in of], np.int64)
    starts, table = np.cumsum(sizes) - sizes, np.array([x for s, _, _ in of for x in s], np.int64)
    as_before, as_after = (np.array([s[k] for s in of], np.int64) for k in (1, 2))
    coded = {i: np.fromiter(map(distinct.__getitem__, tokens[i]), np.int64, len(tokens[i])) for i in sequences}
    for _ in range(EPOCHS if words else 0):
        for at in range(0, len(sequences), 50):
            group = sequences[at : at + 50]
            lengths = np.array([len(tokens[i]) for i in group])
            x = np.concatenate([coded[i] for i in group])
            y = toxic_token[x] * np.repeat([marks[i] for i in group], lengths)
            before, after = neighbours(x, lengths)
            n = sizes[x]
            own_slots = table[np.repeat(starts[x], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            flat = np.concatenate([own_slots, as_before[before[before >= 0]], as_after[after[after >= 0]]])
            rows = np.concatenate([np.repeat(np.arange(len(x)), n), np.flatnonzero(before >= 0), np.flatnonzero(after >= 0)])
            emit = bias + np.bincount(rows, weights[flat], len(x))
            p, expected = chain(emit, lengths, moves)
            slope = np.bincount(flat, (p - y)[rows], DIMS) / len(group) + 1e-4 * weights
            old, new = y[:-1].astype(int), y[1:].astype(int)
            inner = np.ones(len(old), bool)
            inner[np.cumsum(lengths)[:-1] - 1] = False
            seen = np.bincount(old[inner] * 2 + new[inner], minlength=4).reshape(2, 2)
            for g, w, s in ((slope, weights, squares), ((expected - seen) / len(group) + 1e-3 * moves, moves, move_square)):
                s += g * g
                w -= 0.5 * g / np.sqrt(s)
            g = (p - y).sum() / len(group)
            bias_square += g * g
            bias -= 0.3 * g / np.sqrt(bias_square)
    model = {"weights": weights.astype(np.float32), "bias": float(bias), "moves": moves, "calibration": np.array([-1.0, 0.0, 0.0])}
    facts = np.array([summary for summary, _ in _read(texts, model)] or np.zeros((0, 2)))
    fits = np.column_stack([np.ones(len(facts)), facts]) if len(facts) else np.zeros((0, 3))
    y, c = np.array(marks, float), np.zeros(3)
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(fits @ c, -30, 30)))
        pull = 0.05 * np.array([0.01, 1, 1])
        c -= np.linalg.solve(fits.T @ (fits * (p * (1 - p))[:, None]) + np.diag(pull), fits.T @ (p - y) + pull * c)
    return model | {"calibration": c}


def _read(texts: list[str | None], model: dict, scores: Scores | None = None) -> Iterator[tuple[tuple[float, float], list]]:
    """For each text the log-odds of its likeliest token and log(1 + expected toxic tokens); and the spans (start, end, probability)."""
    scores = Scores(model["weights"]) if scores is None else scores
    at = 0
    while at < len(texts):
        rows, lengths = [], []
        while at < len(texts) and sum(lengths) < 200_000:  # tokens at once, or one longer text
            tokens = (texts[at] or "").split()
            rows.append(np.fromiter(map(scores.__getitem__, tokens), np.int64, len(tokens)))
            lengths.append(len(tokens))
            at += 1
        x, lengths = np.concatenate(rows), np.array(lengths)
        p = np.zeros(0)
        if len(x):
            before, after = neighbours(x, lengths)
            emit = model["bias"] + scores.own[x] + np.where(before >= 0, scores.before[before], 0) + np.where(after >= 0, scores.after[after], 0)
            p, _ = chain(emit, lengths, model["moves"])
        scores.trim()
        ends = np.cumsum(lengths)
        for k, n in enumerate(lengths):
            if not n:
                yield (-12.0, 0.0), []
                continue
            own = p[ends[k] - n : ends[k]]
            most, spans = own.max(), []
            if most >= 0.5:
                found = list(_TOKEN.finditer(texts[at - len(lengths) + k]))
                spans = [(found[i].start(), found[i].end(), round(float(own[i]), 6)) for i in np.flatnonzero(own >= 0.5)]
            top = min(max(most, 6e-6), 1 - 6e-6)
            yield (float(np.log(top / (1 - top))), float(np.log1p(own.sum()))), spans


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on the sample in one task (its size is bounded by SAMPLE); the model comes back as about 1 MB."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["place"], r["mark"]))
        m = train([r["text"] for r in rows], [r["mark"] for r in rows])
        parts = [m["weights"].tobytes(), np.array([m["bias"], *m["moves"].ravel(), *m["calibration"]]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["weights", "rest"])

    row = sampled(docs, labels, "toxic", SAMPLE).repartition(1).mapInArrow(work, "weights binary, rest binary").first()
    if row is None:  # Spark runs no task where there are no training rows
        return train([], [])
    rest = np.frombuffer(bytes(row.rest))
    return {"weights": np.frombuffer(bytes(row.weights), np.float32), "bias": rest[0], "moves": rest[1:5].reshape(2, 2), "calibration": rest[5:8]}


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row.

    Null and empty texts score as a text without tokens. Repeated rows are all scored, null ids too (held_out is null).
    An empty table gives an empty result. Columns other than doc_id and text are ignored. spans: start, end (code points,
    exclusive) and probability of tokens that are toxic with 0.5 or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        c, known = m["calibration"], Scores(m["weights"])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores, spans = [], []
                for facts, found in _read(part.column(1).to_pylist(), m, known):
                    scores.append(float(1 / (1 + np.exp(-np.clip(c @ [1, *facts], -30, 30)))))
                    spans.append([{"start": a, "end": b, "probability": p} for a, b, p in found])
                spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), spans], names=["doc_id", "score", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(work, f"doc_id {kind.simpleString()}, score double, spans array<struct<start:int,end:int,probability:double>>")
    return scored.select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; order and repeats stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        c, known = m["calibration"], Scores(m["weights"])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                odds = np.array([c @ [1, *facts] for facts, _ in _read(part.column(text).to_pylist(), m, known)])
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))) < threshold))

    return docs.mapInArrow(work, docs.schema)
