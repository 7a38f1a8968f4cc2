"""Runs of repeated words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and at least max(SHORTEST, TIMES * q) words that no
neighbouring word extends keeping the period.

Texts of a chunk stand behind each other in one array of word numbers, separated by numbers that occur once. A scale with
k-grams of K words serves the periods from the scale below up to K. Inside a run of such a period every k-gram occurs once
in each period (two nearer ones would give a smaller period), and as the run holds at least three periods, some window of
W k-grams lies in it together with its copy one period on. Both windows have the same least hashes, so these are minimizers
of the text, each the next occurrence of the other: pairs of consecutive equal minimizers at a distance of the scale's
periods seed every run, and comparing words from the seed outwards gives its ends. Equal minima of a window all count, so
that ties can't tell a window from its copy. Periods up to DIRECT, whose windows would be too short, are scanned at each lag.

Work is n log n in the words of a text; memory is some ten arrays of eight bytes a word of a chunk (CHUNK, or one text).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, TIMES = 24, 3
#: Periods that are scanned directly; TIMES periods of the next one are no shorter than SHORTEST.
DIRECT = SHORTEST // TIMES
#: Bytes of text that go through the passes together.
CHUNK = 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def scales(longest: int) -> list[tuple[int, int, int]]:
    """(below, K, W): the scale's k-grams have K words and its windows W k-grams; it serves periods above ``below`` up to K,
    until TIMES periods are longer than the longest text."""
    found, below = [], DIRECT
    while TIMES * (below + 1) <= longest:
        k = below + below // 2
        # A run of the least period q = below + 1 has TIMES * q words: a window, its copy q later, and K - 1 words more.
        found.append((below, k, (TIMES - 1) * (below + 1) - k + 1))
        below = k
    return found


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _P
    h += b
    h ^= h >> np.uint64(29)
    h *= _Q
    h ^= h >> np.uint64(32)
    return h


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best over each window of a width, by doubling."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of a window that holds them, equal ones too."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _sliding(np.minimum, hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), width) == hashes)


def _agree(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Start and end of the places around ``at`` where words ``lag`` apart are equal."""
    end, step = at, 64
    while True:
        b = words[end + lag : end + lag + step]
        off = np.flatnonzero(words[end : end + len(b)] != b)
        if len(off):
            end += int(off[0])
            break
        end += len(b)
        if len(b) < step:
            break
        step *= 2
    start, step = at, 64
    while start:
        low = max(start - step, 0)
        off = np.flatnonzero(words[low:start] != words[low + lag : start + lag])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start = low
        step *= 2
    return start, end


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def _smallest(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of the period is a period of words[start:end]; a smaller one would divide it, as TIMES >= 2."""
    return not any(np.array_equal(words[start : end - (g := period // r)], words[start + g : end]) for r in _primes(period))


def runs_of(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of texts, longest text first, each followed by a number that occurs
    once; ``ends``: the places of these numbers."""
    if not len(ends):
        return []
    lengths = np.diff(ends, prepend=-1) - 1
    found: list[tuple[int, int, int]] = []

    def keep(start: int, end: int, lag: int) -> None:
        if end + lag - start >= max(SHORTEST, TIMES * lag) and _smallest(words, start, end + lag, lag):
            found.append((start, end + lag - start, lag))

    def active(least: int) -> np.ndarray:
        """The words of all texts of at least so many."""
        n = int(np.searchsorted(-lengths, -least, side="right"))
        return words[: int(ends[n - 1]) + 1] if n else words[:0]

    part = active(SHORTEST)
    for lag in range(1, DIRECT + 1):
        if len(part) > lag:
            other = np.concatenate([[-1], np.flatnonzero(part[lag:] != part[:-lag]), [len(part) - lag]])
            for i in np.flatnonzero(np.diff(other) > SHORTEST - lag).tolist():
                keep(int(other[i]) + 1, int(other[i + 1]), lag)
    grams, width = _mixed(part.view(np.uint64), np.uint64(1)), 1
    for below, k, window in scales(int(lengths[0])):
        part = active(TIMES * (below + 1))
        if len(part) < k + window:
            break
        grams = grams[: len(part) - width + 1]
        while 2 * width <= k:
            grams, width = _mixed(grams[:-width], grams[width:]), 2 * width
        last = len(part) - k + 1
        hashes = _mixed(grams[:last], grams[k - width : k - width + last])
        at = minimizers(hashes, window)
        at = at[np.argsort(hashes[at], kind="stable")]
        gap = np.diff(at)
        pair = np.flatnonzero((gap > below) & (gap <= k) & (hashes[at[1:]] == hashes[at[:-1]]))
        lag, first = gap[pair], at[pair]
        order = np.lexsort((first, lag))
        done = (0, 0)
        for d, m in zip(lag[order].tolist(), first[order].tolist()):
            if done[0] == d and m < done[1]:
                continue
            start, end = _agree(words, m, d)
            done = (d, end)
            keep(start, end, d)
    return found


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK bytes, or one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > CHUNK:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def _describe(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    counts = np.concatenate([[0], np.cumsum(real)])[np.asarray(split.offsets) - split.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    codes, starts, lengths = np.asarray(coded.indices).astype(np.int64), counts[:-1], np.diff(counts)
    order = np.argsort(-lengths, kind="stable")
    n = len(order)
    words, ends = np.empty(len(codes) + n, np.int64), np.cumsum(lengths[order] + 1) - 1
    words[ends] = -1 - np.arange(n)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = codes[np.repeat(starts[order] - (np.cumsum(lengths[order]) - lengths[order]), lengths[order]) + np.arange(len(codes))]
    runs: list[list[dict]] = [[] for _ in range(n)]
    dropped = np.zeros(len(codes), bool)
    edges = ends.tolist()
    for start, length, period in runs_of(words, ends):
        at = bisect_right(edges, start)
        row, own = int(order[at]), start - (edges[at - 1] + 1 if at else 0)
        runs[row].append({"start": own, "length": length, "period": period})
        dropped[starts[row] + own + period : starts[row] + own + length] = True
    for r in runs:
        r.sort(key=lambda x: (x["start"], x["period"]))
    kept = np.concatenate([[0], np.cumsum(~dropped)])[counts]
    left = coded.dictionary.take(pa.array(codes[~dropped])) if len(codes) else pa.array([], pa.string())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), left), " ")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), pa.array(runs, kind), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for a, b in _chunks(np.asarray(pc.fill_null(pc.binary_length(texts), 0))):
            yield _describe(batch.column(0).slice(a, b - a), texts.slice(a, b - a))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period; words from 0) and collapsed, the words that
    no run drops joined by one space; a run drops what it contains after its first period. One row for each input row.

    Words are what [\\x20\\x09-\\x0D] separates, as written. Null and empty texts and texts without words have no runs and an
    empty collapsed text. Repeated rows and null ids appear like others. An empty table gives an empty result; other
    columns are ignored, whatever their names. Texts of any length are searched whole, in one task each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def repeated(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat from one place on, for a tenth of the ids: with h = crc32 of the decimal id and
    g = floor(h / 10), where h % 10 = 0, word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    Texts without words and those of null ids stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # One transform over an array of one binds the words, so that they are split once.
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(text))
    return F.when(h % 10 == 0, F.get(planted, F.lit(0))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period, and SHA-256 of all runs and of the collapsed text, from find_runs()."""
    none = F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)")
    # Runs stand by start, then period, so the first of equals stays; products compare the fractions exactly.
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The digests of the runs of ``docs`` after repeated(); see find_runs() for hard rows."""
    rows = docs.select("doc_id", repeated(F.col("text").cast("string"), F.col("doc_id")).alias("text"))
    return digests(find_runs(rows))
