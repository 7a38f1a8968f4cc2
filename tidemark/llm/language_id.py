"""Language identification by words first, backing off to ever shorter character n-grams for unseen words.

A known word counts with its log frequency in each language. A word that no training text holds counts with the mean log
frequency of its longest n-grams (LONGEST characters, the word's ends marked) of which one at least is known, else of the
next shorter ones, down to single characters; if none is known either, it says nothing. The language with the greatest sum
over a text's words is predicted; the score is its share when the mean of the words is taken as EVIDENCE words at most.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

#: The model is fitted on about so many training rows of each language, drawn by a hash of id and text (all, where there are fewer).
SAMPLE_ROWS = 800
#: Words and n-grams of a model, shared equally by its languages (and n): what bounds its broadcast. Rarer ones are unseen.
MODEL_WORDS, MODEL_GRAMS = 200_000, 400_000
LONGEST = 5
SMOOTHING = 0.5
EVIDENCE = 12
#: Bytes of words kept with their scores between texts, and the length up to which words are kept.
CACHE_BYTES, CACHED_WORD = 32_000_000, 64
_LETTER = r"[^\W\d_]"
#: Combining marks that letters carry: fixed values (the Unicode blocks of combining marks, and the scripts between U+0900 and
#: U+109F, whose vowel signs are marks).
_MARK = "[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u109f\u1ab0-\u1aff\u20d0-\u20ff]"
#: Runs of letters and their marks; an apostrophe between letters is part of a word.
WORD = re.compile(f"{_LETTER}+(?:(?:{_MARK}|['\u2019](?={_LETTER})){_LETTER}*)*")
_SHARES = 1 << 30


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counted(found: dict, width: int, names: list[str]) -> pa.RecordBatch:
    keys = list(found)
    kinds = {"size": pa.int32()}
    columns = [pa.array([k[i] for k in keys], kinds.get(names[i], pa.string())) for i in range(width)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], names=[*names, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs in each language, summed up where rows stand until they are many."""
    found: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(words_of(text or "")).items():
                found[lang, word] += n
            if len(found) > 200_000:
                yield _counted(found, 2, ["lang", "word"])
                found.clear()
    yield _counted(found, 2, ["lang", "word"])


def grams(word: str, size: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: defaultdict = defaultdict(Counter)
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for size in range(1, LONGEST + 1):
                own = found[lang, size]
                for gram in grams(word, size):
                    own[gram] += n
        yield _counted({(*k, gram): n for k, own in found.items() for gram, n in own.items()}, 3, ["lang", "size", "gram"])


class Model:
    """Log frequencies of words and n-grams: one row each, one column for each language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], sizes: list[dict[str, np.ndarray]]):
        self.langs = langs
        self.words, self.word_rows = self._table(words)
        self.grams = [self._table(g) for g in sizes]

    @staticmethod
    def _table(counts: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        if not counts:
            return {}, np.zeros((0, 0))
        n = np.array(list(counts.values()), float)
        return {k: i for i, k in enumerate(counts)}, np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * len(n)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """Rows of words that no training text holds."""
        out = np.zeros((len(words), len(self.langs)))
        left = range(len(words))
        for size in range(LONGEST, 0, -1):
            index, rows = self.grams[size - 1]
            flat, starts, done, later = [], [], [], []
            for i in left:
                known = [index[g] for g in grams(words[i], size) if g in index]
                if known:
                    starts.append(len(flat))
                    flat += known
                    done.append(i)
                else:
                    later.append(i)
            if done:
                out[done] = np.add.reduceat(rows[flat], starts) / np.diff([*starts, len(flat)])[:, None]
            left = later
        return out


class Scorer(dict):
    """Places of words in a table of their scores, kept between texts up to CACHE_BYTES."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.fixed, self.held = model, len(model.words), 0
        self.rows = model.word_rows if self.fixed else np.zeros((0, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        """Add unseen words; those kept so far go when they are many (a pure cache)."""
        if self.held > CACHE_BYTES:
            self.clear()
            self.update(self.model.words)
            self.rows, self.held = self.rows[: self.fixed], 0
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.rows = np.concatenate([self.rows, self.model.unseen(words)])
        self.held += sum(150 + 4 * len(w) + 8 * self.rows.shape[1] for w in words)


def identify(scorer: Scorer, texts: list[str | None]) -> list[tuple[str, float]]:
    """Predicted language and score of each text; ``und`` and 0 for null, texts without a letter, and models without languages.

    Words longer than CACHED_WORD aren't kept between texts."""
    langs, own = scorer.model.langs, scorer.model.words
    split = [words_of(t) if t and langs and has_letter(t) else [] for t in texts]
    # The cache may be emptied by learn(), so all words of the texts are asked for at once.
    if scorer.held > CACHE_BYTES:
        scorer.learn([])
    scorer.learn([w for w in set().union(*split) - scorer.keys() if len(w) <= CACHED_WORD])
    found = []
    for words in split:
        if not words:
            found.append(("und", 0.0))
            continue
        places = np.fromiter((p for p in map(scorer.get, words) if p is not None), np.int64)
        total = scorer.rows[places].sum(axis=0)
        if len(places) < len(words):
            total = total + scorer.model.unseen([w for w in words if len(w) > CACHED_WORD and w not in own]).sum(axis=0)
        best = int(total.argmax())
        scaled = (total - total[best]) * (min(len(words), EVIDENCE) / len(words))
        found.append((langs[best], float(1 / np.exp(scaled).sum())))
    return found


def training(id_col: str = "doc_id") -> Column:
    """True for the rows whose language may be learnt: crc32 of the id as text, modulo 4, is not 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def _share() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SHARES))


def fit(docs: DataFrame) -> Model:
    """A model of the training rows of ``docs`` (doc_id, text, lang); rows of null language or text teach nothing.

    The number of rows of each language, and then at most MODEL_WORDS words and MODEL_GRAMS n-grams, come to the driver."""
    rows = docs.filter(training() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()}
    langs = sorted(counts)
    if not langs:
        return Model([], {}, [{} for _ in range(LONGEST)])
    limit = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(_SHARES, SAMPLE_ROWS * _SHARES // counts[lang])))])
    sample = rows.filter(_share() < limit[F.col("lang")]).select("lang", "text")
    words = settle(sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pieces = settle(words.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(_count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")
    place = {lang: i for i, lang in enumerate(langs)}

    def table(best: DataFrame, key: str) -> dict:
        """Counts by key; languages in which a key isn't among the most frequent count it too."""
        out: dict = {}
        for row in best.toArrow().to_pylist():
            out[row[key]] = n = np.zeros(len(langs))
            for x in row["of"]:
                n[place[x["lang"]]] = x["n"]
        return out

    def most(df: DataFrame, key: str, rank: int, *by: str) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), key)))
        kept = ranked.filter(F.col("rank") <= max(1, rank)).select(*by, key).distinct()
        of = F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("of")
        return df.join(kept, [*by, key]).groupBy(*by, key).agg(of).orderBy(*by, key)

    known = table(most(words, "word", MODEL_WORDS // len(langs)), "word")
    sizes: list[dict] = [{} for _ in range(LONGEST)]
    for row in most(pieces, "gram", MODEL_GRAMS // (LONGEST * len(langs)), "size").toArrow().to_pylist():
        sizes[row["size"] - 1][row["gram"]] = n = np.zeros(len(langs))
        for x in row["of"]:
            n[place[x["lang"]]] = x["n"]
    discard(words, pieces)
    return Model(langs, known, sizes)


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = None
    for batch in batches:
        scorer = scorer or Scorer(shared.value)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = identify(scorer, part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (the row may not teach), lang_pred and score of every row of ``docs``.

    Null texts and those without a letter are ``und`` with score 0, and so are all where the model knows no language. Texts
    of any length are read whole. Equal texts get equal results; repeated rows and null ids appear like others. An empty
    table gives an empty result; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", (~training()).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_predict, shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
