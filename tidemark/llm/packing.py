"""Packing of token sequences by minimum bin slack.

Documents are encoded and cut where a sequence is full; the rests, of 1 to 2047 ids, are packed. Each bin takes the
longest waiting rest and then the multiset of waiting lengths that fills the rest of the window best: a bitset holds the
sums that can be reached, one shift for each power-of-two share of a length's count, and walking the shifts back gives
the counts used. A partition is one stream: pieces wait in a pool of bounded size and what no bin takes waits for the
next rows; the last bins of a partition are filled by cutting and end in bins of powers of two. So no bin has slack, nothing is
shuffled and memory doesn't grow with the input.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, KEPT_LENGTH, weight

CAPACITY, POOL = 2048, 6000
#: Texts that are encoded at a time.
SLICE_BYTES = 8 << 20
#: The vocabulary's own pattern over lower-case text (contractions, runs of letters, digits, runs of others), and what keeps a
#: text from being cut by it here: characters past Latin Extended-A, those that Python's classes or lower() see in another way,
#: and the marks of special tokens.
_LETTERS = "a-zªµºß-öø-\u017f"
_WORDS = re.compile(rf"[{_LETTERS}]+|\d|'(?:[stmd]|re|ve|ll)|[^\s0-9{_LETTERS}]+").findall
_WORDS_LINES = re.compile(rf"[{_LETTERS}]+|\d|'(?:[stmd]|re|ve|ll)|[^\s0-9{_LETTERS}]+|\n").findall
#: The characters by which the vocabulary writes bytes that are not printable (others stand for themselves).
_BYTES = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)], range(256, 512)))
_FOREIGN = re.compile("[\x1c-\x1f\x85\xa0²³¹¼½¾İ\u0180-\U0010ffff]|<\\|").search


class Encoder(dict):
    """Ids (little-endian unsigned 32-bit) by word, kept between texts up to CACHE_BYTES; words of more than KEPT_LENGTH characters are not.

    The vocabulary lower-cases a text and cuts it into words (contractions, runs of letters, single digits, runs of
    others) that are encoded one by one. Texts of Latin characters are cut here by the same pattern, so that each
    distinct word is encoded once, by the vocabulary's model over the word's bytes as it writes them. Other texts are cut at white space only, which no id spans, and the library does the rest.

    ``encode_column`` cuts a column of texts at white space, and only distinct parts that are new go through ``encode``; the ids
    of the others are gathered.
    """

    def __init__(self, path: str, most: int = CACHE_BYTES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.held, self.chunks, self.parts = Tokenizer.from_file(path), most, 0, {}, {}
        self.model = self.tokenizer.model

    def _learn(self, words: list[str]) -> None:
        tokenize = self.model.tokenize
        for w in words:
            self[w] = array.array("I", [t.id for t in tokenize(w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(_BYTES))]).tobytes()
        self.held += weight(words, map(self.__getitem__, words))

    def _other(self, text: str) -> bytes:
        known, out = self.chunks, []
        for c in text.encode("utf-8", "surrogatepass").split():
            if (ids := known.get(c)) is None:
                ids = np.array(self.tokenizer.encode(c.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
                if len(c) <= KEPT_LENGTH:
                    known[c] = ids
                    self.held += weight([c], [ids])
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.most:
            self.clear()
            self.chunks.clear()
            self.parts.clear()
            self.held = 0
        split = [None if _FOREIGN(t) else _WORDS(t.lower()) for t in texts]
        coded = [None if words is None else list(map(self.get, words)) for words in split]
        missing: set[str] = set()
        for words, ids in zip(split, coded):
            if ids and None in ids:
                missing.update([w for w, i in zip(words, ids) if i is None])
        self._learn(sorted(missing))
        out = []
        for t, words, ids in zip(texts, split, coded):
            if words is None:
                out.append(self._other(t))
            else:
                out.append(b"".join([self[w] if i is None else i for w, i in zip(words, ids)]))
        for w in [w for w in missing if len(w) > KEPT_LENGTH]:
            self.held -= weight([w], [self.pop(w)])
        return out


    def _parts(self, parts: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The ids of parts without white space, one after another, and how many bytes each part's take."""
        if not parts:
            return b"", np.zeros(0, np.int64)
        text = b"\n".join(parts).decode("utf-8", "replace")
        if _FOREIGN(text):
            ids = self.encode(text.split("\n"))
            return b"".join(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        # All are cut in one pass, so no list is made for each part; line ends have no ids.
        words = _WORDS_LINES(text.lower())
        self["\n"] = b""
        missing = set(words).difference(self)
        self._learn(list(missing))
        ids = list(map(self.__getitem__, words))
        for w in [w for w in missing if len(w) > KEPT_LENGTH]:
            self.held -= weight([w], [self.pop(w)])
        at = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        lines = np.fromiter(map("\n".__eq__, words), bool, len(words))
        return b"".join(ids), np.diff(at[lines], prepend=0, append=at[-1] if len(at) else 0)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (nulls are empty), one after another, and where each text's ids end."""
        if self.held > self.most:
            self.encode([])  # drops what is kept
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
        which = coded.indices.to_numpy()
        found = list(map(self.parts.get, names))
        new = np.fromiter((ids is None for ids in found), bool, len(found))
        data, sizes = [ids for ids in found if ids is not None], np.zeros(len(names), np.int64)
        sizes[~new] = np.fromiter(map(len, data), np.int64, len(data))
        fresh, sizes[new] = self._parts([n for n, ids in zip(names, found) if ids is None])
        # First the known parts' ids, then the new ones'.
        begins, old = np.zeros(len(names), np.int64), int(sizes[~new].sum())
        begins[~new] = np.cumsum(sizes[~new]) - sizes[~new]
        begins[new] = np.cumsum(sizes[new]) - sizes[new] + old
        often = new & (np.bincount(which, minlength=len(names)) > 1)  # a part that occurs once here is mostly a rare one
        for i, a, n in zip(np.flatnonzero(often).tolist(), (begins[often] - old).tolist(), sizes[often].tolist()):
            if len(names[i]) <= KEPT_LENGTH:
                self.parts[names[i]] = ids = fresh[a : a + n]
                self.held += 200 + 4 * len(names[i]) + len(ids)
        ids = np.frombuffer(b"".join([*data, fresh]), "<u4")
        begins //= 4
        counts = (sizes // 4)[which]
        ends = np.cumsum(counts)
        at = np.repeat(begins[which] - ends + counts, counts)
        at += np.arange(len(at))
        edges = lists.offsets.to_numpy()
        return ids[at], np.concatenate(([0], ends))[edges[1:] - edges[0]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in runs of about so many bytes, one text at least."""
    share = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and how many of each sum up to room or as near below it as can be; counts[n] pieces of length n wait."""
    reach, mask, steps = 1, (2 << room) - 1, []
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, share = min(int(counts[n]), room // n), 1
        while left > 0:
            take = min(share, left)
            steps.append((n, take, reach))
            reach |= reach << n * take & mask
            left -= take
            share *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            used[n] += take
            total -= n * take
    return used


class Pool:
    """Pieces that wait, by length; bins() empties it down to ``keep`` pieces."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.waiting, self.size = capacity, np.zeros(capacity + 1, np.int64), defaultdict(list), 0

    def add(self, piece: tuple) -> None:
        self.waiting[piece[2]].append(piece)
        self.counts[piece[2]] += 1
        self.size += 1

    def take(self, used: dict[int, int]) -> list[tuple]:
        taken = [self.waiting[n].pop() for n, k in used.items() for _ in range(k)]
        for n, k in used.items():
            self.counts[n] -= k
        self.size -= len(taken)
        return taken

    def bins(self, keep: int, cut_last: bool = True) -> Iterator[list[tuple]]:
        while self.size > keep:
            longest = int(np.flatnonzero(self.counts)[-1])
            self.counts[longest] -= 1
            used = fill(self.counts, self.capacity - longest)
            self.counts[longest] += 1
            used[longest] += 1
            if not keep and cut_last and sum(n * k for n, k in used.items()) < self.capacity:
                break
            # The same counts are used again as long as they last.
            for _ in range(min(int(self.counts[n]) // k for n, k in used.items())):
                yield self.take(used)
                if self.size <= keep:
                    break
        if not keep and cut_last:
            yield from self.last_bins()

    def last_bins(self) -> Iterator[list[tuple]]:
        """What no full bin takes, longest first and cut where a bin is full; the ids left over fill bins of powers of two, so nothing is padded."""
        left = [self.waiting[n].pop() for n in np.flatnonzero(self.counts)[::-1].tolist() for _ in range(int(self.counts[n]))]
        self.counts[:], self.size = 0, 0
        total, room, taken = sum(p[2] for p in left), 0, []
        left.reverse()
        while left:
            if not room:
                if taken:
                    yield taken
                room, taken = min(self.capacity, 1 << total.bit_length() - 1), []
                total -= room
            piece = left.pop()
            if piece[2] > room:
                piece, rest = cut(piece, room)
                left.append(rest)
            taken.append(piece)
            room -= piece[2]
        if taken:
            yield taken


def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    """The piece's first ids and the rest; a piece is key, start, length, crc32, ids of its document, ids."""
    key, start, length, _, total, ids = piece
    one, other = ids[: 4 * at], ids[4 * at :]
    return (key, start, at, zlib.crc32(one), total, one), (key, start + at, length - at, zlib.crc32(other), total, other)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, pool: int = POOL, keep_ids: bool = False, cut_last: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): one row per piece.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed like any other. An empty table gives
    an empty result; other columns are ignored. A text of any length is encoded whole and cut at each ``capacity`` ids;
    unless ``cut_last`` is false, the last bins of a partition are filled by further cuts and not padded.
    sequence_id is the partition number and a counter, so the rows of docs should be read in a fixed order (from files).
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, waiting, sequence = encoder(path).encode_column, Pool(capacity), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        types: list = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*[(*r[:5], *r[6:], *((np.frombuffer(r[5], "<i4"),) if keep_ids else ())) for r in rows])) or [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f"c{i}" for i in range(len(types))])

        def each(ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
            at = 0
            for to in ends.tolist():
                yield ids[at:to].tobytes() + end
                at = to

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for p in pieces:
                rows.append((*(p if keep_ids else (*p[:5], None)), sequence, at))
                at += p[2]
            sequence += 1

        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            for key, ids in zip(batch.column(0).to_pylist(), (i for part in slices(batch.column(1)) for i in each(*encode(part)))):
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    piece = (key, start, len(part) // 4, zlib.crc32(part), total, part)
                    if piece[2] == capacity:
                        place([piece])
                    else:
                        waiting.add(piece)
                if waiting.size > pool:
                    for pieces in waiting.bins(pool // 2):
                        place(pieces)
                if len(rows) > 5000:
                    yield out()
        for pieces in waiting.bins(0, cut_last):
            place(pieces)
        if rows:
            yield out()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, schema)
