"""SentencePiece encoding and decoding in batched numpy.

Distinct words of many texts are grouped by length; the words of a group advance together, end by end. Rolling hashes of
all their substrings probe the sorted keys of the pieces, which gives the pieces that end at each place. A Viterbi pass
takes, over the pieces that end there, the vectorised maximum of what came before plus the piece's own value, and stores
backpointers.

For unigram models the value is the piece's score. A BPE model's scores are merge ranks, whose sum says nothing: there a
piece is worth 0 if it may follow the last piece of the text before it and minus infinity if not. It may if merging the
joined text of the two gives just these two: merges left of a place where two tokens part in the end are those of the left
text alone, so a text's tokens are the chain of pieces of which each follows the one before, and exactly one piece at each
place does. Which pairs may stand side by side follows from the merges of either piece alone, once for each pair that occurs
(a bounded table).

Words are first cut where two characters meet that stand side by side in no piece, as no token crosses such a place. What is
still long goes through a BPE pass as overlapping windows, all at once: where a window and the next hold the same token at
the same place, the chain up to it and the chain from it on are one chain. A word of which two windows agree nowhere (a
repeated character, cut in another phase by each) is followed from its start, character by character.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, KEPT_LENGTH, weight

SPACE = "▁"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Places of the table of pairs, a power of two.
PAIRS = 1 << 22
_CODES = 0x110000
#: Characters that go through the passes together; their arrays stay near the processor.
_CHUNK = 1 << 16
#: Characters of a window of a long word, and those that it shares with the next.
_WINDOW, _SHARED = 256, 64


class Pieces:
    """The pieces of a model, their sorted keys, and the segmentation of words."""

    def __init__(self, pieces: list[str], scores: list[float], bpe: bool, byte_ids: list[int] | None = None, unknown: int = 0, special: frozenset[int] = frozenset()):
        self.pieces, self.scores, self.bpe, self.byte_ids, self.unknown, self.special = pieces, np.array(scores), bpe, byte_ids, unknown, special
        usable = [i for i, p in enumerate(pieces) if p and i not in special]
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        keys, ids = [], []
        for width in sorted({len(pieces[i]) for i in usable}):
            own = [i for i in usable if len(pieces[i]) == width]
            keys.append(self._keys(np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64), width)[:, 0])
            ids += own
        keys, ids = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.array(ids, np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        #: Marks the high bits of the keys, so that most substrings need no search.
        self._marked = np.zeros(1 << 20, bool)
        self._marked[self.keys >> np.uint64(44)] = True
        beside = {(ord(a) << 21) + ord(b) for i in usable for a, b in zip(pieces[i], pieces[i][1:])}
        self.beside = np.array(sorted(beside), np.int64)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have the same hash")
        self.index = {pieces[i]: i for i in usable}
        self.rank = {pieces[i]: float(scores[i]) for i in usable}
        #: The token before the first one; characters without a piece are tokens after it.
        self.none = len(pieces)
        self._histories: dict[str, list | None] = {}
        self._pair, self._may = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        alone = {c for i in usable if len(pieces[i]) > 1 for c in pieces[i]}
        # No piece goes on past a word, so words are cut before a run of spaces, and around line ends if no piece holds one.
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if "\n" not in alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in usable)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "a  Äﬁ x\n"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model changes text before it cuts it; only spaces may be marked")
        n = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in n]
        byte_ids = [i for i in n if sp.is_byte(i)]
        special = frozenset(i for i in n if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        scores = [sp.get_score(i) for i in n]
        ranks = all(float(s).is_integer() for s in scores)  # log probabilities aren't whole numbers
        return cls(names, scores, ranks, byte_ids or None, sp.unk_id(), special)

    def _keys(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Keys of all substrings of a width: rows are words."""
        n, length = codes.shape
        h = np.zeros((n, length - width + 1), np.uint64)
        for i in range(width):
            h = h * _BASE + codes[:, i : length - width + 1 + i] + np.uint64(1)
        h ^= np.uint64(width * 0xC2B2AE3D27D4EB4F % 2**64)
        h ^= h >> np.uint64(31)
        return h * _MIX

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each width the piece over each start, or -1."""
        found = []
        for width in range(1, min(self.longest, codes.shape[1]) + 1):
            keys = self._keys(codes, width)
            ids = np.full(keys.shape, -1, np.int64)
            likely = np.nonzero(self._marked[keys >> np.uint64(44)])
            own = keys[likely]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            ids[likely] = np.where(self.keys[at] == own, self.ids[at], -1)
            found.append(ids)
        return found

    def viterbi(self, codes: np.ndarray, table: list[np.ndarray], sizes: np.ndarray | None = None) -> np.ndarray:
        """Tokens at their starts, -1 elsewhere: a piece's id, or ``none`` + 1 + its code for a character that isn't a piece.

        ``sizes``: the words' lengths where rows are padded at their ends."""
        n, length = codes.shape
        most, every = len(table), np.arange(n)
        worst = (self.scores.min() if len(self.scores) else 0) - 10
        ending = np.full((length + 1, most, n), -1, np.int32)
        for w, p in enumerate(table, 1):
            ending[w:, w - 1] = p.T
        alone = ending[1:, 0]
        alone[alone < 0] = (codes.T.astype(np.int32) + self.none + 1)[alone < 0]
        best, last, back = np.full((length + 1, n), -np.inf), np.full((length + 1, n), self.none), np.zeros((length + 1, n), np.int64)
        best[0] = 0
        for end in range(1, length + 1):
            pieces = ending[end, : min(most, end)]
            width, row = np.nonzero(pieces >= 0)
            piece, before = pieces[width, row].astype(np.int64), end - 1 - width
            if self.bpe:
                value = np.where(self.follows(last[before, row], piece), 0.0, -np.inf)
            else:
                value = np.where(piece < self.none, self.scores[np.minimum(piece, self.none - 1)], worst)
            options = np.full(pieces.shape, -np.inf)
            options[width, row] = best[before, row] + value
            chosen = options.argmax(axis=0)
            best[end], back[end], last[end] = options[chosen, every], chosen + 1, pieces[chosen, every]
        tokens, end = np.full((n, length), -1, np.int64), np.full(n, length) if sizes is None else np.array(sizes)
        row = every[end > 0]
        while len(row):
            start = end[row] - back[end[row], row]
            tokens[row, start] = last[end[row], row]
            end[row] = start
            row = row[start > 0]
        return tokens

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may stand after the token before it (``none``: at the start of a word)."""
        key = before * (self.none + 1 + _CODES) + piece
        place = (key.view(np.uint64) * _MIX >> np.uint64(64 - PAIRS.bit_length() + 1)).view(np.int64)
        found = self._may[place]
        new = np.flatnonzero(self._pair[place] != key)
        if len(new):
            keys, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            may = self._side_by_side(before[new[first]], piece[new[first]])
            found[new] = may[of]
            self._pair[place[new[first]]], self._may[place[new[first]]] = keys, may
        return found

    def _side_by_side(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        name = lambda t: "" if t == self.none else self.pieces[t] if t < self.none else chr(t - self.none - 1)
        pairs = zip(map(name, before.tolist()), map(name, piece.tolist()))
        return np.array([self.beside_each_other(a, b) for a, b in pairs], bool)

    def history(self, text: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a token of the text, each with its value and the first and last token after it; None if they don't."""
        if text not in self._histories:
            steps: list[tuple[float, str, str]] = []
            parts = self.merged(text, steps)
            self._histories[text] = steps if len(parts) == 1 else None
        return self._histories[text]

    def beside_each_other(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: both sides merge as they would alone, the better merge first, and none joins them.

        Of equal values the leftmost merge comes first."""
        right, left = self.history(b), self.history(a) if a else []
        if left is None or right is None:
            return False
        if not a:
            return True
        end, start, i, j = a[-1], b[0], 0, 0
        across = self.rank.get(end + start, -np.inf)
        while True:
            before = left[i][0] if i < len(left) else -np.inf
            after = right[j][0] if j < len(right) else -np.inf
            if across > before and across >= after and across > -np.inf:
                return False
            if i == len(left) and j == len(right):
                return True
            if before >= after and i < len(left):
                edge, i = (left[i][2], start), i + 1
            else:
                edge, j = (end, right[j][1]), j + 1
            if edge != (end, start):
                end, start = edge
                across = self.rank.get(end + start, -np.inf)

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The tokens of a short text by merging the best pair of neighbours, the leftmost of equals, until none is a piece.

        ``steps`` takes each merge's value and the first and the last token after it."""
        parts, rank = list(text), self.rank.get
        values = [rank(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
        while values and (best := max(values)) > -np.inf:
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = rank(parts[at - 1] + parts[at], -np.inf)
            if at < len(values):
                values[at] = rank(parts[at] + parts[at + 1], -np.inf)
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def _bytes_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens, and how many each has: characters without a piece are their bytes, or unknown."""
        odd = tokens > self.none
        if not odd.any():
            return tokens, np.ones(len(tokens), np.int64)
        chars, place = np.unique(tokens[odd], return_inverse=True)
        spelled = [[self.byte_ids[b] for b in chr(c - self.none - 1).encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown] for c in chars.tolist()]
        sizes = np.ones(len(tokens), np.int64)
        lengths = np.array([len(x) for x in spelled])
        sizes[odd] = lengths[place]
        ids = np.repeat(tokens, sizes)
        flat, first = np.concatenate(spelled), np.cumsum(lengths) - lengths
        at = np.flatnonzero(np.repeat(odd, sizes))
        own = lengths[place]
        ids[at] = flat[np.repeat(first[place] - (np.cumsum(own) - own), own) + np.arange(len(at))]
        return ids, sizes

    def tokens(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens at their places in ``codes``, -1 elsewhere, for stretches that are words of their own; stretches of like
        length go together, the longer ones padded by a quarter at most."""
        out = np.full(len(codes), -1, np.int64)
        step = np.left_shift(1, np.maximum(np.frexp(sizes)[1] - 3, 0))
        padded = -(-sizes // step) * step
        order = np.argsort(padded, kind="stable")
        lengths, firsts = np.unique(padded[order], return_index=True)
        for length, a, b in zip(lengths.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(order)]):
            for at in range(a, b, max(1, _CHUNK // length)):
                rows = order[at : min(b, at + max(1, _CHUNK // length))]
                place = starts[rows][:, None] + np.arange(length)
                inside = np.arange(length) < sizes[rows][:, None]
                part = np.where(inside, codes[np.minimum(place, len(codes) - 1)], 0).astype(np.uint64)
                found = self.viterbi(part, self.spans(part), sizes[rows])
                out[place[inside]] = found[inside]
        return out

    def followed(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of one stretch by the chain alone."""
        text, known = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), {}
        names = [""]
        for end in range(1, len(text) + 1):
            for width in range(1, min(self.longest, end) + 1):
                name = text[end - width : end]
                if width > 1 and name not in self.index:
                    continue
                pair = names[end - width], name
                if (may := known.get(pair)) is None:
                    may = known[pair] = self.beside_each_other(*pair)
                if may:
                    names.append(name)
                    break
        out, end = np.full(len(text), -1, np.int64), len(text)
        while end:
            name = names[end]
            end -= len(name)
            out[end] = self.index.get(name, self.none + 1 + ord(name[0]))
        return out

    def long_tokens(self, codes: np.ndarray) -> np.ndarray:
        """The same for one long stretch, by windows; see above."""
        n, window, shared = len(codes), _WINDOW, _SHARED
        starts = np.arange(0, n - shared, window - shared)
        sizes = np.minimum(window, n - starts)
        base = np.cumsum(sizes) - sizes
        apart = codes[np.repeat(starts - base, sizes) + np.arange(int(sizes.sum()))]
        found = self.tokens(apart, base, sizes)
        # The shared characters of each window and the next.
        here, there = (base[:-1] + window - shared)[:, None] + np.arange(shared), base[1:, None] + np.arange(shared)
        same = (found[here] == found[there]) & (found[there] >= 0)
        if not same.any(axis=1).all():
            return self.followed(codes)
        at = same.argmax(axis=1)
        # Of each window the places from its agreement with the one before up to that with the next.
        first, last = np.concatenate([[0], at]), np.concatenate([at + window - shared, [sizes[-1]]])
        kept = last - first
        return found[np.repeat(base + first - (np.cumsum(kept) - kept), kept) + np.arange(n)]

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(codes):
            return [b""] * len(words)
        pair = (codes[:-1] << 21) + codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), max(len(self.beside) - 1, 0))
        cut = np.ones(len(codes), bool)
        cut[1:] = (self.beside[at] != pair) if len(self.beside) else True
        ends = np.cumsum(lengths)
        cut[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(codes))
        long = self.bpe & (sizes > _WINDOW)
        found = self.tokens(codes, starts[~long], sizes[~long])
        for a, size in zip(starts[long].tolist(), sizes[long].tolist()):
            found[a : a + size] = self.long_tokens(codes[a : a + size])
        real = np.flatnonzero(found >= 0)
        ids, each = self._bytes_of(found[real])
        # Bytes up to the end of each word.
        until = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(real, ends)] * 4
        coded = ids.astype("<u4").tobytes()
        return [coded[a:b] for a, b in zip([0, *until[:-1].tolist()], until.tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark before the first word is dropped."""
        if not hasattr(self, "_spelled"):
            byte = {i: bytes((b,)) for b, i in enumerate(self.byte_ids or [])}
            spelled = [byte.get(i, b"" if i in self.special else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")) for i, p in enumerate(self.pieces)]
            self._spelled, self._sizes = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
            self._starts = np.cumsum(self._sizes) - self._sizes
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        flat = self._spelled[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        text = flat.tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder(dict):
    """Ids (little-endian unsigned 32-bit) by word of up to KEPT_LENGTH characters, kept between texts up to ``most`` bytes."""

    def __init__(self, path: str, most: int = 2 * CACHE_BYTES):
        super().__init__()
        self.pieces, self.most, self.held = Pieces.load(path), most, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        split = [[t] if self.pieces.whole else self.pieces.cut.findall(t) for t in marked]
        if self.held > self.most:
            self.clear()
            self.held = 0
        missing = list(set().union(*split).difference(self))
        coded = self.pieces.segment(missing)
        self.update(zip(missing, coded))
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        for w in [w for w in missing if len(w) > KEPT_LENGTH]:
            del self[w]
        self.held += weight([w for w in missing if len(w) <= KEPT_LENGTH], coded)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, n_bytes_ids (ids of the byte fallback), ids_crc32, round_trip (decoding gives the text back) and ids, for every row.

    Null and empty texts have no ids. Repeated rows and null ids appear like others. An empty table gives an empty
    result; other columns are ignored. Texts of any length are encoded whole; a stretch without a place to cut costs a pass
    over windows of it, or is followed character by character where windows never agree.
    """
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        byte = np.zeros(len(known.pieces.pieces), bool)
        byte[known.pieces.byte_ids or []] = True
        names = ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"] + ["ids"] * keep_ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = known.encode(texts)
                ids = [np.frombuffer(c, "<u4").astype(np.int32) for c in coded]
                columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(byte[i].sum()) for i in ids], pa.int64()),
                           pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([known.pieces.decode(i) == t for i, t in zip(ids, texts)])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *[pa.array(ids, pa.list_(pa.int32()))] * keep_ids], names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind.simpleString()}, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id and ids; null ids give an empty text."""
    kind = coded.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for batch in batches:
            texts = [pieces.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind.simpleString()}, text string")
