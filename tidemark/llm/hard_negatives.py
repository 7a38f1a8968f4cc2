"""Hard-negative mining by a vertical scan of columnar vectors (branch and bound over decomposed data).

Vectors are stored in blocks of rows, each dimension of a block in one piece with its least and greatest value. For an
anchor the dimensions of a block are read in the order of the anchor's descending magnitudes. After each few dimensions
the partial sums plus the least and greatest that the remaining dimensions can add bound every candidate's score, and the
bitmap of candidates shrinks to those that can still reach a place: first among the anchor's positives, then, the positives'
scores known, in one of the windows below them. What is left at the end has exact scores.

Every anchor meets every block. Anchors go in groups, blocks in shares; a group is copied to each share and a block to each
group, and an equality on (group, share) brings a bounded number of both together. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

#: Values of a block (rows times dimensions), blocks of a share and anchors of a group: what a task holds at once.
BLOCK_VALUES, SHARE_BLOCKS, GROUP_ANCHORS = 1 << 18, 8, 1024
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH per cent of the positive's.
LOW, HIGH = 50, 95
#: Dimensions between two looks at the bounds.
STEP = 8
_BLOCK = "block long, ids binary, labels binary, dims array<binary>, least array<long>, most array<long>"
_NONE = np.iinfo(np.int64).min


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, vec_id, label, vector of longs) as blocks; a vector's missing dimensions are zeros. Values take as few bytes as they need."""
    for batch in batches:
        lists = batch.column(3)
        sizes = np.diff(np.asarray(lists.offsets))
        if not len(sizes):
            continue
        flat, offsets, width = np.asarray(lists.values), np.asarray(lists.offsets), max(int(sizes.max()), 1)
        rows = max(64, BLOCK_VALUES // width)
        for at in range(0, len(sizes), rows):
            n = min(rows, len(sizes) - at)
            size = sizes[at : at + n]
            values = np.zeros((n, width), np.int64)
            values[np.arange(width) < size[:, None]] = flat[offsets[at] : offsets[at + n]]
            least, most = values.min(axis=0), values.max(axis=0)
            kind = next(k for k in (np.int16, np.int32, np.int64) if least.min() >= np.iinfo(k).min and most.max() <= np.iinfo(k).max)
            dims = np.ascontiguousarray(values.T.astype(kind))
            columns = [batch.column(c).slice(at, n) for c in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays(
                [columns[0].slice(0, 1), pa.array([np.asarray(columns[1]).astype("<i8").tobytes()]), pa.array([np.asarray(columns[2]).astype("<i8").tobytes()]),
                 pa.array([[d.tobytes() for d in dims]], pa.list_(pa.binary())), pa.array([least]), pa.array([most])],
                names=["block", "ids", "labels", "dims", "least", "most"])


class Block:
    """A block as arrays: ids, labels, dims (one row a dimension), least and most of each dimension."""

    def __init__(self, ids: bytes, labels: bytes, dims: list[bytes], least: list[int], most: list[int]):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        width = len(dims[0]) // len(self.ids)
        self.dims = [np.frombuffer(d, f"<i{width}") for d in dims]
        self.least, self.most = np.array(least, np.int64), np.array(most, np.int64)


def scan(block: Block, anchor: np.ndarray, rows: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``rows`` that may count, with their exact scores. ``alive(low, high, rows)`` says which rows can still count,
    given bounds of their scores; it must be true of every row that counts under its exact score."""
    width = min(len(anchor), len(block.dims))
    order = np.argsort(-np.abs(anchor[:width]), kind="stable")
    order = order[anchor[order] != 0]
    q = anchor[order]
    ends = np.stack([q * block.least[order], q * block.most[order]])
    # What the dimensions from each place on can add at least and at most.
    rest = np.concatenate([np.cumsum(np.stack([ends.min(axis=0), ends.max(axis=0)])[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), np.int64)], axis=1)
    total = np.zeros(len(rows), np.int64)
    whole = len(rows) == len(block.ids)
    for at in range(0, len(order), STEP):
        for d, x in zip(order[at : at + STEP].tolist(), q[at : at + STEP]):
            total += x * (block.dims[d] if whole else block.dims[d][rows])
        low, high = rest[:, min(at + STEP, len(order))]
        left = alive(total + low, total + high, rows)
        if not left.all():
            rows, total, whole = rows[left], total[left], False
        if not len(rows):
            break
    return rows, total


def _first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:most]


def _positives(anchor: dict, blocks: list[Block]) -> list[tuple[int, int]]:
    """(score, vec_id) of the best POSITIVES other rows of the anchor's label in these blocks."""
    best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    vector = np.array(anchor["vector"], np.int64)
    for block in blocks:
        rows = np.flatnonzero((block.labels == anchor["label"]) & (block.ids != anchor["vec_id"]))
        held = best[0]

        def alive(low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
            sure = np.concatenate([held, low])  # noqa: B023
            if len(sure) <= POSITIVES:
                return np.ones(len(rows), bool)
            return high >= np.partition(sure, len(sure) - POSITIVES)[len(sure) - POSITIVES]

        rows, score = scan(block, vector, rows, alive)
        score, ids = np.concatenate([best[0], score]), np.concatenate([best[1], block.ids[rows]])
        top = _first(score, ids, POSITIVES)
        best = score[top], ids[top]
    return list(zip(best[0].tolist(), best[1].tolist()))


def windows(scores: list[int]) -> np.ndarray:
    """Least and greatest score of a negative for each different positive score that leaves room for one."""
    return np.array([w for p in sorted(set(scores)) if (w := (-(-LOW * p // 100), HIGH * p // 100))[0] <= w[1]], np.int64).reshape(-1, 2)


def _negatives(anchor: dict, blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(window's upper end, score, vec_id) of the best NEGATIVES rows of other labels in each window, in these blocks."""
    spans = windows(anchor["scores"])
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in spans]
    vector = np.array(anchor["vector"], np.int64)
    for block in blocks if len(spans) else ():
        rows = np.flatnonzero(block.labels != anchor["label"])
        held = [b[0] for b in best]

        def alive(low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rows), bool)
            for (a, b), own in zip(spans, held):  # noqa: B023
                may = (high >= a) & (low <= b)
                sure = np.concatenate([own, low[may & (low >= a) & (high <= b)]])
                if len(sure) >= NEGATIVES:
                    may &= high >= np.partition(sure, len(sure) - NEGATIVES)[len(sure) - NEGATIVES]
                out |= may
            return out

        rows, score = scan(block, vector, rows, alive)
        for i, (a, b) in enumerate(spans):
            inside = (score >= a) & (score <= b)
            s, ids = np.concatenate([best[i][0], score[inside]]), np.concatenate([best[i][1], block.ids[rows[inside]]])
            top = _first(s, ids, NEGATIVES)
            best[i] = s[top], ids[top]
    return [(int(b), s, i) for (_, b), (scores, ids) in zip(spans, best) for s, i in zip(scores.tolist(), ids.tolist())]


def _met(find, names: list[str], anchors: pa.Table, blocks: pa.Table) -> pa.Table:
    """One group of anchors with one share of blocks: what ``find`` gives for each anchor."""
    parts = [Block(*[x[c] for c in ("ids", "labels", "dims", "least", "most")]) for x in blocks.to_pylist()]
    rows = [(a["vec_id"], *found) for a in anchors.to_pylist() for found in (find(a, parts) if parts else ())]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(["vec_id", *names])})


def _everywhere(anchors: DataFrame, blocks: DataFrame, groups: int, shares: int, find, names: list[str]) -> DataFrame:
    """Every anchor against every block: vec_id and the columns that ``find`` gives."""
    keyed = F.xxhash64("vec_id")
    left = anchors.withColumn("group", F.pmod(keyed, F.lit(groups))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = blocks.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = left.groupBy("group", "share").cogroup(right.groupBy("group", "share"))
    return met.applyInArrow(partial(_met, find, names), ", ".join(f"{c} long" for c in ["vec_id", *names]))


def _ranked(rows: DataFrame, by: list[str], rank: str, most: int) -> DataFrame:
    """The first rows of each group by descending score, then other_id; each task keeps so many before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (long) and vector (array of longs: floor(SCALE * x), x as double) of the rows that take part: those
    with an id, a label and a vector whose components are all finite. ids and labels are integers."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("vector"))


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for ``anchors``, some of ``rows`` (both:
    vec_id, label, vector as from usable()).

    An anchor's others are the rows of another vec_id. Repeated rows each count: as positives and negatives they take a
    place each (a repeated positive's negatives are repeated), while an id that several anchors share is one anchor, that of
    the least label, then vector. Ties go by vec_id. Shorter vectors end in zeros. Scores must fit 64 bits. An anchor
    without positives, or whose windows are empty, gives no row; empty tables give none. Results follow from the rows alone,
    whatever the blocks are.
    """
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), "vec_id", "label", "vector")
    blocks = settle(numbered.mapInArrow(_blocks, _BLOCK), "blocks")
    chosen = settle(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.label", "a.vector"), "anchors")
    groups, shares = (max(1, -(-df.count() // size)) for df, size in ((chosen, GROUP_ANCHORS), (blocks, SHARE_BLOCKS)))
    near = _everywhere(chosen, blocks, groups, shares, _positives, ["score", "other_id"])
    positives = settle(_ranked(near, ["vec_id"], "place", POSITIVES), "positives")
    # At most POSITIVES rows for each anchor.
    scored = chosen.join(positives.groupBy("vec_id").agg(F.collect_list("score").alias("scores")), "vec_id")
    far = _everywhere(scored, blocks, groups, shares, _negatives, ["top", "score", "other_id"])
    negatives = _ranked(far, ["vec_id", "top"], "rank", NEGATIVES)
    top = F.expr(f"(score * {HIGH} - pmod(score * {HIGH}, 100)) div 100")
    wanted = positives.select("vec_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), top.alias("top"))
    out = settle(wanted.join(negatives, ["vec_id", "top"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    ), "negatives")
    discard(blocks, chosen, positives)
    return out


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Mine for the rows whose vec_id is divisible by 50; where it is divisible by 7, label becomes (label + 1) % 10 first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings.select("vec_id", "embedding", label.alias("label")))
    return mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_inner_product(list_transform(a.v, lambda x: CAST(x AS DOUBLE)), list_transform(b.v, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
      FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""
