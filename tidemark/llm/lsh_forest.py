"""MinHash near-dedup with an LSH forest.

Texts with equal shingle sets are one class. Each class representative stands in TREES sorted orders, each by another
run of its MinHash values. Neighbours in an order that share at least DEPTH leading values are candidates: where few
representatives share a prefix all of them meet, in dense regions the neighbours are those with the longest common
prefix, so the depth follows the density. A packed two-bit copy of the signature drops hopeless candidates. Candidates
are confirmed on full shingle sets, the best ones of each representative first, then all that still join two components;
with these go the members of dense regions and the regions' best-linked members (hubs), if their components differ.

Neighbours and hubs bound what a member of a dense region meets, and so do the ends of a sorted range for the regions that
they cut. Such a region is open if its members are in more than one component, and a member with more than OPEN open regions
goes down to the next forest of FORESTS, of other hashes, with more trees and longer prefixes: texts that share common
passages part there, so that what one meets doesn't grow with the corpus. Members that are left with more open regions than
a forest allows are in crowds at full depth, and take an exact pass: a pair at the threshold shares one of the rarest 8 % of
the smaller set's shingles that is one of the rarest 15 % of the larger one's, and an equality join on these, with filters
on lengths and places, finds every pair that still joins two components.

What remains is the chance of MinHash itself: a pair at the threshold meets in one tree with probability 0.85**4 = 0.52, so
it misses all 24 with 2e-8 (22 with 9e-8, where two regions of either are open), all but 12 of the 64 trees of depth 8 with
7e-8, and the packed signature drops it with 8e-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle
from .components import components
from .shingles import P as _P
from .shingles import shingle_hashes

PERCENT = 85
TREES, DEPTH, LONGEST = 24, 4, 12
HASHES = TREES * DEPTH
#: Open regions that a member may have: the other trees find its pairs.
OPEN = 2
#: Forests for members with more: trees, depth and the open regions allowed.
FORESTS = ((64, 8, 12),)
#: Columns of the values after the prefix, two in each.
_NEXT = [f"s{i}" for i in range((LONGEST - DEPTH) // 2)]
#: Next neighbours in a sorted order that share the prefix.
NEIGHBOURS = 5
#: Hubs of a dense region, which all its members meet besides their neighbours.
HUBS = 8
#: Of 96 two-bit values of a pair at the threshold 85.2 agree; fewer than this with 8e-9 (binomial).
LEAST_AGREE = 65
#: Pairs with a hub are tried from here on (a standard deviation below the mean at the threshold); the exact pass has the rest.
LIKELY = 82
#: Counters of shingles, by the low bits of their hashes.
COUNTERS = 1 << 20
_FACTORS = np.random.default_rng(20240229).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """MinHash values, 32 bits each, HASHES of them unless other factors are given."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _packed(s: np.ndarray) -> list[np.ndarray]:
    """Two bits of each of the first 96 values of signatures (rows), 32 in a column."""
    two = (s * np.uint64(0x9E3779B1)) >> np.uint64(17) & np.uint64(3)
    return [np.bitwise_or.reduce(two[:, i * 32 : i * 32 + 32] << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64) for i in range(3)]


def _prefix(values: np.ndarray, tree: int) -> np.ndarray:
    """Keys of the rows' values in a tree."""
    key = np.full(len(values), tree + 1, np.uint64)
    for i in range(values.shape[1]):
        key = (key ^ values[:, i]) * _P
        key ^= key >> np.uint64(31)
    return key


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts, digests, signatures = [], [], []
            for text in part.column(1).to_pylist():
                hashes = shingle_hashes(text)
                counts.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                signatures.append(signature(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per representative and tree: the prefix, the next values, the packed signature, the id."""
    runs = (np.arange(TREES)[:, None] * DEPTH + np.arange(LONGEST)) % HASHES
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, HASHES).astype(np.uint64)
        packed = _packed(s)
        ids = batch.column(0)
        for tree in range(TREES):
            v = s[:, runs[tree]]
            key = _prefix(v[:, :DEPTH], tree)
            later = [(v[:, i] << np.uint64(32) | v[:, i + 1]).view(np.int64) for i in range(DEPTH, LONGEST, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, later), *map(pa.array, packed), ids], names=["key", *_NEXT, "k1", "k2", "k3", "rep"])


def _plant_deep(level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for a forest of FORESTS from texts; of hashes of its own, with a tree's next run for the values after the prefix."""
    trees, depth, _ = FORESTS[level]
    factors = np.random.default_rng(20240301 + level).integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            s = np.stack([signature(shingle_hashes(t), factors) for t in part.column(1).to_pylist()]).astype(np.uint64)
            packed = _packed(s)
            for tree in range(trees):
                v = s[:, (np.arange(depth + 2) + tree * depth) % (trees * depth)]
                later = (v[:, depth] << np.uint64(32) | v[:, depth + 1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_prefix(v[:, :depth], tree).view(np.int64)), pa.array(later), *map(pa.array, packed), part.column(0), part.column(2)], names=["key", "s0", "k1", "k2", "k3", "rep", "component"])


_FOUND = "key long, a long, b long, agree int, k1 long, k2 long, k3 long"


def _agreeing(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of 96 two-bit values, how many agree."""
    agree = np.full(len(x[0]), 96)
    for a, b in zip(x, y):
        d = (a ^ b).view(np.uint64)
        agree -= np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return agree


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b, agree) from rows in sorted order, the last rows of a batch carried over to the next; and each
    row (key, a, packed signature; b is null) of a dense region, that is one with more rows than are compared with each
    other, or of the first and the last region of the range, which its ends may cut."""
    tail: list[np.ndarray] | None = None
    opening = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # Rows of one component, where it is known, are no candidates.
        now = [np.asarray(batch.column(c)) for c in ("key", "k1", "k2", "k3", "rep", "component" if "component" in batch.schema.names else "rep")]
        cols = now if tail is None else [np.concatenate(x) for x in zip(tail, now)]
        old = 0 if tail is None else len(tail[0])
        key, rep = cols[0], cols[4]
        n = len(key)
        opening = key[0] if opening is None else opening
        found = []
        for step in range(1, min(NEIGHBOURS, n - 1) + 1):
            # Only pairs whose later row is new.
            i = np.flatnonzero(key[max(old, step) - step : n - step] == key[max(old, step) :]) + max(old, step) - step
            agree = _agreeing(tuple(k[i] for k in cols[1:4]), tuple(k[i + step] for k in cols[1:4]))
            near = (agree >= LEAST_AGREE) & (cols[5][i] != cols[5][i + step])
            i, agree = i[near], agree[near]
            found.append((np.minimum(rep[i], rep[i + step]), np.maximum(rep[i], rep[i + step]), agree))
        member = key == opening
        if n > NEIGHBOURS:
            # A row and the one NEIGHBOURS before it in one region: all rows between belong to a dense region.
            far = np.flatnonzero(key[NEIGHBOURS:] == key[:-NEIGHBOURS])
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, far, 1)
            np.add.at(inside, far + NEIGHBOURS + 1, -1)
            member |= np.cumsum(inside)[:n] > 0
        dense = np.flatnonzero(member)
        yield _rows([np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)], [c[dense] for c in cols[:5]])
        tail = [x[-NEIGHBOURS:] for x in cols]
    if tail is not None:
        closing = tail[0] == tail[0][-1]
        yield _rows([np.zeros(0, np.int64)] * 3, [c[closing] for c in tail[:5]])


def _rows(pairs: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of _FOUND: pairs (a, b, agree), then members (key, k1, k2, k3, rep)."""
    (a, b, agree), (key, k1, k2, k3, rep) = pairs, members
    none = lambda m: pa.nulls(m, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([none(len(a)), pa.array(key)]), pa.array(np.concatenate([a, rep])), pa.concat_arrays([pa.array(b), none(len(rep))]),
         pa.concat_arrays([pa.array(agree.astype(np.int32)), pa.nulls(len(rep), pa.int32())]), *[pa.concat_arrays([none(len(a)), pa.array(k)]) for k in (k1, k2, k3)]],
        names=["key", "a", "b", "agree", "k1", "k2", "k3"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: tuple = (None, None)
    for batch in batches:
        a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
        linked = []
        for i in range(batch.num_rows):
            if kept[0] != (left := a[i].as_py()):
                kept = (left, shingle_hashes(ta[i].as_py()))
            x, y = kept[1], shingle_hashes(tb[i].as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _hub_pairs(members: DataFrame, links: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of every member of a dense region and the two likeliest hubs of its regions that are in other components.

    Hubs are the members with the most confirmed links, one of each of HUBS shares of the region (a map-side maximum): in a
    crowd of near copies the copy with the fewest changes, which a much changed copy may be near to and to no other. They
    only save work: what they leave apart the exact pass joins."""
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    component = held.select(F.col("node").alias("rep"), "component")
    known = members.join(degree, "rep", "left").join(component, "rep", "left").withColumns({"component": F.coalesce("component", "rep"), "degree": F.coalesce("degree", F.lit(0))})
    best = F.struct("degree", (-F.col("rep")).alias("first"), "rep", "component", "k1", "k2", "k3")
    hubs = known.filter("degree > 1").groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).alias("share")).agg(F.max(best).alias("hub")).select("key", "hub")
    agree = F.lit(96)
    for k in ("k1", "k2", "k3"):
        d = F.col(k).bitwiseXOR(F.col(f"hub.{k}"))
        agree = agree - F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    met = known.join(hubs, "key").filter(F.col("component") != F.col("hub.component")).select("rep", F.struct((-agree).alias("apart"), F.col("hub.rep").alias("hub")).alias("h"))
    # As a set by member: at most TREES * HUBS of them.
    best = met.filter(-F.col("h.apart") >= LIKELY).groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("h")), 1, 2).alias("h")).select("rep", F.explode("h.hub").alias("hub"))
    return best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).view(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a partition fall on each counter."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            np.add.at(counts, _counters(shingle_hashes(text.as_py())), 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["counter", "n"])


def _rarest(often, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per representative and each of its rarest shingles: the shingle, the id, its component, the size of its set, how
    many shingles stand from here on (reach), and whether the shingle is one of the fewer that the smaller set of a pair
    needs (lesser). Any total order of shingles is right, the rarest first only saves work."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [[np.zeros(0, np.int64)] for _ in range(6)]
            for rep, component, text in zip(*(part.column(c).to_pylist() for c in ("rep", "component", "_text"))):
                h = shingle_hashes(text)
                n = len(h)
                # A set that holds PERCENT of the union holds as much of either set, so the first common shingle is one of these.
                first = h[np.lexsort((h, often.value[_counters(h)]))[: n - (PERCENT * n + 99) // 100 + 1]] if n else h
                whole, place = np.ones(len(first), np.int64), np.arange(len(first))
                # With a set at least as large it shares 2 * PERCENT / (100 + PERCENT) of its own.
                lesser = (place <= n - -(-2 * PERCENT * n // (100 + PERCENT))).astype(np.int64)
                for column, values in zip(rows, (first.view(np.int64), whole * rep, whole * component, whole * n, n - place, lesser)):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=["shingle", "rep", "component", "n", "reach", "lesser"])


def _exact_pairs(dense: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (a, b; ca, cb: their components) of dense members in different components that can reach the threshold.

    Two sets share at most the reach of their first common shingle. The smaller set of a pair brings its few rarest
    shingles, so that a template that many texts share meets nothing but texts that are near to it. Components meet first,
    by their least set and greatest reach under each shingle: a crowd that is one component is one row and not the square
    of its members."""
    spark = dense.sparkSession
    own = dense.join(held.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = settle(own, "own")
    crowd = texts.join(own, F.col("_id") == F.col("rep"))
    counts = crowd.select("_text").mapInArrow(_tally, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    often = np.zeros(COUNTERS, np.int64)
    often[np.asarray(counts.column("counter"))] = np.asarray(counts.column("n"))
    shared = spark.sparkContext.broadcast(often)
    rows = settle(crowd.select("rep", "component", "_text").mapInArrow(partial(_rarest, shared), "shingle long, rep long, component long, n long, reach long, lesser long"), "rarest")
    shared.unpersist()
    groups = rows.groupBy("shingle", "component", "lesser").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"))
    groups = settle(groups, "groups")
    side = lambda df, x: df.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("shingle", "lesser")])
    both = 100 + PERCENT
    met = side(groups.filter("lesser = 1"), "a").join(side(groups, "b"), "shingle").filter(
        (F.col("component_a") != F.col("component_b")) & (F.col("least_a") <= F.col("most_b")) & (100 * F.col("most_a") >= PERCENT * F.col("least_b"))
        & (both * F.least("reach_a", "reach_b") >= PERCENT * (F.col("least_a") + F.col("least_b")))
    ).select("shingle", "component_a", "component_b").distinct()
    pairs = met.join(side(rows.filter("lesser = 1"), "a"), ["shingle", "component_a"]).join(side(rows, "b"), ["shingle", "component_b"]).filter(
        (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (both * F.least("reach_a", "reach_b") >= PERCENT * (F.col("n_a") + F.col("n_b")))
    )
    swap = F.col("rep_a") > F.col("rep_b")
    out = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), F.when(swap, F.col("component_b")).otherwise(F.col("component_a")).alias("ca"),
                       F.when(swap, F.col("component_a")).otherwise(F.col("component_b")).alias("cb")).distinct()
    out = settle(out, "exact")
    discard(own, rows, groups)
    return out


def _joined(held: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with further links (a, b)."""
    if links.isEmpty():
        discard(links)
        return held
    # The graph of components has an edge for each two that a link joins; nodes without links so far are components of their own.
    own = held.select(F.col("node").alias("_node"), "component")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(own, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"))
    ends = settle(ends, "ends")
    named = links.select("a", "b")
    for end in ("a", "b"):
        named = named.join(ends.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end)
    joined = components(named.select(F.col("ca").alias("u"), F.col("cb").alias("v")))
    every = held.select("node", "component").union(ends.join(held, "node", "left_anti").select("node", "component"))
    root = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = settle(every.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
    discard(links, held, ends, joined)
    return out


def _apart(pairs: DataFrame, held: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """pairs with ca and cb, the components of a and b, where these differ; and ``both``, whether both are marked (rep)."""
    named = held.select(F.col("node").alias("rep"), "component")
    named = named.withColumn("in", F.lit(False)) if marked is None else named.join(marked.select("rep", F.lit(True).alias("in")), "rep", "full")
    for side in ("a", "b"):
        own = named.select(F.col("rep").alias(side), F.col("component").alias(f"c{side}"), F.col("in").alias(f"in_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    both = F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False))
    return pairs.withColumn("both", both).drop("in_a", "in_b").filter("ca <> cb")


def _still_open(members: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """rep of the members (key, rep) of more than ``most`` regions that hold several components."""
    named = members.select("key", "rep").distinct().join(held.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    return named.join(mixed, "key", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("rep")


def _deeper(level: int, dense: DataFrame, held: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that are left after a forest of FORESTS, and components with the links that it found."""
    named = dense.join(held.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    crowd = texts.join(named, F.col("_id") == F.col("rep")).select("rep", "_text", "component")
    forest = crowd.mapInArrow(partial(_plant_deep, level), "key long, s0 long, k1 long, k2 long, k3 long, rep long, component long")
    order = ["key", "s0", "rep"]
    found = settle(forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND), "deeper")
    pairs = _apart(found.filter("b IS NOT NULL").select("a", "b").distinct(), held).select("a", "b")
    held = _joined(held, settle(_links(pairs, texts), "links"))
    left = settle(_still_open(found.filter("b IS NULL").select("key", F.col("a").alias("rep")), held, FORESTS[level][2]), "dense")
    discard(found, dense)
    return left, held


def _exact_pass(dense: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """Components with the links that dense members miss: one pair of each two components first, then all that are still apart."""
    if dense.isEmpty():
        return held
    pairs = _exact_pairs(dense, held, texts)
    first = pairs.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    held = _joined(held, settle(_links(first, texts), "links"))
    held = _joined(held, settle(_links(_apart(pairs.select("a", "b"), held).select("a", "b"), texts), "links"))
    discard(pairs)
    return held


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that full shingle sets confirm. Texts are joined to pairs by id; a class has a bounded number of candidates."""
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("text_a"))
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("text_b"))
    # b first, so that rows come sorted by a and its set is made once.
    return pairs.join(right, "b").join(left, "a").mapInArrow(_confirm, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Null and empty texts and texts without words have no shingles and are components of their own. Copies (equal sets)
    are linked through their class. Repeated rows all appear. Rows with a null id are reported with a null component,
    are linked with nothing and are kept. Ids are integers. Empty tables give empty results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = settle(rows.mapInArrow(_describe, "doc_id long, n_shingles long, digest binary, signature binary"), "signatures")
    used = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settle(used.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    forest = classes.select("rep", "signature").mapInArrow(_plant, ", ".join(f"{c} long" for c in ("key", *_NEXT, "k1", "k2", "k3", "rep")))
    order = ["key", *_NEXT, "rep"]
    found = settle(forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND), "neighbours")
    pairs = settle(found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")
    members = found.filter("b IS NULL").select("key", F.col("a").alias("rep"), "k1", "k2", "k3").distinct()
    texts = rows.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    # An id that occurs with several texts stands for each of them; its pairs are confirmed for every combination.
    either = pairs.select("a", "b", "agree", F.col("a").alias("of"), F.col("b").alias("other")).union(pairs.select("a", "b", "agree", F.col("b"), F.col("a")))
    best = Window.partitionBy("of")
    first = (
        either.withColumn("r", F.row_number().over(best.orderBy(F.desc("agree"), "other"))).withColumn("least", F.min("other").over(best))
        .filter((F.col("r") <= 2) | (F.col("other") == F.col("least"))).select("a", "b").distinct()
    )
    links = settle(_links(first, texts), "links")
    held = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Hub pairs close most dense regions; pairs of two members with many open ones are left to what follows.
    by_hubs = settle(_links(_hub_pairs(members, links, held).distinct(), texts), "links")
    discard(links)
    held = _joined(held, by_hubs)
    left = settle(_still_open(members.select("key", "rep").distinct(), held, OPEN), "dense")
    held = _joined(held, settle(_links(_apart(pairs.select("a", "b"), held, left).filter("NOT both").select("a", "b"), texts), "links"))
    discard(pairs, found)
    for level in range(len(FORESTS)):
        if not left.isEmpty():
            left, held = _deeper(level, left, held, texts)
    held = _exact_pass(left, held, texts)
    discard(left)
    named = classes.select("digest", "rep").join(held.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component"))
    on = (F.col("digest") == F.col("_digest")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = described.select("doc_id", "n_shingles", "digest").join(named, on, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS nw, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM d),
f AS (SELECT doc_id, nw, i, w1 || coalesce(' ' || lead(w1, 1) OVER x, '') || coalesce(' ' || lead(w1, 2) OVER x, '')
        || coalesce(' ' || lead(w1, 3) OVER x, '') || coalesce(' ' || lead(w1, 4) OVER x, '') AS g
      FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, g FROM f WHERE i <= greatest(nw - 4, 1)),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id),
q AS (SELECT *, count(*) OVER (PARTITION BY g) AS often FROM e),
r AS (SELECT q.*, n.n, row_number() OVER (PARTITION BY q.doc_id ORDER BY often, q.g) AS place FROM q JOIN n ON n.doc_id = q.doc_id),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id
      WHERE x.place <= x.n * 0.15 + 1 AND y.place <= y.n * 0.15 + 1 AND least(x.n, y.n) >= 0.85 * greatest(x.n, y.n)),
l AS (SELECT a, b FROM p JOIN e x ON x.doc_id = p.a JOIN e y ON y.doc_id = p.b AND y.g = x.g JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      GROUP BY a, b, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
t AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
c(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.u, t.v FROM c JOIN t ON t.u = c.v),
m AS (SELECT u, min(v) AS component_id FROM c GROUP BY u)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.u = n.doc_id
"""
