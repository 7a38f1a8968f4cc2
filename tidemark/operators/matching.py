"""Matching names in texts (J6, T13): a few in one pass over the texts, many by an index of q-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an indexed gram; names that are shorter are grams themselves.
GRAM = 4
#: Names tested directly: how many, of how many characters, in how many rows.
DIRECT, NAME_LENGTH, ROWS = 128, 200, 1000
#: Grams of all names that are broadcast.
GRAMS = 200_000
#: Characters or grams that a Python worker takes at once; factor of the grams' hash, an odd number of 64 bits.
PIECE, FACTOR = 1 << 20, np.uint64(0x9E3779B97F4A7C15)
#: All but the first 22 bits of a hash.
SHIFT = np.uint64(42)


def _hashes(cell: bytes, size: int, known: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Hashes of a text's substrings of ``size`` characters, of long texts piece by piece; each byte that is not UTF-8 counts as a character.

    ``known``: marks by a hash's first bits; only marked ones are returned.
    """
    chars = np.frombuffer(cell.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
    for start in range(0, max(len(chars) - size + 1, 0) if size else 1, PIECE):
        part = chars[start : start + PIECE + size - 1].astype(np.uint64)
        out = np.full(len(part) - size + 1 if size else 1, size, np.uint64)
        for j in range(size):
            out = out * FACTOR + part[j : j + len(out)]
        out = (out ^ out >> np.uint64(32)) * FACTOR  # the last character reaches the first bits
        yield np.unique(out if known is None else out[known[out >> SHIFT]])


def _grams(rows: DataFrame, key: str, cells: list[Column], sizes: Column, known: np.ndarray | None = None) -> DataFrame:
    """``key`` of each row with the distinct hashes of its cells' substrings of the given sizes; made in numpy, since Spark makes a string of each.

    With ``known`` hashes, of the others only those are returned that share the first bits with one of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None
        if known is not None:
            marks = np.zeros(1 << 64 - int(SHIFT), bool)
            marks[known.view(np.uint64) >> SHIFT] = True
        for batch in batches:
            row, grams, n = [], [], 0
            for i in range(batch.num_rows):
                own = [h for size in batch["sizes"][i].as_py() for c in batch.columns[2:] for h in _hashes(c[i].as_py(), size, marks)]
                grams.append(np.unique(np.concatenate(own)) if len(own) > 1 else own[0] if own else np.empty(0, np.uint64))
                row.append(np.full(len(grams[-1]), i))
                n += len(grams[-1])
                if n >= PIECE or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(np.concatenate(row))), pa.array(np.concatenate(grams).view(np.int64))], names=[key, "gram"])
                    row, grams, n = [], [], 0

    taken = rows.select(key, sizes.alias("sizes"), *[c.cast("binary").alias(f"c{i}") for i, c in enumerate(cells)])
    return taken.mapInArrow(cut, f"{key} {dict(rows.dtypes)[key]}, gram bigint")


def contains_join(texts: DataFrame, names: DataFrame, columns: list[str], name: str = "name", gram: int = GRAM, direct: int = DIRECT) -> DataFrame:
    """Each text with every row of ``names`` whose name one of its columns contains.

    Up to ``direct`` names are tested in one pass over the texts, which are neither cut into grams nor shuffled; only the few
    names are broadcast. More names are found by their grams (``_by_grams``). Null names match nothing, an empty name every
    text, null texts count as empty. Repeated rows of either side are each matched.
    """
    each = names.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # Of names that are too many or too long only so much reaches the driver.
    few = each.select(F.substring("name", 1, NAME_LENGTH + 1).alias("name"), "n").limit(direct + 1).collect()
    if len(few) > direct or sum(r.n for r in few) > ROWS or any(len(r.name) > NAME_LENGTH for r in few):
        return _by_grams(texts, names, columns, name, gram)
    known = F.array(*[F.lit(r.name) for r in few]).cast("array<string>")

    def hits(cells: Column) -> Column:
        return F.filter(known, lambda n: functools.reduce(Column.__or__, [F.contains(cells[f"c{i}"], n) for i in range(len(columns))]))

    # A transform over an array of one binds the cells, so that each is made once and not once a name; an inner explode would test twice.
    cells = F.struct(*[_cell(c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = texts.withColumn("_name", F.explode_outer(F.flatten(F.transform(F.array(cells), hits)))).filter(F.col("_name").isNotNull())
    return _columns(found, F.broadcast(names), F.col("_t._name") == F.col(f"_s.{name}"), texts, names)  # at most ROWS rows


def _cell(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _columns(left: DataFrame, right: DataFrame, test: Column, texts: DataFrame, names: DataFrame) -> DataFrame:
    return left.alias("_t").join(right.alias("_s"), test).select(*[F.col(f"_t.`{c}`") for c in texts.columns], *[F.col(f"_s.`{c}`") for c in names.columns])


def _by_grams(texts: DataFrame, names: DataFrame, columns: list[str], name: str, gram: int) -> DataFrame:
    """The texts' grams meet the names' grams by equality, once to count how many texts hold each and once with the rarest gram
    of each name, and what meets is tested. Only hashes of texts and grams take part; whole texts meet the names found for
    their hash at the end, where the test is made, so equal hashes do no harm.

    Spark guesses the size of exploded rows from the file's, which is too low by far; so texts and their grams are hinted to be
    merged, never broadcast, and names are broadcast only where they were counted to be few.
    """
    key = F.xxhash64(*[_cell(c) for c in columns])
    length = F.least(F.length("name"), F.lit(gram))
    known = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    counts = {r.size: r.n for r in known.groupBy(length.alias("size")).agg(F.sum(F.greatest(F.length("name"), F.lit(1))).alias("n")).collect()}  # at most gram + 1 numbers
    sizes = sorted(counts) or [gram]
    side = "broadcast" if sum(counts.values()) <= GRAMS else "merge"
    each = _grams(known, "name", [F.col("name")], F.array(length))
    # Few grams (at most GRAMS numbers) are known to the tasks that cut texts, so that other grams never leave them.
    marked = each.select("gram").distinct().toArrow()["gram"].to_numpy() if side == "broadcast" else None
    grams = _grams(texts.withColumn("_key", key), "_key", [_cell(c) for c in columns], F.array(*map(F.lit, sizes)), marked)
    occurring = grams.join(each.select("gram").distinct().hint(side), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # Of each name the gram that the fewest texts hold. A name with a gram that none holds occurs nowhere.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")
    index = each.join(occurring.hint(side), "gram", "left").groupBy("name").agg(rarest).filter("rarest.n > 0").select("name", "rarest.gram")
    candidates = grams.join(index.hint(side), "gram").select("_key", F.col("name").alias("_name")).distinct()
    # Rows of names join before the texts, which are shuffled once.
    wanted = candidates.join(names.withColumn("_of", F.col(name)).hint("merge"), F.col("_name") == F.col("_of")).drop("_of").hint("merge")
    test = functools.reduce(Column.__or__, [F.contains(F.coalesce(F.col(f"_t.`{c}`").cast("string"), F.lit("")), F.col("_s._name")) for c in columns])
    return _columns(texts.withColumn("_key", key), wanted, (F.col("_t._key") == F.col("_s._key")) & test, texts, names)
