"""Matching of many names against plain containment."""

import random

from pyspark.sql import functions as F

from tidemark.operators import matching


def matched(spark, texts, names, gram=4):
    left = spark.createDataFrame(texts, "id long, a string, b string, gram string, n long")
    right = spark.createDataFrame(names, "name string, code int")
    out = matching.contains_join(left, right, ["a", "b"], gram=gram)
    assert out.columns == ["id", "a", "b", "gram", "n", "name", "code"]
    return sorted(((r["id"], r["name"], r["code"]) for r in out.collect()), key=str)


def plain(texts, names):
    return sorted(((t[0], n, c) for t in texts for n, c in names if n is not None and (n in (t[1] or "") or n in (t[2] or ""))), key=str)


def test_five_thousand_names(spark):
    r = random.Random(2)
    word = lambda k: "".join(r.choice("abcdeé한🎉 ") for _ in range(k))
    texts = [(i, word(r.randint(0, 120)), r.choice([None, "", word(30)]), None, 1) for i in range(300)] + [(7, "abcd" * 400, None, None, 1)] * 2
    names = [(word(r.choice([1, 2, 3, 4, 5, 6, 8, 11])), i % 3) for i in range(5000)] + [(None, 1), ("abcdabcdabcd", 1), ("abcdabcdabcd", 1)]
    want = plain(texts, names)
    assert len(want) > 10_000 and matched(spark, texts, names) == want
    assert matched(spark, texts, names, gram=2) == want


def test_hard_names(spark):
    texts = [(1, None, None, None, 1), (2, "", "x", None, 1), (3, "a.c", None, None, 1), (None, "abcdef", "abc", None, 1)]
    for names in ([("", 1)], [("", 1), ("abcde", 2), (".", 3), ("abcde", 2)], [(None, 1)], [("none of them", 1)], []):
        assert matched(spark, texts, names) == plain(texts, names)
    assert matched(spark, [], [("abc", 1)]) == []


def test_no_nested_loop(spark):
    """Equalities all the way, also where both sides are too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.range(1000).select("id", F.concat(F.lit("name "), "id").alias("text"))
        out = matching.contains_join(texts, texts.select(F.col("text").alias("name")), ["text"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_texts_are_never_broadcast(spark, tmp_path):
    """A small file of repeated texts: Spark takes them for few, and their grams for as few."""
    path = str(tmp_path / "texts")
    spark.range(20_000).select("id", F.concat(F.lit("tide mark of sand "), F.col("id") % 7).alias("text")).coalesce(1).write.parquet(path)
    texts = spark.read.parquet(path)
    few = spark.createDataFrame([("mark", 1), ("sand 3", 2), ("rock", 3)], "name string, code int")
    many = few.unionByName(spark.range(200).select(F.concat(F.lit("none "), "id").alias("name"), F.col("id").cast("int").alias("code")))
    for names in (few, many):
        out = matching.contains_join(texts, names, ["text"])
        assert out.count() == 20_000 + sum(i % 7 == 3 for i in range(20_000))
        plan = out._jdf.queryExecution().executedPlan().initialPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(plan):
            if "BroadcastExchange" in line:
                below = [x for x in plan[i + 1 :]]
                end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
                # What is broadcast ends in an aggregate or in the names themselves.
                top = next(x for x in below[:end] if any(k in x for k in ("Aggregate", "FileScan", "Scan ExistingRDD", "LocalTableScan", "Range", "Union")))
                assert "FileScan" not in top, line


def test_few_names_in_one_pass(spark):
    """Texts are not cut into grams for a few names; both ways give the same rows."""
    texts = [(1, None, None, None, 1), (2, "", "x", None, 1), (3, "a.c", "é🎉 name", None, 1), (None, "abcdef", "abc", None, 1), (None, "abcdef", "abc", None, 1)]
    left = spark.createDataFrame(texts, "id long, a string, b string, gram string, n long")
    for names in ([("", 1)], [("", 1), ("abcde", 2)], [(".", 3), ("abcde", 2), ("abcde", 4), ("🎉 n", 5)], [(None, 1)], [("none of them", 1)], []):
        right = spark.createDataFrame(names, "name string, code int")
        one, other = (matching.contains_join(left, right, ["a", "b"], direct=k) for k in (128, -1))
        rows = lambda df: sorted(((r["id"], r["name"], r["code"]) for r in df.collect()), key=str)
        assert rows(one) == rows(other) == plain(texts, names)
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and plan.count("Generate") <= 1


def test_many_names_cut_no_strings(spark):
    """More names than are tested directly: texts are not cut into strings by Spark, and only names' grams leave the tasks."""
    texts = spark.range(300).select("id", F.concat(F.lit("tide mark é🎉 of sand "), "id").alias("text"))
    names = spark.createDataFrame([(f"sand {i}", i) for i in range(200)] + [("é🎉", 200), ("none", 201), ("", 202)], "name string, code int")
    out = matching.contains_join(texts, names, ["text"])
    want = sum(f"sand {n}" in f"sand {i}" for n in range(200) for i in range(300)) + 2 * 300
    assert out.count() == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "transform(" not in plan and "Generate" not in plan


def test_bytes_that_are_not_utf8(spark):
    """A name stands beside bytes that are no text."""
    texts = spark.createDataFrame([(1, bytearray(b"\xe2\x82sand\xff")), (2, bytearray(b"\xffsan\xff"))], "id long, b binary").selectExpr("id", "cast(b AS string) AS text")
    names = spark.createDataFrame([("sand", 1), ("rock", 2)], "name string, code int")
    for direct in (128, -1):
        assert [r.id for r in matching.contains_join(texts, names, ["text"], direct=direct).select("id").collect()] == [1]


def test_hashes_of_pieces(monkeypatch):
    """A long text's pieces overlap, so that no substring is lost."""
    text = "tide mark é🎉 of sand".encode()
    whole = {size: {int(x) for h in matching._hashes(text, size) for x in h} for size in range(6)}
    assert [len(whole[size]) for size in range(6)] == [len({text.decode()[i : i + size] for i in range(21 - size)}) for size in range(6)]
    monkeypatch.setattr(matching, "PIECE", 3)
    assert whole == {size: {int(x) for h in matching._hashes(text, size) for x in h} for size in range(6)}
