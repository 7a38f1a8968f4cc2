"""Edge cases and brute-force comparisons of periodic runs, language identification and hard negatives."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, language_id, periodic_runs

RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, runs string, n_words string, vec_id long, score string"


def plain_runs(w):
    """Every lag, every stretch, every smaller period."""
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(24, 3 * q) and not any(all(w[j] == w[j + r] for j in range(s, s + n - r)) for r in range(1, q)):
                out.add((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def run_texts(count=260, seed=4):
    r = random.Random(seed)
    out = []
    for t in range(count):
        n = r.randint(0, 300)
        w = [str(r.randrange(r.choice([1, 2, 3, 40]))) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 10:
                p, a = r.randint(1, n // 3), r.randrange(n)
                for i in range(a, r.randint(a + 1, n)):
                    w[i] = w[a + (i - a) % p]
                w[r.randrange(n)] = r.choice(["x", w[0]])
        if t % 7 == 0:
            unit = [str(r.randrange(3)) for _ in range(r.randint(1, 9))] * r.randint(2, 5) + ["z"] * r.randint(0, 2)
            w = unit * r.randint(2, 6)
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "x", 7, "x") for i, t in rows], CLASH)


def test_runs_equal_plain_search(spark):
    rows = list(enumerate(run_texts())) + [(None, "a b " * 20), (None, None), (1000, None), (1001, ""), (1002, " \n"), (1003, "é\xa0z " * 30), (5, "again"), (5, "again"), (-5, "u v w " * 9)]
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in periodic_runs.periodic_runs(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)


def test_runs_of_long_texts_and_every_scale(spark):
    """Periods from 1 to thousands, each with exactly three periods and one word less, in texts of many thousand words."""
    r = random.Random(9)
    rows, want = [], []
    for i, q in enumerate([1, 2, 7, 8, 9, 12, 13, 18, 19, 100, 1000, 2999, 6000]):
        unit = [f"u{r.randrange(10**9)}" for _ in range(q)]
        size = max(24, 3 * q)
        for less in (0, 1):
            rows.append((2 * i + less, " ".join(["before", *(unit * size)[: size - less], "after"])))
            want.append([] if less else [(1, size, q)])
    found = {x["doc_id"]: [(y["start"], y["length"], y["period"]) for y in x["runs"]] for x in periodic_runs.find_runs(documents(spark, rows)).collect()}
    assert [found[i] for i in range(len(want))] == want


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(documents(spark, [])).collect() == []


def tongue(seed, letters):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(150)]


TONGUES = {"aa": tongue(1, "abcdefgh"), "bb": tongue(2, "efghijklm"), "cc": tongue(3, "klmnopabe")}


def language_rows(n=240, seed=5):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(TONGUES[lang]) for _ in range(r.randint(5, 60))), lang) for i in range(n) for lang in [r.choice(list(TONGUES))]]


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", "x", 7, "x") for i, t, lang in rows], CLASH)


def test_languages_of_held_out_rows(spark):
    rows = language_rows()
    docs = labelled(spark, rows)
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_of_hard_rows(spark):
    docs = labelled(spark, language_rows())
    model = language_id.fit(docs)
    hard = [(None, "no id", None), (1, None, "aa"), (2, "", "aa"), (3, "12 3.4 ²_!", None), (4, "日本" * 3000, None), (5, TONGUES["bb"][0] * 2000, None), (6, " ".join(TONGUES["cc"]), None), (6, " ".join(TONGUES["cc"]), None)]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(labelled(spark, hard), model).collect()]
    assert [g[:2] for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == len(hard)
    assert got[-1] == got[-2] and got[-1][1] == "cc" and all(g[1] in TONGUES for g in got[:1] + got[4:])
    assert language_id.predict(docs.limit(0), model).collect() == []
    empty = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_language_model_learns_from_training_rows_only(spark):
    docs = labelled(spark, language_rows())
    other = docs.withColumn("lang", F.when(language_id.training(), F.col("lang")).otherwise("zz"))
    a, b = language_id.fit(docs), language_id.fit(other)
    assert a.langs == b.langs and a.words == b.words and np.array_equal(a.word_rows, b.word_rows)


def test_backoff_goes_to_shorter_grams():
    """A plain version of the score of unseen words, in whole and with a cache of no size."""
    langs = ["x", "y"]
    counts = lambda d: {k: np.array(v, float) for k, v in d.items()}
    sizes = [counts({"a": (3, 1), "b": (1, 9), " ": (4, 4)}), counts({"ab": (5, 1), "bc": (0, 2)}), counts({"abc": (1, 2), " ab": (2, 0)}), {}, {}]
    model = language_id.Model(langs, counts({"known": (4, 2)}), sizes)

    def plain(word):
        for size in range(5, 0, -1):
            known = [g for g in (f" {word} "[i : i + size] for i in range(len(word) + 3 - size)) if g in sizes[size - 1]]
            if known:
                totals = sum(sizes[size - 1].values())
                return [sum(math.log((sizes[size - 1][g][i] + 0.5) / (totals[i] + 0.5 * len(sizes[size - 1]))) for g in known) / len(known) for i in range(2)]
        return [0.0, 0.0]

    words = ["abc", "ab", "bcb", "zzab", "q", "b", "a" * 300]
    assert np.allclose(model.unseen(words), [plain(w) for w in words])
    first = language_id.identify(language_id.Scorer(model), [" ".join(words), "known abc", "q"])
    small = language_id.Scorer(model)
    small.held = 10**12
    assert first == [language_id.identify(small, [t])[0] for t in (" ".join(words), "known abc", "q")]


def plain_negatives(rows):
    ok = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for r in sorted(ok, key=lambda r: (r[1], r[2]), reverse=True):
        if r[0] % 50 == 0:
            anchors[r[0]] = r
    out = []
    for a in anchors.values():
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in ok if r[0] != a[0])
        for p, i, _ in [s for s in scored if s[2] == a[1]][:5]:
            fit = [s for s in scored if s[2] != a[1] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], i, k, s[1], -p, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], "vec_id long, embedding array<float>, label int, vector string, score long, block string")


def mined(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_negatives_equal_full_comparison(spark, monkeypatch, spread):
    """Clusters, ties (coarse values, copies), a hot label, negative scores; many blocks, groups and shares."""
    for name, value in (("BLOCK_VALUES", 600), ("SHARE_BLOCKS", 2), ("GROUP_ANCHORS", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(3)
    centres = r.normal(0, 0.3, (10, 20))
    rows = []
    for i in range(1000):
        label = 1 if i % 3 == 0 else int(r.integers(10))
        v = np.round(centres[label if r.random() < 0.7 else int(r.integers(10))] + r.normal(0, spread * 0.3, 20), int(r.integers(1, 6))).astype(np.float32)
        rows.append((i, [float(x) for x in v], label))
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(0, 100, 10)] + [rows[51], rows[51], rows[100]]
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(hard_negatives.hard_negatives(vectors(spark, rows))) == want


def test_negatives_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (100, None, 1), (150, [1.0, None], 1), (200, [nan, 1.0], 1), (250, [1.0, inf], 1), (300, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
            (1, [0.9], 3), (2, [0.7, 0.2], 4), (3, [], 1), (4, [1.0, 0.5, 9.0], 2), (5, [-1.0, -1.0], 2), (350, [], 1), (400, [0.0, 0.0], 1), (0, [1.0, 0.5], 2)]
    assert mined(hard_negatives.hard_negatives(vectors(spark, rows))) == plain_negatives(rows) != []
    assert mined(hard_negatives.hard_negatives(vectors(spark, []))) == []
    assert mined(hard_negatives.hard_negatives(vectors(spark, [(50, [1.0], 1)]))) == []


def test_scan_drops_candidates_before_the_last_dimension():
    """The bounds shrink the bitmap: few candidates are left in the last steps, and what is left has exact scores."""
    r = np.random.default_rng(1)
    x = r.integers(-50, 50, (4000, 64))
    x[:, 16:] //= 25
    anchor = r.integers(-50, 50, 64)
    anchor[16:] //= 25
    block = hard_negatives.Block(np.arange(4000, dtype="<i8").tobytes(), np.zeros(4000, "<i8").tobytes(), [c.astype("<i2").tobytes() for c in x.T], x.min(axis=0).tolist(), x.max(axis=0).tolist())
    seen = []

    def alive(low, high, rows):
        seen.append(len(rows))
        return high >= np.partition(low, len(low) - 5)[len(low) - 5]

    rows, score = hard_negatives.scan(block, anchor, np.arange(4000), alive)
    assert seen[0] == 4000 and seen[-1] < 400 and np.array_equal(score, x[rows] @ anchor)
    assert set(np.argsort(-(x @ anchor))[:5]) <= set(rows)


def test_pieces_of_texts_without_blanks(spark):
    """Long runs go through windows: Han letters, random letters, one letter, marks, against the model's own library."""
    import sentencepiece

    tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm import sentence_pieces

    path = tokenizers.path("piece_bpe_32k.model")
    own, known, r = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Encoder(path), random.Random(8)
    runs = ["".join(r.choice(alphabet) for _ in range(n)) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "a", "=", "-=", "的一是不了人我在有", "日本語\U0001f389é") for n in (255, 256, 257, 448, 449, 5000, 30_000)]
    runs += ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)), "x" * 300 + " " + "ab" * 400 + "\n" + "é" * 700]
    for text, ids in zip(runs, known.encode(runs)):
        assert np.array_equal(np.frombuffer(ids, "<u4"), own.encode(text)), text[:20]
    assert max(map(len, known)) <= 64


def test_pairs_beside_each_other_equal_merging():
    """The walk over both pieces' merges against merging the joined text, on random vocabularies with ties."""
    from tidemark.llm.sentence_pieces import Pieces

    r = random.Random(6)
    for _ in range(40):
        names = list({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60)} | set("abc"))
        p = Pieces(names, [float(-r.randrange(r.choice([5, 1000]))) for _ in names], True)
        for _ in range(300):
            a, b = r.choice(names), r.choice(names)
            assert p.beside_each_other(a, b) == (p.merged(a + b) == [a, b]), (a, b)
            assert p.beside_each_other("", b) == (p.merged(b) == [b])


def test_word_caches_are_bounded_by_bytes(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm import packing, quality, sentence_pieces, shingles

    r = random.Random(3)
    lines = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(400)) for _ in range(300)]
    size = lambda cache: sum(4 * len(w) + 200 for w in cache)
    for known in (packing.Encoder(tokenizers.path("word_bpe_49k.json"), 20_000), sentence_pieces.Encoder(tokenizers.path("piece_bpe_32k.model"), 20_000)):
        first = known.encode(lines[:5])
        for i in range(0, 300, 10):
            known.encode(lines[i : i + 10] + [" ".join(f"w{i}x{j}" for j in range(20))])
            assert size(known) + size(getattr(known, "chunks", ())) < 60_000
        assert known.encode(lines[:5]) == first
    for module in (shingles, quality):
        monkeypatch.setattr(module, "CACHE_BYTES", 20_000)
    words, reader = shingles._Words(), quality.Reader()
    for i in range(2000):
        for cache, w in ((words, b"%d" % i), (words, b"x" * 100_000 + b"%d" % i), (reader, f"w{i}"), (reader, "x" * 1000 + str(i))):
            assert cache[w] == cache[w]
        assert size(words) < 60_000 and size(reader) < 60_000


def test_secrets_of_texts_with_many_hits(spark):
    from tidemark.llm import secrets

    unit, n = " secret=abcdefgh1 ", 100_000
    docs = documents(spark, [(1, unit * n), (2, "é" + unit * 3 + "token:short AKIA" + "A" * 16 + " " + "0a" * 16)])
    many, few = sorted(secrets.secret_scan(docs).collect(), key=lambda x: x["doc_id"])
    assert many["n_assign"] == n and many["spans"] == ",".join(f"assign:{18 * i + 1}:{18 * i + 17}" for i in range(n))
    assert few["spans"] == "assign:2:18,assign:20:36,assign:38:54,access:67:87,hex:88:120"
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(docs).collect()}
    assert clean[1] == " [assign] " * n and clean[2] == "é" + " [assign] " * 3 + "token:short [access] [hex]"


def test_redaction_of_overlapping_spans(spark):
    """Against a plain walk over the spans."""
    from tidemark.llm import secrets

    r = random.Random(5)
    parts = ["password=", "AKIA" + "Z" * 16, "0123456789abcdef" * 2, " ", "ghp_" + "a1" * 20, "é", "\n", "secret: 'abcdefgh' ", "xoxb-123456789012", "."]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(200)]
    docs = documents(spark, rows)
    found = {x["doc_id"]: x["spans"] for x in secrets.secret_scan(docs).collect()}
    for x in secrets.redact(docs).collect():
        text, at, out = dict(rows)[x["doc_id"]], 0, ""
        for kind, a, b in (s.split(":") for s in filter(None, found[x["doc_id"]].split(","))):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        assert x["text"] == out + text[at:] and x["n_chars"] == len(x["text"])


def blocks(n, seed=1):
    """Texts of 12 of 30 common blocks, every tenth with a copy of a few changed words."""
    r = random.Random(seed)
    common, rows = [" ".join(f"b{i}w{j}" for j in range(9)) for i in range(30)], []
    for i in range(n):
        rows.append(" ".join(common[k] for k in r.sample(range(30), 12)))
        if i % 10 == 0:
            w = rows[-1].split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = f"changed{r.randrange(10**6)}"
            rows.append(" ".join(w))
    return rows


def linked(texts):
    """Components over all pairs that share a rare shingle, which every link does."""
    from collections import Counter, defaultdict

    from tidemark.llm.lsh_forest import shingle_hashes

    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    often, held, parent = Counter(h for s in sets for h in s), defaultdict(list), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda h: (often[h], h))[: len(s) * 15 // 100 + 1]
        for j in {j for h in rare for j in held[h]}:
            both = len(s & sets[j])
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for h in rare:
            held[h].append(i)
    return [root(i) for i in range(len(texts))]


def test_near_dedup_of_common_blocks(spark, monkeypatch):
    """Texts of common passages part in the deeper forest: none of them takes the exact pass, whose work grows with the square."""
    from tidemark.llm import lsh_forest

    texts, sent = blocks(3000), []
    exact = lsh_forest._exact_pass
    monkeypatch.setattr(lsh_forest, "_exact_pass", lambda dense, *a: (sent.append(dense.count()), exact(dense, *a))[1])
    docs = documents(spark, list(enumerate(texts))).repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_dedup(docs).collect()}
    want = linked(texts)
    assert sent[0] < 30 and len(set(want)) < len(texts) - 100 and [got[i] for i in range(len(texts))] == want


def test_packing_pads_little(spark):
    """A sequence is as long as a power of two or padded to 2048; the padding is a small share of all ids."""
    from collections import Counter

    tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm import packing

    r = random.Random(12)
    rows = [(i, " ".join(r.choice(["tide", "mark", "of", "sand"]) for _ in range(int(2 ** r.uniform(0, 12.5))))) for i in range(400)]
    sizes = Counter()
    for x in packing.pack(documents(spark, rows).repartition(2), tokenizers.path("word_bpe_49k.json")).collect():
        sizes[x["sequence_id"]] += x["length"]
    total = sum(sizes.values())
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in sizes.values())
    assert total > 200_000 and padded - total < 0.01 * total and len(sizes) <= total // 2048 + 30


def test_archives_of_long_pages(spark):
    from tidemark.llm import warc

    html = "<p>" + "long é " * 300_000
    pages = spark.createDataFrame([(7, "http://a.example/", html), (3, "http://b.example/", html), (1, "http://c.example/", None)], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in warc.archive_pages(pages).collect()}
    data = html.encode()
    assert got[7]["payload_bytes"] == got[3]["payload_bytes"] == len(data) and got[7]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert (got[3]["record_type"], got[7]["record_type"], got[7]["refers_to"], got[1]["payload_bytes"]) == ("response", "revisit", 3, 0)


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_small_and_large_graphs(spark, monkeypatch, small):
    """One task's union and the stars, and further links over components, against a plain search."""
    from tidemark.llm import components, lsh_forest
    from tidemark.llm.common import settle

    monkeypatch.setattr(components, "SMALL", small)
    r = random.Random(4)
    first, more = ([(r.randrange(300), r.randrange(300)) for _ in range(n)] for n in (120, 60))
    first += [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]

    def plain(edges):
        least = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(len(least)):
            changed = False
            for a, b in edges:
                if a != b and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
            if not changed:
                return least
        return least

    held = components.components(spark.createDataFrame(first, "u long, v long"))
    assert {x["node"]: x["component"] for x in held.collect()} == plain(first)
    links = settle(spark.createDataFrame([e for e in more if e[0] != e[1]], "a long, b long"), "links")
    assert {x["node"]: x["component"] for x in lsh_forest._joined(held, links).collect()} == plain(first + more)


def test_columns_are_encoded_like_texts():
    """Parts that are new, known, rare, long and foreign, in slices and after the cache was dropped, against the library."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm import packing

    path, r = tokenizers.path("word_bpe_49k.json"), random.Random(9)
    some = ["tide", "Mark's", "d'été", "ßÀÿ§´", "x²", "12a3!!", "日本", "<|endoftext|>", "a" * 90, "­¡", "ſ", "l'ŒUVRE,", "a b"]
    texts = [None, "", " \n", *[r.choice(["", " "]) + r.choice([" ", "\n\t"]).join(r.choice([*some, f"w{r.randrange(50)}"]) for _ in range(30)) for _ in range(40)]]
    texts += [" ".join(r.choice(["tide", "éa", "of,", "x1"]) for _ in range(30)) for _ in range(20)]
    plain, known = Tokenizer.from_file(path), packing.Encoder(path, 20_000)
    for kind, most in ((pa.string(), 700), (pa.large_string(), 10**6), (pa.string(), 1)):
        got = []
        for part in packing.slices(pa.array(["cut off", *texts], kind).slice(1), most):
            ids, ends = known.encode_column(part)
            got += [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_last_bins_are_not_padded():
    import zlib

    from tidemark.llm import packing

    r, pool, pieces = random.Random(3), packing.Pool(2048), {}
    for i in range(40):
        ids = r.randbytes(4 * r.randint(900, 2047))
        pieces[i] = ids
        pool.add((i, 0, len(ids) // 4, zlib.crc32(ids), len(ids) // 4, ids))
    bins = list(pool.bins(0))
    sizes = [sum(p[2] for p in b) for b in bins]
    assert all(n & (n - 1) == 0 for n in sizes) and len(sizes) <= sum(sizes) // 2048 + 11 and pool.size == 0
    for i, ids in pieces.items():
        own = sorted((p for b in bins for p in b if p[0] == i), key=lambda p: p[1])
        assert b"".join(p[5] for p in own) == ids and all(p[3] == zlib.crc32(p[5]) and len(p[5]) == 4 * p[2] for p in own)
        assert [p[1] for p in own] == [sum(q[2] for q in own[:k]) for k in range(len(own))]
