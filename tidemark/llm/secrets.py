"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds one row per blob, rule
and rule version that has been scanned, with the spans found; it is a folder of Parquet files that runs append to. A run
scans only blobs with pairs that the ledger lacks and joins the findings back to all paths. A run without a ledger scans
every row where it stands, copies too: that shuffles digests and spans, while picking one copy would shuffle all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_path, text_or_empty

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``needles``: text in lower case of which a hit holds at least one (none: always search). ``group`` and ``least``: the
    capture and its least length, tested after matching, so that a failing match still uses up its characters."""

    name: str
    pattern: str
    needles: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    version: int = 1


#: The base rules in their listed order, then the added ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
)
BASE = ("assign", "access", "hex")


def running(values: Column, join) -> Column:
    """join(earlier, own) over all elements up to each place, by doubling: n log n, where appending to an array costs n squared."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda k: k < F.size(values))
    return F.aggregate(steps, values, lambda held, k: F.transform(held, lambda v, i: F.when(i >= k, join(F.get(held, i - k), v)).otherwise(v)))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, rule: Rule) -> Column:
    """Code-point spans of the leftmost non-overlapping matches, end exclusive.

    Splitting at the pattern gives the gaps between the matches, so that running sums of the lengths of gaps and matches are the offsets.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = lambda texts: F.transform(texts, F.length)
    value = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else None
    cut = F.struct(lengths(matches).alias("hit"), lengths(F.split(text, rule.pattern, -1)).alias("gap"), *([value.alias("value")] if rule.group else []))

    def spans(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["gap"], 1, F.size(x["hit"])), x["hit"], lambda g, h: g + h), lambda a, b: a + b)
        each = F.arrays_zip(ends.alias("end"), x["hit"].alias("hit"), (x["value"] if rule.group else x["hit"]).alias("value"))
        return F.transform(F.filter(each, lambda s: s["value"] >= rule.least), lambda s: F.struct((s["end"] - s["hit"]).alias("start"), s["end"].alias("end")))

    return bound(cut, spans)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of all unseen pairs, one for each. blobs: blob, text and due, an array of "rule:version" that are still
    unseen; rows of one blob are scanned where they stand and meet only by what was found in them."""
    text, low = F.col("text"), F.col("low")
    found = []
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    for rule in rules:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in rule.needles], F.lit(not rule.needles)) & text.rlike(rule.pattern)
        found.append(F.when(F.array_contains("due", f"{rule.name}:{rule.version}"), F.when(hit, spans_of(text, rule)).otherwise(none)))
    each = blobs.withColumn("low", F.lower("text")).select("blob", F.array(*found).alias("found"))
    once = each.groupBy("blob").agg(F.any_value("found").alias("found")).select("blob", F.posexplode("found").alias("place", "spans")).filter(F.col("spans").isNotNull())
    known = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    return once.withColumn("r", F.element_at(known, F.col("place") + 1)).select("blob", "r.rule", "r.version", "spans")


def address(paths: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob and text of each version."""
    text = text_or_empty(text_col)
    return paths.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of versions (path, blob, text) to scan, with ``due``, the pairs "rule:version" of their blob that the ledger lacks.

    Without a ledger every row is due and stays where it is: no text is shuffled. With one, digests alone meet the ledger
    and one path of each unseen blob is picked (several rows where path and text are repeated)."""
    wanted = F.array(*[F.lit(f"{r.name}:{r.version}") for r in rules])
    if ledger is None:
        return versions.withColumn("due", wanted)
    blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    picked = todo.filter(F.size("due") > 0).select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "due")
    # A path may hold several blobs (its history), so both columns pick the rows.
    return versions.join(picked, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path"))).drop("_blob", "_path")


def update_ledger(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (LEDGER) for blobs and rule versions that ``ledger`` lacks, one for each; written to the shared folder.

    Null and empty texts are the empty blob.
    """
    return settle(scan(unseen(address(paths, id_col, text_col), ledger, rules), rules), "ledger")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at ``path``; None where nothing has been stored yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if known else None


def extend_ledger(paths: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger stored at ``path`` lacks, append it there, and return the whole ledger.

    Only pairs of blob and rule version that it lacks are scanned and written, so it keeps one row for each pair; files of
    a failed attempt aren't part of it, as Spark commits an append as a whole. One run at a time may extend a ledger."""
    spark = paths.sparkSession
    scan(unseen(address(paths, id_col, text_col), read_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per path version: path, blob, found (array of kind, start, end by start, then rule order), also when nothing was found."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = [(r.name, r.version) for r in rules]
    held = ledger.filter(reduce(lambda a, b: a | b, [(F.col("rule") == n) & (F.col("version") == v) for n, v in current]) & (F.size("spans") > 0))
    spans = held.select("blob", "rule", F.explode("spans").alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), order[F.col("rule")].alias("place"), F.col("s.end").alias("end"), F.col("rule").alias("kind")).alias("x"))
    by_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_set("x")).alias("found"))
    versions = address(paths, id_col, text_col).select("path", "blob")
    return versions.join(by_blob, "blob", "left").select(
        "path", "blob", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)")).alias("found")
    )


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans from the rows of findings()."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )


def secret_scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Scan ``documents`` against the ledger stored at the path ``ledger`` (extended by the run; a new one in the shared folder
    if it is None), then report on every row.

    Null text counts as empty; empty texts have no spans. Rows with a null id are reported with a null doc_id. Repeated
    rows are each reported. An empty table gives an empty result. Columns other than doc_id and text are ignored. Texts of
    any length are scanned whole.
    """
    return digests(findings(docs, extend_ledger(docs, ledger or shared_path(docs.sparkSession, "ledger"))))


def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` (overlapping spans by one), n_chars recounted.

    All rows stay, repeated ones and those with null ids too; null texts stay null. All columns stay, whatever their
    names. An empty table gives an empty result."""
    held = findings(docs.select("doc_id", "text"), extend_ledger(docs, ledger or shared_path(docs.sparkSession, "ledger")))
    # As a text's spans follow from the text, rows meet them by digest alone.
    cuts = held.filter(F.size("found") > 0).groupBy("blob").agg(F.any_value("found").alias("found"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.sha2(text_or_empty(), 256).alias("key"))
    joined = rows.join(cuts, F.col("key") == F.col("blob"), "left")
    text = F.col("text")

    def cleaned(x: Column) -> Column:
        # What comes before a span that no earlier one reaches into, and its mark; characters are cut once, as places in UTF-8 texts are found from the start.
        last = F.coalesce(F.element_at(x["reach"], -1), F.lit(0))
        before = lambda i: F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0)
        each = F.transform("found", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("at")))
        part = lambda a, b: F.array_join(F.slice(x["chars"], a + 1, b - a), "")
        pieces = F.transform(F.filter(each, lambda s: s["start"] >= s["at"]), lambda s: F.concat(part(s["at"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.array_join(F.concat(pieces, F.array(part(last, F.size(x["chars"])))), "")

    reach = running(F.transform("found", lambda s: s["end"]), F.greatest)
    clean = bound(F.struct(F.split(text, "").alias("chars"), reach.alias("reach")), cleaned)
    out = joined.select("row", F.when(F.col("found").isNull(), text).otherwise(clean).alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, place, rx, grp, least) AS (VALUES
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, '(AKIA([A-Z0-9]+))', 1, 16),
  ('hex', 2, '(([0-9a-f]{32,}))', 1, 32),
  ('pem', 3, '((-----BEGIN [A-Z ]*PRIVATE KEY-----))', 1, 1),
  ('github', 4, '((gh[pousr]_[A-Za-z0-9]{36,}))', 1, 1),
  ('jwt', 5, '((eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))', 1, 1),
  ('slack', 6, '((xox[abprs]-[A-Za-z0-9-]{10,}))', 1, 1)),
m AS (
  SELECT doc_id, kind, place, least,
         CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
                   WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0)
                   WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]{32,}', 0)
                   WHEN 'pem' THEN regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0)
                   WHEN 'github' THEN regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}', 0)
                   WHEN 'jwt' THEN regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0)
                   ELSE regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0) END AS hits,
         CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) END AS vals,
         CASE kind WHEN 'assign' THEN string_split_regex(text, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)')
                   WHEN 'access' THEN string_split_regex(text, 'AKIA[A-Z0-9]+')
                   WHEN 'hex' THEN string_split_regex(text, '[0-9a-f]{32,}')
                   WHEN 'pem' THEN string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
                   WHEN 'github' THEN string_split_regex(text, 'gh[pousr]_[A-Za-z0-9]{36,}')
                   WHEN 'jwt' THEN string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}')
                   ELSE string_split_regex(text, 'xox[abprs]-[A-Za-z0-9-]{10,}') END AS gaps
  FROM d, rules),
h AS (SELECT doc_id, kind, place, least, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (
  SELECT doc_id, kind, place,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b,
         length(hits[i]) AS n
  FROM h WHERE length(coalesce(vals[i], hits[i])) >= least),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, place) FILTER (WHERE place < 3) AS base,
         string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, place) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
