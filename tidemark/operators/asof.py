"""As-of joins and guarded joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that raises where a key occurs twice on either side. The counts are combined before the shuffle."""
    for name, side in (("left", left), ("right", right)):
        twice = side.groupBy(*on).count().filter("count > 1").limit(1).count()
        if twice:
            raise ValueError(f"the {name} side has repeated keys {on}")
    return left.join(right, on, how)


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], direction: str = "backward", allow_exact: bool = True,
              tolerance: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Every left row with the nearest right row of the same keys, before it, after it or on either side.

    Both sides are unioned and the latest right row is carried along the order; no pairs are made. Right rows have the
    columns by, on and others; the matched time is ``matched_on``. tolerance is in seconds (days for dates: 86400 each).
    ``bucket``, a Column over ``_on`` that grows with it (such as its month), deals a hot key over many tasks: rows are
    carried along within buckets, and the last row of each bucket along the buckets.
    Of several right rows at one time one is taken, the largest by its columns.
    """
    if direction == "nearest":
        return _nearest(left, right, on, by, allow_exact, tolerance, bucket)
    forward = direction == "forward"
    extra = [c for c in right.columns if c not in (*by, on)]
    found = F.struct(F.col(on).alias("matched_on"), *extra)
    # At equal times the right row must come first in the order of carrying if it may match, else last.
    place = {True: 0, False: 2}[allow_exact]
    rows = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    marks = right.select(*by, F.col(on).alias("_on"), F.lit(place).alias("_side"), found.alias("_found"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = [F.col("_on").desc() if forward else F.col("_on"), F.col("_side"), F.col("_found")]
    keys = [*by]
    if bucket is not None:
        both, keys = both.withColumn("_bucket", bucket), [*by, "_bucket"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("_found", ignorenulls=True).over(w)
    out = both.withColumn("_match", carried)
    if bucket is not None:
        known = F.col("_found").isNotNull()
        last = F.min_by("_found", F.struct(~known, F.col("_on"))) if forward else F.max_by("_found", F.struct(known, F.col("_on"), F.col("_found")))
        ends = both.groupBy(*keys).agg(last.alias("_edge"))
        along = Window.partitionBy(*by).orderBy(F.col("_bucket").desc() if forward else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_before", F.last("_edge", ignorenulls=True).over(along)).drop("_edge")
        out = out.join(ends, keys, "left").withColumn("_match", F.coalesce("_match", "_before"))
    out = out.filter(F.col("_left").isNotNull())
    match = F.col("_match")
    if tolerance is not None:
        match = F.when(F.abs(_seconds(F.col("_on")) - _seconds(F.col("_match.matched_on"))) <= tolerance, match)
    out = out.withColumn("_match", match)
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], F.col("_match.matched_on").alias("matched_on"), *[F.col("_match")[c].alias(c) for c in extra])


def _nearest(left: DataFrame, right: DataFrame, on: str, by: list[str], allow_exact: bool, tolerance: int | None, bucket: Column | None) -> DataFrame:
    """The nearer of the last right row before and the first one after, the earlier of equals.

    Both are carried along by frames from the first row to this one, once in the order of time and once against it, so the work is
    linear in a key's rows; a frame up to the last row would be summed up anew at each row.
    """
    extra = [c for c in right.columns if c not in (*by, on)]
    found = F.struct(F.col(on).alias("matched_on"), *extra)
    rows = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    marks = right.filter(F.col(on).isNotNull()).select(*by, F.col(on).alias("_on"), F.lit(0).alias("_side"), found.alias("_found"))
    both, keys = rows.unionByName(marks, allowMissingColumns=True), [*by]
    if bucket is not None:
        both, keys = both.withColumn("_bucket", bucket), [*by, "_bucket"]
    # Right rows of an equal time stand before the left ones where they may match, else behind them; against the order of time behind
    # them. Of several at one time the largest comes last and is carried.
    first = F.col("_side") if allow_exact else F.col("_side").desc()
    carried = lambda *order: F.last("_found", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order, F.col("_found")).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumns({"_b": carried(F.col("_on"), first), "_f": carried(F.col("_on").desc(), F.col("_side").desc())})
    if bucket is not None:
        known = F.col("_found").isNotNull()
        ends = both.groupBy(*keys).agg(F.max(F.when(known, F.struct("_on", "_found"))).alias("_last"), F.min(F.when(known, F.col("_on"))).alias("_first_on"))
        heads = both.filter(known).groupBy(*keys, F.col("_on").alias("_first_on")).agg(F.max("_found").alias("_first"))
        ends = ends.join(heads, [*keys, "_first_on"], "left")
        along = lambda name, order: F.last(name, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*keys, along("_last", F.col("_bucket"))["_found"].alias("_earlier"), along("_first", F.col("_bucket").desc()).alias("_later"))
        out = out.join(ends, keys, "left").withColumns({"_b": F.coalesce("_b", "_earlier"), "_f": F.coalesce("_f", "_later")})
    away = [F.abs(_seconds(F.col("_on")) - _seconds(F.col(f"{n}.matched_on"))) for n in ("_b", "_f")]
    match = F.when(away[1].isNull() | (away[0] <= away[1]), F.col("_b")).otherwise(F.col("_f"))
    if tolerance is not None:
        match = F.when(F.least(*away) <= tolerance, match)
    out = out.filter(F.col("_left").isNotNull()).withColumn("_match", match)
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], F.col("_match.matched_on").alias("matched_on"), *[F.col("_match")[c].alias(c) for c in extra])


def _seconds(x: Column) -> Column:
    return F.unix_timestamp(x.cast("timestamp_ltz"))


def replace_by_asof(df: DataFrame, right: DataFrame, columns: list[str], on: str, by: list[str], prefix: str = "embedded_") -> DataFrame:
    """Own columns stay under a prefix, and the latest earlier right row's values take their names.

    Rows without keys share one series: the as-of step runs over their distinct dates, and rows meet it by equality, which Spark spreads."""
    kept = df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns if c in df.columns})
    days = asof_join(kept.select(*by, on).distinct(), right, on, by, allow_exact=False)
    same = F.col(f"_l.{on}").eqNullSafe(F.col(f"_r.{on}"))
    for c in by:
        same = same & F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
    return kept.alias("_l").join(days.alias("_r"), same, "left").select("_l.*", *[F.col(f"_r.{c}") for c in days.columns if c not in (*by, on)])


def offset_join(events: DataFrame, rows: DataFrame, by: list[str], position: str = "position", before: int = 5, after: int = 5) -> DataFrame:
    """Rows at positions position-before to position+after of each event, as an equality join over exploded offsets."""
    wanted = events.withColumn("tau", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("_at", F.col(position) + F.col("tau"))
    side = rows.withColumnsRenamed({c: f"_{c}" for c in by} | {position: "_position"})
    test = F.col("_at") == F.col("_position")
    for c in by:
        test = test & (F.col(c) == F.col(f"_{c}"))
    return wanted.join(side, test).drop("_at", "_position", *[f"_{c}" for c in by])
