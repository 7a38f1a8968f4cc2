"""Queries of the models and their comparison (M), and streaming over files (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import boosting, calendar, features, models
from tidemark.plans import sql
from tidemark.plans import tables as T
from tidemark.plans.base import registry, rounded
from tidemark.plans.feature_queries import FEATURE_TABLE, feature_table
from tidemark.sources.readers import metric_table
from tidemark.sources.shared import settle
from tidemark.streaming import streams

QUERIES, ORACLES, register = registry()
BASE, WITH_SENTIMENT = list(features.BASE_FEATURES), list(features.SENTIMENT_FEATURES)
_T = f"WITH {FEATURE_TABLE}, placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY instrument) AS n_rows FROM table_rows), split AS (SELECT *, CASE WHEN position >= n_rows - 15 THEN 'holdout' WHEN position < 50 THEN 'train' ELSE 'validation' END AS part FROM placed)"
#: Calibration on the validation rows, predictions of the holdout by two one-variable lines.
_FIT = f"""{_T}, fits AS (SELECT instrument, regr_intercept(target_vol_pk, rolling_volatility_lag1) AS a1, regr_slope(target_vol_pk, rolling_volatility_lag1) AS b1,
  regr_intercept(target_vol_pk, sentiment_overnight) AS a2, regr_slope(target_vol_pk, sentiment_overnight) AS b2 FROM split WHERE part = 'validation' GROUP BY instrument),
pred AS (SELECT s.instrument, s.date, s.position, target_vol_pk AS actual, rolling_volatility_lag1 AS raw, a1 + b1 * rolling_volatility_lag1 AS base, a2 + b2 * sentiment_overnight AS sent,
  pow(target_vol_pk - (a1 + b1 * rolling_volatility_lag1), 2) - pow(target_vol_pk - (a2 + b2 * sentiment_overnight), 2) AS d FROM split s JOIN fits f ON f.instrument = s.instrument WHERE part = 'holdout')"""


def _split(spark, d):
    return models.split(feature_table(spark, d))


def _holdout(spark, d):
    rows = models.calibrate(_split(spark, d), "target_vol_pk", ["rolling_volatility_lag1"], name="base")
    rows = models.calibrate(rows, "target_vol_pk", ["sentiment_overnight"], name="sent")
    return rows.filter("split = 'holdout'").select("instrument", "date", "position", F.col("target_vol_pk").alias("actual"), F.col("rolling_volatility_lag1").alias("raw"), "base", "sent")


@register(f"{_T} SELECT instrument, date, position, part AS split FROM split")
def m1_split(spark, d):
    return _split(spark, d).select("instrument", "date", "position", "split")


@register(f"{_T} SELECT instrument, date, round(CASE WHEN position >= 50 THEN regr_intercept(target_vol_pk, rolling_volatility_lag1) OVER w + regr_slope(target_vol_pk, rolling_volatility_lag1) OVER w * rolling_volatility_lag1 END, 6) AS prediction FROM split WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def m2_expanding_walk_forward(spark, d):
    out = models.expanding_line(feature_table(spark, d), "target_vol_pk", "rolling_volatility_lag1")
    return rounded(out.select("instrument", "date", "prediction"), 6)


_GARCH = f"""WITH RECURSIVE {T.RETURNS}, r AS (SELECT instrument, date, cc_return * 100 AS r, row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY instrument) AS n FROM featured WHERE cc_return IS NOT NULL),
folds AS (SELECT DISTINCT instrument, p - p % 20 + 10 AS start FROM r WHERE p >= 50 AND (p - 50) % 20 = 0 AND n > 50),
known AS (SELECT f.instrument, start, avg(r) AS mean, var_pop(r) AS v FROM folds f JOIN r ON r.instrument = f.instrument AND r.p < start GROUP BY ALL),
grid AS (SELECT a, b FROM (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2]::DOUBLE[]) AS a), (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS b) WHERE a + b < 1),
run AS (SELECT k.instrument, start, mean, v, a, b, CAST(0 AS BIGINT) AS p, v AS s, CAST(0 AS DOUBLE) AS l FROM known k, grid WHERE v > 0 UNION ALL
  SELECT x.instrument, x.start, x.mean, x.v, x.a, x.b, x.p + 1, (1 - x.a - x.b) * x.v + x.a * (r - mean) * (r - mean) + x.b * x.s, x.l - ln(x.s) - (r - mean) * (r - mean) / x.s FROM run x JOIN r ON r.instrument = x.instrument AND r.p = x.p WHERE x.p < x.start + 20),
best AS (SELECT instrument, start, arg_max(ROW(a, b), ROW(l, a, b)) AS g FROM run WHERE p = start GROUP BY ALL)"""


@register(f"{_GARCH} SELECT r.instrument, r.date, round(x.a, 6) AS alpha, round(x.b, 6) AS beta, round(sqrt(x.s) / 100, 6) AS volatility FROM best JOIN run x ON x.instrument = best.instrument AND x.start = best.start AND ROW(x.a, x.b) = best.g JOIN r ON r.instrument = x.instrument AND r.p = x.p WHERE x.p >= x.start AND x.p < x.start + 20")
def m3_garch_grid(spark, d):
    out = models.garch_forecast(T.analysis(spark, d).select("instrument", "date", "cc_return"))
    return rounded(out.select("instrument", "date", "alpha", "beta", "volatility"), 6)


@register()
def m3_garch_search(spark, d):
    """Parameters searched anew before every row: the grid, then four refinements around its best point."""
    out = models.garch_forecast(T.analysis(spark, d).select("instrument", "date", "cc_return"), every=1, rounds=4)
    return rounded(out.select("instrument", "date", "alpha", "beta", "volatility"), 6)


@register(f"{_FIT} SELECT instrument, date, round(actual, 7) AS actual, round(base, 7) AS base, round(sent, 7) AS sent FROM pred")
def m5_calibrated_holdout(spark, d):
    return rounded(_holdout(spark, d).select("instrument", "date", "actual", "base", "sent"), 7)


_O, _LAST = sql.orthogonal("o", "(SELECT * FROM split WHERE part = 'validation')", "instrument", ["rolling_volatility_lag1", "sentiment_overnight"], "target_vol_pk")
_M6 = f"{_O}, f AS (SELECT instrument, count(*) AS n, sum(y * q1) / sum(q1 * q1) / sqrt((sum(y * y) - {sql.explained(range(2))}) / (count(*) - 3) / sum(q1 * q1)) AS t FROM {_LAST} GROUP BY instrument)"


@register(f"{_T}, {_M6} SELECT instrument, round({dist.t_two_sided_sql('t', '(n - 3)')}, 6) AS p_value FROM f")
def m6_coefficient_p_values(spark, d):
    out = models.calibrate(_split(spark, d), "target_vol_pk", ["rolling_volatility_lag1", "sentiment_overnight"], name="x")
    return rounded(out.groupBy("instrument").agg(F.first("x_p").alias("p_value")), 6)


@register()
def m7_ridge(spark, d):
    """Base features, and with both sentiments (M8), alpha chosen by folds in time order."""
    rows = _split(spark, d)
    base = models.ridge(rows, "target_vol_pk", BASE, name="ridge")
    both = models.ridge(rows, "target_vol_pk", WITH_SENTIMENT, name="ridge_sentiment").select("instrument", "date", "ridge_sentiment", "ridge_sentiment_alpha")
    out = base.filter("split = 'holdout'").join(both, ["instrument", "date"])
    return rounded(out.select("instrument", "date", "target_vol_pk", "ridge", "ridge_alpha", "ridge_sentiment", "ridge_sentiment_alpha"), 6)


#: Draws of the search and numbers of trees in this query; the operator's defaults are the survey's 150 and 50 to 200.
DRAWS, TREES = 2, (4, 8)


@register()
def m9_m10_boosted_trees(spark, d):
    """Base features and those with sentiment: parameters drawn at random and tried on four folds of rows before the holdout, then every row
    from each instrument's 50th on predicted by a model of earlier dates, refitted each year."""
    rows = models.split(feature_table(spark, d)).select("instrument", "date", "position", "rows", "split", "target_vol_pk", *WITH_SENTIMENT).na.fill(0.0, ["sentiment_intraday"])
    rows = settle(rows, "tree-rows")
    first = rows.filter(F.col("position") >= models.MIN_TRAIN).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    cuts = [first.a, *[first.a.replace(year=y, month=1, day=1) for y in range(first.a.year + 1, first.b.year + 1)]]
    out = None
    for name, xs in (("base", BASE), ("sentiment", WITH_SENTIMENT)):
        best, _ = models.tune_trees(rows, "target_vol_pk", xs, models.draw_parameters(DRAWS, grid=models.TREE_GRID | {"maxIter": TREES}))
        part = models.tree_walk_forward(rows, "target_vol_pk", xs, cuts, params=best).filter(F.col("position") >= models.MIN_TRAIN)
        part = part.select("instrument", "date", F.lit(name).alias("features"), F.round("prediction", 6).alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


_ACC = "SELECT instrument, '{0}' AS model, round(sqrt(avg(pow(actual - {0}, 2))), 6) AS rmse, round(avg(abs(actual - {0})), 6) AS mae, count(*) AS n FROM pred GROUP BY instrument"


@register(f"{_FIT} {' UNION ALL '.join(_ACC.format(m) for m in ('raw', 'base', 'sent'))}")
def m11_accuracy(spark, d):
    return rounded(models.accuracy(_holdout(spark, d), "actual", {m: m for m in ("raw", "base", "sent")}, ["instrument"]), 6)


@register(f"{_FIT} SELECT instrument, n, round(mean, 7) AS mean, round(t, 5) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 6) AS p_value FROM (SELECT instrument, count(*) AS n, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM pred GROUP BY instrument)")
def m12_diebold_mariano(spark, d):
    return rounded(models.diebold_mariano(_holdout(spark, d), "actual", "base", "sent", ["instrument"]), 7, statistic=5, p_value=6)


_LRV = """, c AS (SELECT instrument, position, d, d - avg(d) OVER (PARTITION BY instrument) AS c FROM pred), lagged AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4 FROM c WINDOW w AS (PARTITION BY instrument ORDER BY position)),
v AS (SELECT instrument, count(*) AS n, avg(d) AS mean, greatest((sum(c * c) + 2 * (0.8 * sum(c * c1) + 0.6 * sum(c * c2) + 0.4 * sum(c * c3) + 0.2 * sum(c * c4))) / count(*), 1e-12) AS variance FROM lagged GROUP BY instrument)"""


@register(f"{_FIT}{_LRV} SELECT instrument, n, round(mean, 7) AS mean, round(t, 5) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 6) AS p_value FROM (SELECT *, mean / sqrt(variance / n) AS t FROM v)")
def m13_m14_dm_hac(spark, d):
    return rounded(models.dm_hac(_holdout(spark, d), "actual", "base", "sent", ["instrument"], "position", 4), 7, statistic=5, p_value=6)


COMPARISONS = {"raw vs sent": ("raw", "sent"), "base vs sent": ("base", "sent"), "raw vs base": ("raw", "base")}
_EACH = ", x AS (" + " UNION ALL ".join(f"SELECT instrument, position, '{n}' AS comparison, pow(actual - {a}, 2) - pow(actual - {b}, 2) AS d FROM pred" for n, (a, b) in COMPARISONS.items()) + ")"
_M17 = f"""{_EACH}, c AS (SELECT instrument, comparison, position, d, d - avg(d) OVER (PARTITION BY instrument, comparison) AS c FROM x), lagged AS (SELECT *, lag(c) OVER (PARTITION BY instrument, comparison ORDER BY position) AS c1 FROM c),
v AS (SELECT instrument, comparison, count(*) AS n, avg(d) AS mean, avg(d) / sqrt(greatest((sum(c * c) + sum(c * c1)) / count(*), 1e-12) / count(*)) AS t FROM lagged GROUP BY ALL)"""


@register(f"{_FIT}{_M17} SELECT instrument, comparison, n, round(mean, 6) AS mean, round(t, 5) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 6) AS p_value FROM v")
def m14_m17_comparisons(spark, d):
    """The fixed comparisons with their p-values."""
    return rounded(models.dm_hac_all(_holdout(spark, d), "actual", COMPARISONS, ["instrument"], "position", 1), 6, statistic=5)


_SIGN = "exp(lgamma(used + 1) - lgamma(i + 1) - lgamma(used - i + 1) - used * ln(2))"


@register(f"""{_FIT}, s AS (SELECT position - min(position) OVER (PARTITION BY instrument) AS k, CASE WHEN stddev_samp(d) OVER (PARTITION BY instrument) > 0 THEN d / stddev_samp(d) OVER (PARTITION BY instrument) ELSE 0 END AS s FROM pred),
y AS (SELECT k, avg(s) AS d FROM s GROUP BY k), c AS (SELECT k, d, d - avg(d) OVER () AS c FROM y), lagged AS (SELECT *, lag(c) OVER (ORDER BY k) AS c1 FROM c),
p AS (SELECT count(*) AS n, avg(d) AS mean, count(*) FILTER (WHERE d <> 0) AS used, count(*) FILTER (WHERE d > 0) AS positive, avg(d) / sqrt(greatest((sum(c * c) + sum(c * c1)) / count(*), 1e-12) / count(*)) AS t FROM lagged),
i AS (SELECT *, unnest(range(used + 1)) AS i FROM p), tail AS (SELECT least(1, 2 * least(sum({_SIGN}) FILTER (WHERE i >= positive), sum({_SIGN}) FILTER (WHERE i >= used - positive))) AS p_sign FROM i)
SELECT n, round(mean, 6) AS mean, used, positive, round(t, 5) AS statistic, round({dist.t_two_sided_sql("t", "(n - 1)")}, 6) AS p_value, round(p_sign, 6) AS p_sign FROM p, tail""")
def m15_pooled_by_date(spark, d):
    """Holdout days are numbered from the end of each instrument's series, as their dates differ in these tables."""
    from pyspark.sql import Window

    rows = _holdout(spark, d).withColumn("day", F.col("position") - F.min("position").over(Window.partitionBy("instrument")))
    return rounded(models.pooled_by_date(rows, "actual", "base", "sent", "day", 1), 6, statistic=5)


_WIDE = f"{_FIT}, a AS ({' UNION ALL '.join(_ACC.format(m) for m in ('raw', 'base', 'sent'))}) SELECT instrument, 'pk' AS target, 'rmse' AS metric, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN rmse END), 4) AS {m}" for m in ("raw", "base", "sent")) + " FROM a GROUP BY instrument"


@register(_WIDE)
def m16_comparison_table(spark, d):
    out = rounded(models.accuracy(_holdout(spark, d), "actual", {m: m for m in ("raw", "base", "sent")}, ["instrument"]), 6)
    long = out.select("instrument", F.lit("pk").alias("target"), "model", F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    return metric_table(long, ["raw", "base", "sent"])


def _two_regressors(y: str, a: str, b: str) -> str:
    """The least-squares prediction from two regressors by running covariances."""
    c = lambda u, v: f"covar_pop({u}, {v}) OVER w"
    det = f"({c(a, a)} * {c(b, b)} - {c(a, b)} * {c(a, b)})"
    one, two = f"({c(a, y)} * {c(b, b)} - {c(b, y)} * {c(a, b)}) / {det}", f"({c(b, y)} * {c(a, a)} - {c(a, y)} * {c(a, b)}) / {det}"
    return f"avg({y}) OVER w + {one} * ({a} - avg({a}) OVER w) + {two} * ({b} - avg({b}) OVER w)"


@register(f"{_T} SELECT instrument, date, round(CASE WHEN position >= 50 THEN {_two_regressors('target_vol_pk', 'rolling_volatility_lag1', 'sentiment_overnight')} END, 6) AS prediction FROM split WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def m2_expanding_two_regressors(spark, d):
    """Every row from the 50th on by a line in lagged volatility and overnight sentiment through all earlier rows."""
    out = models.expanding_ols(feature_table(spark, d), "target_vol_pk", ["rolling_volatility_lag1", "sentiment_overnight"])
    return rounded(out.select("instrument", "date", "prediction"), 6)


#: The chain of models: the volatility forecast over each instrument's rows, calibrated alone and with both sentiments, for both targets.
_BOTH = _T.replace(T.SENTIMENT, T.BOTH_SENTIMENTS).replace("WITH ", "WITH RECURSIVE ", 1).replace("FROM table_rows)", "FROM table_rows WHERE sentiment_intraday IS NOT NULL)")
_FORECAST = _GARCH.split(f"{T.RETURNS}, ")[1].replace("FROM featured WHERE cc_return IS NOT NULL", "FROM split WHERE cc_return IS NOT NULL")
_GARCH_ROWS = f"""{_BOTH}, {_FORECAST}, forecast AS (SELECT r.instrument, r.date, sqrt(x.s) / 100 AS garch FROM best JOIN run x ON x.instrument = best.instrument AND x.start = best.start AND ROW(x.a, x.b) = best.g
  JOIN r ON r.instrument = x.instrument AND r.p = x.p WHERE x.p >= x.start AND x.p < x.start + 20),
chain AS (SELECT s.instrument, t.target, s.date, s.position, s.part, CASE t.target WHEN 'pk' THEN target_vol_pk ELSE target_vol_5d END AS actual, garch, sentiment_intraday, sentiment_overnight
  FROM split s JOIN forecast f ON f.instrument = s.instrument AND f.date = s.date CROSS JOIN (VALUES ('pk'), ('5d')) t(target))"""
_P1, _L1 = sql.predicted("pa", "chain", "instrument, target", "part = 'validation'", "actual", ["garch"], "base")
_P2, _L2 = sql.predicted("pb", _L1, "instrument, target", "part = 'validation'", "actual", ["garch", "sentiment_intraday", "sentiment_overnight"], "sent")
_CHAIN = f"{_GARCH_ROWS}, {_P1}, {_P2}, pred AS (SELECT instrument, target, date, position, actual, garch AS raw, base, sent FROM {_L2} WHERE part = 'holdout')"
BOTH = ["garch", "sentiment_intraday", "sentiment_overnight"]


def _chain_table(spark, d):
    """Feature rows with both sentiments and a volatility forecast, placed and split."""
    table = feature_table(spark, d, T.both_sentiments(spark, d)).na.drop(subset=["sentiment_intraday"])
    rows = settle(models.split(table), "chain")
    forecast = models.garch_forecast(rows.select("instrument", "date", "cc_return")).select("instrument", "date", F.col("volatility").alias("garch"))
    return rows.join(forecast, ["instrument", "date"])


def _targets(rows):
    """A row for each target, and a key of instrument and target."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).alias("actual")) for t, c in (("pk", "target_vol_pk"), ("5d", "target_vol_5d"))]))
    return rows.withColumn("_t", each).select("*", "_t.*").drop("_t").withColumn("key", F.concat_ws(":", "instrument", "target"))


def _chain(spark, d):
    rows = _targets(_chain_table(spark, d))
    rows = models.calibrate(rows, "actual", ["garch"], by="key", name="base")
    return models.calibrate(rows, "actual", BOTH, by="key", name="sent")


def _chain_holdout(spark, d):
    return _chain(spark, d).filter("split = 'holdout'").select("instrument", "target", "date", "position", "actual", F.col("garch").alias("raw"), "base", "sent")


@register(f"{_CHAIN} SELECT instrument, target, date, round(actual, 6) AS actual, round(raw, 6) AS raw, round(base, 6) AS base, round(sent, 6) AS sent FROM pred")
def m3_m5_chain(spark, d):
    """The holdout by the forecast as it is, calibrated, and calibrated with both sentiments."""
    return rounded(_chain_holdout(spark, d).drop("position"), 6)


def _p_value(name: str, xs: list[str]) -> str:
    text, last = sql.orthogonal(name, "(SELECT *, instrument || ':' || target AS key FROM chain WHERE part = 'validation')", "key", xs, "actual")
    t = f"sum(y * q2) / sum(q2 * q2) / sqrt((sum(y * y) - {sql.explained(range(3))}) / (count(*) - 4) / sum(q2 * q2))"
    return f"{text}, {name}_t AS (SELECT key, count(*) AS n, {t} AS t FROM {last} GROUP BY key)"


_M6_BOTH = f"{_p_value('ou', ['garch', 'sentiment_intraday', 'sentiment_overnight'])}, {_p_value('oi', ['garch', 'sentiment_overnight', 'sentiment_intraday'])}"


@register(f"{_GARCH_ROWS}, {_M6_BOTH} SELECT ou_t.key, round({dist.t_two_sided_sql('oi_t.t', '(oi_t.n - 4)')}, 5) AS p_intraday, round({dist.t_two_sided_sql('ou_t.t', '(ou_t.n - 4)')}, 5) AS p_overnight FROM ou_t JOIN oi_t ON oi_t.key = ou_t.key")
def m6_chain_p_values(spark, d):
    """P-values of both sentiments in the calibration, by instrument and target."""
    out = _chain(spark, d).groupBy("key").agg(F.first("sent_p_sentiment_intraday").alias("p_intraday"), F.first("sent_p_sentiment_overnight").alias("p_overnight"))
    return rounded(out, 5)


_ACC2 = " UNION ALL ".join(f"SELECT instrument, target, '{m}' AS model, round(sqrt(avg(pow(actual - {m}, 2))), 6) AS rmse, round(avg(abs(actual - {m})), 6) AS mae, count(*) AS n FROM pred GROUP BY instrument, target" for m in ("raw", "base", "sent"))


@register(f"{_CHAIN} {_ACC2}")
def m11_chain_accuracy(spark, d):
    return rounded(models.accuracy(_chain_holdout(spark, d), "actual", {m: m for m in ("raw", "base", "sent")}, ["instrument", "target"]), 6)


#: Bartlett lags of each target: five-day volatilities overlap.
LAGS = {"pk": 1, "5d": 4}
_EACH2 = ", x AS (" + " UNION ALL ".join(f"SELECT instrument, target, position, '{n}' AS comparison, pow(actual - {a}, 2) - pow(actual - {b}, 2) AS d FROM pred" for n, (a, b) in COMPARISONS.items()) + ")"


def _lagged(source: str, keys: str, order: str, d: str = "d") -> str:
    """CTE v: n, mean and t of the long-run variance with the target's lags."""
    c = ", ".join(f"lag(c, {i}) OVER (PARTITION BY {keys} ORDER BY {order}) AS c{i}" for i in range(1, 5))
    var = lambda most: "(sum(c * c) + 2 * (" + " + ".join(f"{1 - i / (most + 1)!r} * coalesce(sum(c * c{i}), 0)" for i in range(1, most + 1)) + ")) / count(*)"
    return (f"c AS (SELECT *, {d} - avg({d}) OVER (PARTITION BY {keys}) AS c FROM {source}), lagged AS (SELECT *, {c} FROM c), "
            f"v AS (SELECT {keys}, count(*) AS n, avg({d}) AS mean, avg({d}) / sqrt(greatest(CASE WHEN target = 'pk' THEN {var(1)} ELSE {var(4)} END, 1e-12) / count(*)) AS t FROM lagged GROUP BY {keys})")  # fmt: skip


@register(f"{_CHAIN}{_EACH2}, {_lagged('x', 'instrument, target, comparison', 'position')} SELECT instrument, target, comparison, n, round(mean, 7) AS mean, round(t, 4) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 5) AS p_value FROM v")
def m12_m17_chain_comparisons(spark, d):
    """Every pair of the chain's models for each instrument and target, with the target's lags."""
    rows, out = _chain_holdout(spark, d), None
    for target, lag in LAGS.items():
        part = models.dm_hac_all(rows.filter(F.col("target") == target), "actual", COMPARISONS, ["instrument", "target"], "position", lag)
        out = part if out is None else out.unionByName(part)
    return rounded(out, 7, statistic=4, p_value=5)


@register(f"""{_CHAIN}{_EACH2}, z AS (SELECT target, comparison, position - min(position) OVER (PARTITION BY instrument, target, comparison) AS k, CASE WHEN stddev_samp(d) OVER (PARTITION BY instrument, target, comparison) > 0 THEN d / stddev_samp(d) OVER (PARTITION BY instrument, target, comparison) ELSE 0 END AS s FROM x),
y AS (SELECT target, comparison, k, avg(s) AS m FROM z GROUP BY ALL), {_lagged('y', 'target, comparison', 'k', 'm')}, u AS (SELECT target, comparison, count(*) FILTER (WHERE m <> 0) AS used, count(*) FILTER (WHERE m > 0) AS positive FROM y GROUP BY ALL)
SELECT v.target, v.comparison, n, round(mean, 6) AS mean, used, positive, round(t, 4) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 5) AS p_value FROM v JOIN u ON u.target = v.target AND u.comparison = v.comparison""")
def m15_chain_pooled(spark, d):
    """Pooled over instruments by day of the holdout, for each target and pair of models."""
    from pyspark.sql import Window

    rows = _chain_holdout(spark, d).withColumn("day", F.col("position") - F.min("position").over(Window.partitionBy("instrument", "target")))
    rows, out = settle(rows, "holdout"), None
    for target, lag in LAGS.items():
        for name, (one, two) in COMPARISONS.items():
            part = models.pooled_by_date(rows.filter(F.col("target") == target), "actual", one, two, "day", lag).select(F.lit(target).alias("target"), F.lit(name).alias("comparison"), "*")
            out = part if out is None else out.unionByName(part)
    return rounded(out.drop("p_sign"), 6, statistic=4, p_value=5)


SETS = {"base": BASE, "sentiment": WITH_SENTIMENT}
#: Draws of the search in the queries, for one target and for two; the operator's default is the survey's 150.
TREE_DRAWS, TABLE_DRAWS = 10, 5


@register()
def m9_m10_trees_by_instrument(spark, d):
    """The search on four folds with both feature sets for each instrument, then every row from the 50th on by trees fitted to all
    earlier rows, anew every 50 rows."""
    rows = settle(models.split(feature_table(spark, d, T.both_sentiments(spark, d))).select("instrument", "date", "split", "target_vol_pk", *WITH_SENTIMENT), "trees")
    best = boosting.best_draws(boosting.search(rows, "target_vol_pk", SETS, TREE_DRAWS))
    out = boosting.walk_forward(rows, "target_vol_pk", SETS, settle(best, "draws"), TREE_DRAWS, every=50)
    return rounded(out, 6)


SEVEN = ("garch", "garch_ols", "garch_ols_sentiment", "garch_ridge", "garch_ridge_sentiment", "trees", "trees_sentiment")


def seven_models(spark, d):
    """Holdout predictions of all seven models by instrument and target: the chain, ridge on the forecast with and without sentiments, and
    trees fitted anew before every row."""
    rows = settle(_targets(_chain_table(spark, d)), "seven")
    out = models.calibrate(rows, "actual", ["garch"], by="key", name="garch_ols")
    out = models.calibrate(out, "actual", BOTH, by="key", name="garch_ols_sentiment")
    for name, xs in (("garch_ridge", ["garch"]), ("garch_ridge_sentiment", BOTH)):
        fit = models.ridge(rows, "actual", xs, by="key", name=name).select("key", "date", name)
        out = out.join(fit, ["key", "date"])
    # The trees of a key see its rows only, so the key stands for the instrument.
    best = settle(boosting.best_draws(boosting.search(rows, "actual", SETS, TABLE_DRAWS, by="key"), by="key"), "draws")
    trees = boosting.walk_forward(rows, "actual", SETS, best, TABLE_DRAWS, by="key", last=models.HOLDOUT)
    wide = trees.groupBy("key", "date").agg(F.max(F.when(F.col("features") == "base", F.col("prediction"))).alias("trees"), F.max(F.when(F.col("features") == "sentiment", F.col("prediction"))).alias("trees_sentiment"))
    return out.filter("split = 'holdout'").join(wide, ["key", "date"]).select("instrument", "target", "date", "position", "actual", *SEVEN)


@register()
def m16_seven_models(spark, d):
    """Root mean squared errors of the holdout: a row for each instrument and target, a column for each model."""
    out = models.accuracy(seven_models(spark, d), "actual", {m: m for m in SEVEN}, ["instrument", "target"])
    return metric_table(rounded(out, 6).select("instrument", "target", "model", F.lit("rmse").alias("metric"), F.col("rmse").alias("value")), list(SEVEN))


@register("SELECT event_id, event_type AS instrument FROM events")
def x1_stream_accumulate(spark, d):
    """Every event twice through a stream of files; each id comes out once."""
    return streams.run_once(spark, d, "events", lambda s: streams.accumulate_once(s.unionByName(s), ["event_id"], "ts").select("event_id", F.col("event_type").alias("instrument")))


_FULL = T.POSTS + ", days AS (SELECT DISTINCT event_type AS instrument, CAST(ts AS DATE) AS date FROM events WHERE dayofweek(ts) NOT IN (0, 6)), calendar AS (SELECT * FROM days)," + T.SESSIONS.split(T.CALENDAR + ",", 1)[1]


_READ = "SELECT instrument, session_date AS date, session, round(avg(score), 7) AS sentiment_index, count(*) AS item_count FROM assigned WHERE session_date IS NOT NULL GROUP BY ALL"


@register(f"SELECT 1 AS reading, * FROM (WITH {T.SESSIONS} {_READ}) UNION ALL SELECT 2, * FROM (WITH {_FULL} {_READ})")
def x3_changed_calendar(spark, d):
    """The sums of one stream read under a calendar without its last day, whose posts a provisional day takes, and again when that day has come."""
    sums, posts = streams.daily_sums(spark, d), T.posts(spark, d)
    later = posts.select("instrument", F.to_date("ts").alias("date")).distinct().filter(~F.dayofweek("date").isin(1, 7))
    out = None
    for reading, days in enumerate((calendar.trading_calendar(T.calendar(spark, d)), later), 1):
        part = streams.attribute(sums, calendar.with_provisional(days, posts).select("instrument", "date")).withColumn("reading", F.lit(reading))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 7)


@register(f"WITH {T.POSTS}, {T.CALENDAR}, {T.SESSIONS.split(T.CALENDAR + ',', 1)[1]} SELECT instrument, session_date AS date, session, round(avg(score), 7) AS sentiment_index, count(*) AS item_count FROM assigned WHERE session_date IS NOT NULL GROUP BY ALL")
def x2_x3_stream_session_index(spark, d):
    """Posts as a stream into sums by day and part of the day, attributed by the calendar at reading time."""
    days = calendar.with_provisional(calendar.trading_calendar(T.calendar(spark, d)), T.posts(spark, d)).select("instrument", "date")
    return rounded(streams.session_index(spark, d, days), 7)
