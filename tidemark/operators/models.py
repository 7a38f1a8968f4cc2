"""Walk-forward models and their comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions import dist

HOLDOUT, MIN_TRAIN = 15, 50
#: Folds of a block of garch_forecast.
GARCH_FOLDS = 256
ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 13))


def split(df: DataFrame, by: str = "instrument", on: str = "date", holdout: int = HOLDOUT, min_train: int = MIN_TRAIN) -> DataFrame:
    """M1: position, rows and split: train (the first 50), validation, holdout (the last 15)."""
    w = Window.partitionBy(by)
    rows = df.withColumns({"position": F.row_number().over(w.orderBy(on)) - 1, "rows": F.count(F.lit(1)).over(w)})
    return rows.withColumn("split", F.when(F.col("position") >= F.col("rows") - holdout, "holdout").when(F.col("position") < min_train, "train").otherwise("validation"))


def expanding_line(df: DataFrame, y: str, x: str, by: str = "instrument", on: str = "date", min_train: int = MIN_TRAIN) -> DataFrame:
    """M2: the prediction of every row by the line through all earlier rows; running aggregates, no copies of training rows."""
    w = Window.partitionBy(by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy(by).orderBy(on)) - 1
    value = F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * F.col(x)
    return df.withColumn("prediction", F.when(place >= min_train, value))


def expanding_ols(df: DataFrame, y: str, xs: list[str], by: str = "instrument", on: str = "date", min_train: int = MIN_TRAIN, name: str = "prediction") -> DataFrame:
    """M2, M5: the prediction of every row from the ``min_train``-th on by least squares of y on a constant and xs over all earlier rows of its key.

    Means and covariances run along the key's window (each row adds to mergeable moments, so no training rows are copied), and
    every row solves its own small system. Incomplete rows teach nothing; the prediction is null for them, and where the
    earlier rows don't determine the coefficients."""
    from tidemark.operators.regression import fitted

    w = Window.partitionBy(by).orderBy(on)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in (y, *xs)])
    cols = [F.when(known, F.col(c).cast("double")) for c in (y, *xs)]
    half = {(i, j): F.covar_pop(a, b).over(before) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j}
    cov = F.array(*[half[min(i, j), max(i, j)] for i in range(len(cols)) for j in range(len(cols))])
    rows = df.withColumns({"_n": F.count(cols[0]).over(before), "_mean": F.array(*[F.avg(c).over(before) for c in cols]), "_cov": cov, "_place": F.row_number().over(w) - 1})
    rows = rows.withColumn("_fit", F.when(F.col("_place") >= min_train, fitted("_n", "_mean", "_cov", F.lit(len(xs)))))
    value = reduce(lambda a, b: a + b, [F.col("_fit.coef")[i + 1] * F.col(x) for i, x in enumerate(xs)], F.col("_fit.coef")[0])
    return rows.withColumn(name, value).drop("_n", "_mean", "_cov", "_place", "_fit")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Few small rows with much to compute: dealt by their keys over a fixed number of tasks, which adaptive execution doesn't merge."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _garch_run(r: np.ndarray, starts: np.ndarray, mean: np.ndarray, var: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood (up to constants) of r[:start] and the variance forecast of r[start], for folds (rows, starts ascending) and parameters (columns)."""
    s, like = np.broadcast_to(var[:, None], a.shape).copy(), np.zeros(a.shape)
    rest = (1 - a - b) * var[:, None]
    for t in range(int(starts[-1])):
        k = int(np.searchsorted(starts, t, side="right"))
        e = ((r[t] - mean[k:]) ** 2)[:, None]
        like[k:] -= np.log(s[k:]) + e / s[k:]
        s[k:] = rest[k:] + a[k:] * e + b[k:] * s[k:]
    return like, s


def garch_paths(r: np.ndarray, starts: np.ndarray, every: int, grid: np.ndarray, rounds: int) -> list[tuple[int, float, float, float]]:
    """(place, alpha, beta, volatility) of the ``every`` rows from each start on, with the parameters that are likeliest before it:
    the best point of the grid (of equals the greatest), then ``rounds`` times the best of it and its eight neighbours at half the distance."""
    mean = np.array([r[:k].mean() for k in starts])
    var = np.array([r[:k].var() for k in starts])
    ok = var > 0
    starts, mean, var = starts[ok], mean[ok], var[ok]
    if not len(starts):
        return []
    every_fold, point = np.arange(len(starts)), (len(starts), 1)
    grid = grid[np.lexsort((-grid[:, 1], -grid[:, 0]))]
    a, b = np.tile(grid[:, 0], point), np.tile(grid[:, 1], point)
    like, s = _garch_run(r, starts, mean, var, a, b)
    best = like.argmax(axis=1)
    a, b, s = a[every_fold, best], b[every_fold, best], s[every_fold, best]
    step = 0.05
    for _ in range(rounds):
        step /= 2
        near = np.array([(0, 0), *[(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]]) * step
        ta, tb = a[:, None] + near[:, 0], b[:, None] + near[:, 1]
        bad = (ta < 1e-6) | (tb < 0) | (ta + tb > 1 - 1e-6)
        ta, tb = np.where(bad, a[:, None], ta), np.where(bad, b[:, None], tb)
        like, ts = _garch_run(r, starts, mean, var, ta, tb)
        best = like.argmax(axis=1)
        a, b, s = ta[every_fold, best], tb[every_fold, best], ts[every_fold, best]
    out = []
    for i, k in enumerate(starts.tolist()):
        v = s[i]
        for t in range(k, min(k + every, len(r))):
            out.append((t, float(a[i]), float(b[i]), float(np.sqrt(v) / 100)))
            v = (1 - a[i] - b[i]) * var[i] + a[i] * (r[t] - mean[i]) ** 2 + b[i] * v
    return out


def garch_forecast(df: DataFrame, value: str = "cc_return", by: str = "instrument", on: str = "date", min_train: int = MIN_TRAIN, every: int = 20,
                   alphas: tuple[float, ...] = (0.02, 0.05, 0.1, 0.15, 0.2), betas: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9), last: int | None = None, rounds: int = 0) -> DataFrame:
    """M3: one-step GARCH(1,1) volatility of every row from ``min_train`` on, with variance targeting.

    Returns are taken times 100 around the mean of the rows before. Parameters are chosen anew every ``every`` rows (a fold): the grid point of the
    largest likelihood of the earlier rows, then ``rounds`` refinements around it. ``last`` forecasts only so many last rows. A key's days are one group, of bounded
    length like a window over it; blocks of its folds run through them side by side, keys and blocks being rows of one job.
    """
    w = Window.partitionBy(by).orderBy(on)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_p": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(by))})
    grid = np.array([(a, b) for a in alphas for b in betas if a + b < 1])
    start = F.lit(min_train) if last is None else F.greatest(F.lit(min_train), F.col("_n") - last)
    span = GARCH_FOLDS * every
    blocks = F.when(F.col("_n") > start, F.sequence(F.lit(0), F.floor((F.col("_n") - 1 - start) / span).cast("int")))
    # A block needs the days up to its end only.
    each = rows.select(by, "_p", F.col(value).cast("double").alias("_r"), F.col("_n").cast("int").alias("_n"), start.cast("int").alias("_from"), F.explode(blocks).alias("_block"))
    each = each.filter(F.col("_p") < F.col("_from") + (F.col("_block") + 1) * span)

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_p")
        first = int(own["_from"].iloc[0]) + int(own["_block"].iloc[0]) * span
        starts = np.arange(first, min(first + span, int(own["_n"].iloc[0])), every)
        found = pd.DataFrame(garch_paths(own["_r"].to_numpy() * 100, starts, every, grid, rounds), columns=["_p", "alpha", "beta", "volatility"])
        found.insert(0, by, own[by].iloc[0])
        return found.astype({"_p": "int32"})

    kind = df.schema[by].dataType.simpleString()
    out = dealt(each, by, "_block").groupBy(by, "_block").applyInPandas(work, f"{by} {kind}, _p int, alpha double, beta double, volatility double")
    return out.join(rows, [by, "_p"]).drop("_p", "_n")


def calibrate(df: DataFrame, y: str, xs: list[str], by: str = "instrument", name: str = "prediction") -> DataFrame:
    """M5, M6: fit y on xs over the validation rows of each key, predict all rows; also the p-value of the last regressor (``name``_p)
    and of each (``name``_p_ and the regressor)."""
    from tidemark.operators.regression import ols

    fit = ols(df.filter("split = 'validation'"), [by], y, xs).select(by, F.col("coef").alias("_c"), F.col("se").alias("_s"), F.col("n").alias("_n"))
    value = reduce(lambda a, b: a + b, [F.col("_c")[i + 1] * F.col(x) for i, x in enumerate(xs)], F.col("_c")[0])
    k = len(xs)
    p = {x: dist.t_two_sided(F.try_divide(F.col("_c")[i], F.col("_s")[i]), F.col("_n") - k - 1) for i, x in enumerate(xs, 1)}
    own = fit.withColumns({f"{name}_p_{x}": p[x] for x in xs} | {f"{name}_p": p[xs[-1]]})
    return df.join(own, by, "left").withColumn(name, value).drop("_c", "_s", "_n")


@F.pandas_udf(ArrayType(DoubleType()))
def _ridge(n: pd.Series, mean: pd.Series, cov: pd.Series, alpha: pd.Series) -> pd.Series:
    """Coefficients (constant first) on the original scale of ridge regression on standardised regressors."""
    out = []
    for a, b, c, al in zip(n, mean, cov, alpha):
        m = np.array(b, float)
        k = len(m)
        c = np.array(c, float).reshape(k, k)
        sd = np.sqrt(np.diag(c)[1:])
        if a < 2 or not np.isfinite(c).all():
            out.append(None)
            continue
        sd = np.where(sd > 0, sd, 1.0)
        z = c[1:, 1:] / np.outer(sd, sd)
        beta = np.linalg.solve(a * z + al * np.eye(k - 1), a * c[1:, 0] / sd) / sd
        out.append([m[0] - beta @ m[1:], *beta])
    return pd.Series(out)


def ridge(df: DataFrame, y: str, xs: list[str], by: str = "instrument", alphas: tuple[float, ...] = ALPHAS, name: str = "prediction") -> DataFrame:
    """M7: standardised ridge; alpha by expanding time-ordered folds over the validation rows (max(2, min(3, n // 12)) of them), then fitted to all of them.

    All keys, folds and alphas are rows of one job: sums by key and fold, then closed-form solutions.
    """
    from tidemark.operators.regression import complete, moments

    rows = complete(df, [y, *xs])
    own = rows.filter("split = 'validation'")
    w = Window.partitionBy(by)
    own = own.withColumns({"_i": F.row_number().over(w.orderBy("position")) - 1, "_n": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.lit(2), F.least(F.lit(3), F.floor(F.col("_n") / 12))).cast("int")
    size = F.floor(F.col("_n") / (k + 1))
    # Test block j (1 to k) holds rows n-(k-j+1)*size up to the next; what comes before trains it.
    block = F.greatest(F.lit(0), F.floor((F.col("_i") - (F.col("_n") - k * size)) / size) + 1).cast("int")
    own = own.withColumns({"_k": k, "_block": block})
    trains = own.withColumn("_fold", F.explode(F.sequence(F.col("_block") + 1, F.col("_k") + 1)))  # fold k+1: all rows
    fits = trains.groupBy(by, "_fold", "_k").agg(*moments(y, xs)).withColumn("_alpha", F.explode(F.array(*map(F.lit, alphas))))
    fits = fits.withColumn("_c", _ridge("n", "mean", "cov", "_alpha")).select(by, "_fold", "_k", "_alpha", "_c")
    value = reduce(lambda a, b: a + b, [F.col("_c")[i + 1] * F.col(x) for i, x in enumerate(xs)], F.col("_c")[0])
    tests = own.filter("_block > 0").select(by, F.col("_block").alias("_fold"), y, *xs).join(fits.filter("_fold <= _k").drop("_k"), [by, "_fold"])
    error = tests.groupBy(by, "_fold", "_alpha").agg(F.avg(F.pow(F.col(y) - value, F.lit(2))).alias("_e")).groupBy(by, "_alpha").agg(F.avg("_e").alias("_e"))
    best = error.groupBy(by).agg(F.min_by("_alpha", F.struct("_e", "_alpha")).alias("_alpha"))
    final = fits.filter("_fold = _k + 1").select(by, "_alpha", "_c").join(best, [by, "_alpha"])
    return df.join(final, by, "left").withColumn(name, value).withColumnRenamed("_alpha", f"{name}_alpha").drop("_c")


def _fit_trees(train: DataFrame, rows: DataFrame, y: str, xs: list[str], by: str, params: dict | None) -> DataFrame:
    """rows with the prediction of trees fitted to train; the instrument is a feature."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    settings = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, "maxBins": 64} | (params or {})
    steps = [StringIndexer(inputCol=by, outputCol="_instrument", handleInvalid="keep"), VectorAssembler(inputCols=["_instrument", *xs], outputCol="_features"), GBTRegressor(featuresCol="_features", labelCol=y, **settings)]
    known = [y, *xs]
    return Pipeline(stages=steps).fit(train.na.drop(subset=known)).transform(rows.na.drop(subset=known)).drop("_features", "_instrument")


def tree_walk_forward(df: DataFrame, y: str, xs: list[str], cutoffs: list, by: str = "instrument", on: str = "date", params: dict | None = None, parallel: int = 4) -> DataFrame:
    """Boosted trees on the pooled panel, fitted anew at each cutoff date to earlier rows, predicting rows from it up to the next.

    The loop runs over cutoffs, a few at a time; each fit is a Spark job over all instruments."""

    def one(span: tuple) -> DataFrame:
        start, end = span
        own = df.filter(F.col(on) >= F.lit(start))
        return _fit_trees(df.filter(F.col(on) < F.lit(start)), own if end is None else own.filter(F.col(on) < F.lit(end)), y, xs, by, params)

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, zip(cutoffs, [*cutoffs[1:], None])))
    return reduce(DataFrame.unionByName, parts)


#: The parameters that the search draws from (the third-party penalty on weights has no counterpart in Spark's trees).
TREE_GRID = {
    "maxDepth": (2, 3, 4), "maxIter": (50, 100, 150, 200), "stepSize": (0.01, 0.03, 0.05, 0.1, 0.15), "subsamplingRate": (0.6, 0.7, 0.8, 0.9, 1.0),
    "featureSubsetStrategy": ("0.6", "0.7", "0.8", "1.0"), "minInstancesPerNode": (1, 3, 5),
}


def draw_parameters(n: int = 150, seed: int = 42, grid: dict[str, tuple] = TREE_GRID) -> list[dict]:
    """M9: n different combinations of the grid, drawn at random; all of them if there are fewer."""
    import random

    sizes = [len(v) for v in grid.values()]
    total = int(np.prod(sizes))
    out = []
    for k in random.Random(seed).sample(range(total), min(n, total)):
        chosen = {}
        for (name, values), size in zip(grid.items(), sizes):
            chosen[name], k = values[k % size], k // size
        out.append(chosen)
    return out


def row_folds(df: DataFrame, by: str = "instrument", on: str = "date", folds: int = 4, size: int = 10) -> DataFrame:
    """M9: the rows before the holdout once for each fold they belong to: fold (1 to ``folds``) and test. A fold tests ``size`` rows of each
    instrument, the last fold the last ones, and is trained on all rows before them."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(on))) - 1
    rows = df.filter("split <> 'holdout'").withColumn("_back", back).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    later = (folds - F.col("fold")) * size
    return rows.filter(F.col("_back") >= later).withColumn("test", F.col("_back") < later + size).drop("_back")


def tune_trees(df: DataFrame, y: str, xs: list[str], grid: list[dict], by: str = "instrument", on: str = "date", folds: int = 4, size: int = 10, parallel: int = 4) -> tuple[dict, list[tuple[dict, float]]]:
    """M9: the parameters of the least root mean squared error, the mean over the folds; a few fits at a time, each a Spark job over all instruments."""
    from tidemark.sources.shared import discard, settle

    cut = settle(row_folds(df, by, on, folds, size), "folds")

    def one(job: tuple) -> float:
        params, fold = job
        own = cut.filter(F.col("fold") == fold)
        out = _fit_trees(own.filter("NOT test"), own.filter("test"), y, xs, by, params)
        return out.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col("prediction"), F.lit(2))))).first()[0]

    with ThreadPoolExecutor(parallel) as pool:
        errors = list(pool.map(one, [(p, f) for p in grid for f in range(1, folds + 1)]))
    discard(cut)
    scored = [(p, sum(errors[i * folds : (i + 1) * folds]) / folds) for i, p in enumerate(grid)]
    return min(scored, key=lambda s: s[1])[0], scored


def accuracy(df: DataFrame, actual: str, models: dict[str, str], by: list[str]) -> DataFrame:
    """Rmse, mae and n of each model (name and column), long."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(actual) - F.col(c)).alias("e")) for m, c in models.items()]))
    rows = df.select(*by, each.alias("x")).select(*by, "x.*").filter(F.col("e").isNotNull())
    return rows.groupBy(*by, "model").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.count(F.lit(1)).alias("n"))


def loss_difference(actual: str, one: str, two: str) -> Column:
    return F.pow(F.col(actual) - F.col(one), F.lit(2)) - F.pow(F.col(actual) - F.col(two), F.lit(2))


def diebold_mariano(df: DataFrame, actual: str, one: str, two: str, by: list[str]) -> DataFrame:
    """Mean difference of squared errors over its standard error; null without spread."""
    from tidemark.operators.testing import t_test

    return t_test(df.withColumn("_d", loss_difference(actual, one, two)), by, "_d")


def long_run_variance(df: DataFrame, value: str, by: list[str], order: str, max_lag: int) -> DataFrame:
    """N, mean and Bartlett long-run variance (autocovariances over n, floor 1e-12) of each key's series."""
    rows = df.filter(F.col(value).isNotNull())
    keys = by or [F.lit(0).alias("_all")]
    mean = F.avg(value).over(Window.partitionBy(*(by or [F.lit(0)])))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    rows = rows.withColumns({"_mean": mean}).withColumn("_c", F.col(value) - F.col("_mean"))
    rows = rows.withColumns({f"_c{i}": F.lag("_c", i).over(w) for i in range(1, max_lag + 1)})
    g = lambda i: F.coalesce(F.sum(F.col("_c") * F.col(f"_c{i}" if i else "_c")), F.lit(0.0)) / F.count(F.lit(1))
    var = reduce(lambda a, b: a + b, [2 * (1 - i / (max_lag + 1)) * g(i) for i in range(1, max_lag + 1)], g(0))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.greatest(var, F.lit(1e-12)).alias("variance"))
    return out if by else out.drop("_all")


def dm_hac(df: DataFrame, actual: str, one: str, two: str, by: list[str], order: str, max_lag: int) -> DataFrame:
    """Diebold-Mariano with the long-run variance: n, mean, statistic, p_value."""
    v = long_run_variance(df.withColumn("_d", loss_difference(actual, one, two)), "_d", by, order, max_lag)
    t = F.col("mean") / F.sqrt(F.col("variance") / F.col("n"))
    return v.withColumn("statistic", t).withColumn("p_value", dist.t_two_sided(F.col("statistic"), F.col("n") - 1)).drop("variance")


def dm_hac_all(df: DataFrame, actual: str, comparisons: dict[str, tuple[str, str]], by: list[str], order: str, max_lag: int) -> DataFrame:
    """The Diebold-Mariano test of several pairs of models, a row for each key and comparison: comparisons are rows of one job."""
    each = F.array(*[F.struct(F.lit(n).alias("comparison"), loss_difference(actual, one, two).alias("_d")) for n, (one, two) in comparisons.items()])
    long = df.select(*by, order, F.explode(each).alias("_x")).select(*by, order, "_x.*")
    v = long_run_variance(long, "_d", [*by, "comparison"], order, max_lag)
    t = F.col("mean") / F.sqrt(F.col("variance") / F.col("n"))
    return v.withColumn("statistic", t).withColumn("p_value", dist.t_two_sided(F.col("statistic"), F.col("n") - 1)).drop("variance")


def pooled_by_date(df: DataFrame, actual: str, one: str, two: str, order: str, max_lag: int, by: str = "instrument") -> DataFrame:
    """Differences scaled by each instrument's deviation (0 without spread), averaged by date: HAC t-test and sign test over dates."""
    rows = df.withColumn("_d", loss_difference(actual, one, two))
    sd = F.stddev_samp("_d").over(Window.partitionBy(by))
    daily = rows.withColumn("_s", F.when(sd > 0, F.col("_d") / sd).otherwise(0.0)).groupBy(order).agg(F.avg("_s").alias("_m"))
    v = long_run_variance(daily, "_m", [], order, max_lag)
    sign = daily.agg(F.count_if(F.col("_m") != 0).alias("used"), F.count_if(F.col("_m") > 0).alias("positive"))
    out = v.withColumn("_o", F.lit(1)).join(sign.withColumn("_o", F.lit(1)), "_o").drop("_o").withColumn("statistic", F.col("mean") / F.sqrt(F.col("variance") / F.col("n")))
    return out.withColumns({"p_value": dist.t_two_sided(F.col("statistic"), F.col("n") - 1), "p_sign": dist.binomial_two_sided(F.col("used"), F.col("positive"))}).drop("variance")
