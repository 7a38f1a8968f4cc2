"""Regressions and the tests built on them, for all keys and specs at once.

A regression is one grouped aggregate of means and covariances (numerically stable and combined before the shuffle),
and a k x k solve in an Arrow UDF over one row per key. Lagged terms are windows over the complete rows of a key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from tidemark.functions import dist

_DOUBLES = ArrayType(DoubleType())
FIT = StructType().add("coef", _DOUBLES).add("se", _DOUBLES).add("ssr", DoubleType()).add("r2", DoubleType()).add("n", LongType()).add("status", StringType())


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """A1: infinite values become null, then rows with a null in the columns go; what comes after (lags) bridges the gaps."""
    clean = df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns})
    return clean.na.drop(subset=columns)


def moments(y: str, xs: list[str], where: Column | None = None) -> list[Column]:
    """Aggregates n, mean and cov (row by row over y and xs) of rows that pass ``where``."""
    cols = [F.col(c) if where is None else F.when(where, F.col(c)) for c in (y, *xs)]
    m = len(cols)
    half = {(i, j): F.covar_pop(cols[i], cols[j]) for i in range(m) for j in range(i, m)}
    return [F.count(cols[0]).alias("n"), F.array(*map(F.avg, cols)).alias("mean"), F.array(*[half[min(i, j), max(i, j)] for i in range(m) for j in range(m)]).alias("cov")]


def solve(n: int, mean: np.ndarray, cov: np.ndarray, use: int) -> dict:
    """Least squares of the first variable on a constant and the next ``use``."""
    bad = {"coef": None, "se": None, "ssr": None, "r2": None, "n": n, "status": "ERROR"}
    if n <= use + 1:
        return bad | {"status": "SKIP_TOO_FEW"}
    m = int(round(len(cov) ** 0.5))
    c = cov.reshape(m, m)
    x, y = c[1 : use + 1, 1 : use + 1], c[1 : use + 1, 0]
    scale = np.sqrt(np.diag(x))
    if not np.isfinite(c).all() or (scale <= 0).any() or (use and np.linalg.matrix_rank(x / np.outer(scale, scale), tol=1e-9) < use):
        return bad
    inverse = np.linalg.inv(x / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ y
    ssr = max(n * (c[0, 0] - beta @ y), 0.0)
    s2, mu = ssr / (n - use - 1), mean[1 : use + 1]
    var = s2 * np.concatenate([[1 / n + mu @ inverse @ mu / n], np.diag(inverse) / n])
    r2 = 1 - ssr / (n * c[0, 0]) if c[0, 0] > 0 else None
    return {"coef": [mean[0] - beta @ mu, *beta], "se": np.sqrt(var).tolist(), "ssr": ssr, "r2": r2, "n": n, "status": "OK"}


@F.pandas_udf(FIT)
def fitted(n: pd.Series, mean: pd.Series, cov: pd.Series, use: pd.Series) -> pd.DataFrame:
    rows = [solve(int(a), np.array(b, float), np.array(c, float), int(u)) for a, b, c, u in zip(n, mean, cov, use)]
    return pd.DataFrame(rows, columns=["coef", "se", "ssr", "r2", "n", "status"])


def ols(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """By, coef (constant first), se, ssr, r2, n and status of y on xs."""
    sums = complete(df, [y, *xs]).groupBy(*by).agg(*moments(y, xs))
    return sums.withColumn("fit", fitted("n", "mean", "cov", F.lit(len(xs)))).select(*by, "fit.*")


def specs(df: DataFrame, pairs: list[tuple[str, str, str]], by: list[str], keep: list[str]) -> DataFrame:
    """Wide rows as long rows of analysis, y, x and ``keep``, so that one job fits all (analysis, outcome, predictor) specs."""
    each = F.array(*[F.struct(F.lit(n).alias("analysis"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")) for n, y, x in pairs])
    return df.select(*by, *keep, F.explode(each).alias("s")).select(*by, *keep, "s.*")


@F.pandas_udf(StructType().add("coef", _DOUBLES).add("hac_se", _DOUBLES))
def _sandwich(n: pd.Series, xtx: pd.Series, meat: pd.Series, coef: pd.Series) -> pd.DataFrame:
    out = []
    for a, m, b in zip(xtx, meat, coef):
        if b is None or a is None:
            out.append((None, None))
            continue
        k = len(b)
        inverse = np.linalg.inv(np.array(a, float).reshape(k, k))
        v = np.diag(inverse @ np.array(m, float).reshape(k, k) @ inverse)
        out.append((list(b), np.sqrt(np.maximum(v, 0)).tolist()))
    return pd.DataFrame(out, columns=["coef", "hac_se"])


def hac_ols(df: DataFrame, by: list[str], y: str, xs: list[str], order: str = "date", max_lags: int = 3, least: int = 20) -> DataFrame:
    """Ordinary least squares with Newey-West errors (Bartlett weights, no small-sample factor): status, n, r2, coef, hac_se, z and p_value
    of the first predictor. Too few rows or a constant predictor are skipped; collinear controls are an ERROR."""
    rows = complete(df, [y, *xs])
    flat = rows.groupBy(*by).agg(*moments(y, xs), (F.min(xs[0]) == F.max(xs[0])).alias("constant"))
    fits = flat.withColumn("fit", fitted("n", "mean", "cov", F.lit(len(xs)))).select(*by, "constant", "fit.*")
    joined = rows.join(fits.select(*by, "coef"), by).filter(F.col("coef").isNotNull())
    vector = [F.lit(1.0), *map(F.col, xs)]
    error = F.col(y) - reduce(lambda a, b: a + b, [F.col("coef")[i] * v for i, v in enumerate(vector)])
    w, k = Window.partitionBy(*by).orderBy(order), len(vector)
    scored = joined.select(*by, order, *xs, error.alias("_e")).select(*by, order, *xs, *[(v * F.col("_e")).alias(f"_g{i}") for i, v in enumerate(vector)])
    for lag in range(1, max_lags + 1):
        scored = scored.withColumns({f"_g{i}_{lag}": F.lag(f"_g{i}", lag).over(w) for i in range(k)})
    weight = lambda lag: 1 - lag / (max_lags + 1)
    gamma = lambda i, j, lag: F.coalesce(F.sum(F.col(f"_g{i}") * F.col(f"_g{j}_{lag}")), F.lit(0.0))
    meat = [F.sum(F.col(f"_g{i}") * F.col(f"_g{j}")) + sum((weight(lag) * (gamma(i, j, lag) + gamma(j, i, lag)) for lag in range(1, max_lags + 1)), F.lit(0.0)) for i in range(k) for j in range(k)]
    xtx = [F.sum(a * b) for a in vector for b in vector]
    sums = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array(*xtx).alias("_xtx"), F.array(*meat).alias("_meat"))
    out = fits.join(sums, by, "left").withColumn("v", _sandwich("_n", "_xtx", "_meat", "coef"))
    status = F.when(F.col("n") < least, "SKIP_TOO_FEW").when(F.col("constant"), "SKIP_CONSTANT").otherwise(F.col("status"))
    ok, z = F.col("status") == "OK", F.col("v.coef")[1] / F.col("v.hac_se")[1]
    out = out.withColumn("status", status)
    return out.select(*by, "status", "n", F.when(ok, F.col("r2")).alias("r2"), F.when(ok, F.col("v.coef")[1]).alias("coef"), F.when(ok, F.col("v.hac_se")[1]).alias("hac_se"),
                      F.when(ok, z).alias("z"), F.when(ok, dist.two_sided_normal(z)).alias("p_value"))


def _adf_moments(df: DataFrame, by: list[str], value: str, order: str, max_lag: int, lags: list[int], common: bool) -> DataFrame:
    """One row per key: rows, whether the value is constant, and the fit of each lag on its own sample (o0, o1, ...) and, if asked for, on the
    sample that all lags share (c0, c1, ...)."""
    rows = complete(df, [value])
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_y1", F.lag(value).over(w)).withColumn("_d", F.col(value) - F.col("_y1"))
    rows = rows.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, max_lag + 1)})
    xs = ["_y1", *[f"_d{i}" for i in range(1, max_lag + 1)]]
    known = lambda p: F.col(f"_d{p}" if p else "_d").isNotNull()
    samples = {f"own{p}": moments("_d", xs[: p + 1], known(p)) for p in lags} | ({"common": moments("_d", xs, known(max_lag))} if common else {})
    flat = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), (F.min(value) == F.max(value)).alias("constant"), *[F.struct(*m).alias(n) for n, m in samples.items()])
    fit = lambda s, p: fitted(F.col(f"{s}.n"), F.col(f"{s}.mean"), F.col(f"{s}.cov"), F.lit(p + 1))
    return flat.withColumns({f"o{p}": fit(f"own{p}", p) for p in lags} | ({f"c{p}": fit("common", p) for p in lags} if common else {}))


def _adf_result(by: list[str], own: Column, lag: Column, least: int, alpha: float) -> list[Column]:
    tau = own["coef"][1] / own["se"][1]
    ok = (F.col("rows") >= least) & ~F.col("constant")
    p_value = dist.adf_p(tau)
    status = (F.when(F.col("rows") < least, "SKIP_TOO_FEW").when(F.col("constant"), "SKIP_CONSTANT").when(tau.isNull(), "ERROR")
              .when(p_value < alpha, "STATIONARY_5PCT").otherwise("NONSTATIONARY_5PCT"))
    return [*map(F.col, by), status.alias("status"), F.col("rows").alias("n"), F.when(ok, lag).alias("lag"), F.when(ok, tau).alias("statistic"), F.when(ok, p_value).alias("p_value")]


def adf(df: DataFrame, by: list[str], value: str, order: str = "date", max_lag: int = 3, least: int = 20, alpha: float = 0.05) -> DataFrame:
    """A2: Dickey-Fuller test with a constant; the lag has the least AIC on the sample that all lags share, and is fitted again on its own longer
    sample. status, n, lag, statistic, p_value."""
    lags = list(range(max_lag + 1))
    flat = _adf_moments(df, by, value, order, max_lag, lags, True)
    aic = lambda p: F.when(F.col(f"c{p}.ssr") > 0, F.col(f"c{p}.n") * F.ln(F.col(f"c{p}.ssr") / F.col(f"c{p}.n")) + 2.0 * (p + 2))
    best = F.array_min(F.array(*[F.when(aic(p).isNotNull(), F.struct(aic(p).alias("aic"), F.lit(p).alias("lag"))) for p in lags]))["lag"]
    flat = flat.withColumn("lag", best).withColumn("own", F.coalesce(*[F.when(F.col("lag") == p, F.col(f"o{p}")) for p in lags]))
    return flat.select(*_adf_result(by, F.col("own"), F.col("lag"), least, alpha))


def adf_fixed(df: DataFrame, by: list[str], value: str, lags: list[int], order: str = "date", least: int = 20, alpha: float = 0.05) -> DataFrame:
    """A3: the test at each of the given lags, a row for each; one pass and one aggregate for all of them."""
    flat = _adf_moments(df, by, value, order, max(lags), lags, False)
    each = flat.withColumn("f", F.explode(F.array(*[F.struct(F.lit(p).alias("lag"), F.col(f"o{p}").alias("own")) for p in lags])))
    return each.select(*_adf_result(by, F.col("f.own"), F.col("f.lag"), least, alpha))


def present(df: DataFrame, controls: list[str]) -> list[str]:
    """Those of the controls that the rows have."""
    return [c for c in controls if c in df.columns]


def granger(df: DataFrame, by: list[str], outcome: str, cause: str, order: str = "date", max_lag: int = 3, least: int = 25) -> DataFrame:
    """F-test that lags of the cause add to lags of the outcome; a row per key and lag: lag, status, n, statistic, p_value."""
    rows = complete(df, [outcome, cause])
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumns({f"_{v}{i}": F.lag(c, i).over(w) for v, c in (("y", outcome), ("x", cause)) for i in range(1, max_lag + 1)})
    aggs = [F.count(F.lit(1)).alias("rows"), ((F.min(outcome) == F.max(outcome)) | (F.min(cause) == F.max(cause))).alias("constant")]
    for p in range(1, max_lag + 1):
        xs = [f"_y{i}" for i in range(1, p + 1)] + [f"_x{i}" for i in range(1, p + 1)]
        aggs.append(F.struct(*moments(outcome, xs, F.col(f"_y{p}").isNotNull())).alias(f"m{p}"))
    flat = rows.groupBy(*by).agg(*aggs)
    each = []
    for p in range(1, max_lag + 1):
        m = [F.col(f"m{p}.{c}") for c in ("n", "mean", "cov")]
        flat = flat.withColumns({f"r{p}": fitted(*m, F.lit(p)), f"u{p}": fitted(*m, F.lit(2 * p))})
        free = F.col(f"m{p}.n") - 2 * p - 1
        f = F.try_divide((F.col(f"r{p}.ssr") - F.col(f"u{p}.ssr")) / p, F.col(f"u{p}.ssr") / free)
        each.append(F.struct(F.lit(p).alias("lag"), F.col(f"m{p}.n").alias("used"), f.alias("f"), free.cast("double").alias("free")))
    long = flat.select(*by, "rows", "constant", F.explode(F.array(*each)).alias("t")).select(*by, "rows", "constant", "t.*")
    status = F.when(F.col("rows") < least, "SKIP_TOO_FEW").when(F.col("constant"), "SKIP_CONSTANT").when(F.col("f").isNull(), "ERROR").otherwise("OK")
    out = long.withColumn("status", status).withColumn("p", dist.f_tail("f", F.col("lag").cast("double"), "free"))
    ok = F.col("status") == "OK"
    return out.select(*by, "lag", "status", F.col("rows").alias("n"), F.when(ok, F.col("f")).alias("statistic"), F.when(ok, F.col("p")).alias("p_value"))
