import datetime as dt
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import events, features, models, regression, testing


def series(spark, columns: dict, key="a"):
    n = len(next(iter(columns.values())))
    rows = [(key, dt.date(2024, 1, 1) + dt.timedelta(days=i), *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "instrument string, date date, " + ", ".join(f"{c} double" for c in columns))


RNG = np.random.default_rng(3)


def lstsq(y, xs):
    a = np.column_stack([np.ones(len(y)), *xs])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ b
    return a, b, e


def test_distributions(spark):
    df = spark.createDataFrame([(1.96, 2.228, 4.96, 10.0)], "z double, t double, f double, n double")
    r = df.select(dist.normal_cdf(F.col("z")).alias("z"), dist.t_two_sided(F.col("t"), F.col("n")).alias("t"), dist.f_tail("f", F.lit(1.0), "n").alias("f"), dist.binomial_tail(F.lit(10), F.lit(8)).alias("b"),
                  dist.binomial_two_sided(F.lit(10), F.lit(8)).alias("b2"), dist.adf_p(F.lit(-2.86)).alias("adf")).first()
    assert abs(r.z - 0.9750021) < 2e-7 and abs(r.t - 0.05) < 1e-4 and abs(r.f - 0.05) < 1e-3
    assert abs(r.b - 56 / 1024) < 1e-12 and abs(r.b2 - 112 / 1024) < 1e-12 and abs(r.adf - 0.05) < 0.002


def test_ols_and_hac(spark):
    x, c = RNG.normal(size=60), RNG.normal(size=60)
    y = 1 + 2 * x - c + RNG.normal(size=60)
    df = series(spark, {"y": y, "x": x, "c": c})
    a, b, e = lstsq(y, [x, c])
    fit = regression.ols(df, ["instrument"], "y", ["x", "c"]).first()
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (e @ e) / 57)
    assert np.allclose(fit.coef, b) and np.allclose(fit.se, se) and fit.status == "OK"
    g = a * e[:, None]
    meat = g.T @ g
    for lag in (1, 2, 3):
        gamma = g[lag:].T @ g[:-lag]
        meat += (1 - lag / 4) * (gamma + gamma.T)
    inverse = np.linalg.inv(a.T @ a)
    want = math.sqrt((inverse @ meat @ inverse)[1, 1])
    hac = regression.hac_ols(df, ["instrument"], "y", ["x", "c"]).first()
    assert abs(hac.coef - b[1]) < 1e-9 and abs(hac.hac_se - want) < 1e-9
    assert regression.hac_ols(df.limit(19), ["instrument"], "y", ["x"]).first().status == "SKIP_TOO_FEW"
    assert regression.hac_ols(df.withColumn("x", F.lit(1.0)), ["instrument"], "y", ["x"]).first().status == "SKIP_CONSTANT"
    assert regression.hac_ols(df.withColumn("c", F.col("x") * 2), ["instrument"], "y", ["x", "c"]).first().status == "ERROR"


def test_adf_and_granger(spark):
    y = np.cumsum(RNG.normal(size=80)) * 0.3
    x = RNG.normal(size=80)
    df = series(spark, {"y": y, "x": x})
    d = np.diff(y)
    _, b, e = lstsq(d[2:], [y[2:-1], d[1:-1], d[:-2]])
    a = np.column_stack([np.ones(len(d) - 2), y[2:-1], d[1:-1], d[:-2]])
    tau = b[1] / math.sqrt(np.linalg.inv(a.T @ a)[1, 1] * (e @ e) / (len(e) - 4))
    got = regression.adf_fixed(df, ["instrument"], "y", [2]).first()
    assert abs(got.statistic - tau) < 1e-8 and got.lag == 2
    aic = []
    for p in range(4):
        rows = range(3, 79)
        xs = [np.array([y[t] for t in rows])] + [np.array([d[t - i] for t in rows]) for i in range(1, p + 1)]
        _, _, e = lstsq(np.array([d[t] for t in rows]), xs)
        aic.append(len(e) * math.log(e @ e / len(e)) + 2 * (p + 2))
    assert regression.adf(df, ["instrument"], "y").first().lag == int(np.argmin(aic))
    assert regression.adf(df.limit(19), ["instrument"], "y").first().status == "SKIP_TOO_FEW"
    out = {r.lag: r for r in regression.granger(df, ["instrument"], "y", "x").collect()}
    for p in (1, 2, 3):
        t = np.arange(p, 80)
        own, cause = [y[t - i] for i in range(1, p + 1)], [x[t - i] for i in range(1, p + 1)]
        r, u = (lstsq(y[t], xs)[2] for xs in (own, own + cause))
        f = ((r @ r - u @ u) / p) / (u @ u / (len(t) - 2 * p - 1))
        assert abs(out[p].statistic - f) < 1e-7 and 0 <= out[p].p_value <= 1
    assert {r.status for r in regression.granger(df.limit(24), ["instrument"], "y", "x").collect()} == {"SKIP_TOO_FEW"}


def test_multiple_testing(spark):
    p = [0.01, 0.04, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame([(i, v, "OK" if i != 5 else "SKIP") for i, v in enumerate(p)], "i int, p_value double, status string")
    got = {r.i: r for r in testing.adjust(df).collect()}
    assert [round(got[i].p_bh, 9) for i in range(4)] == [0.04, 0.04, 0.04, 0.04] and got[4].p_bh is None and got[5].p_bh is None and not got[5].reject_bh
    assert [round(got[i].p_bonferroni, 9) for i in range(4)] == [0.04, 0.16, 0.16, 0.12]


def test_wilcoxon_exact(spark):
    values = [1.1, -2.2, 3.3, 4.4, -5.5, 6.6, 7.7]
    ranks = np.argsort(np.argsort(np.abs(values))) + 1
    w = ranks[np.array(values) > 0].sum()
    sums = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    less = np.mean([s <= w for s in sums])
    both = min(1, 2 * np.mean([s <= min(w, 28 - w) for s in sums]))
    df = spark.createDataFrame([("a", v) for v in values] + [("z", 0.0), ("z", 0.0), ("o", 1.0)], "k string, v double")
    got = {r.k: r for r in testing.wilcoxon(df, ["k"], "v").collect()}
    assert abs(got["a"].p_less - less) < 1e-12 and abs(got["a"].p_two_sided - both) < 1e-12
    assert got["z"].p_two_sided == 1.0 and got["o"].p_two_sided is None


def test_event_selection(spark):
    tagged = spark.createDataFrame([("a", "s", "negative", p, e) for p, e in ((10, 5.0), (15, 4.0), (16, 4.0), (4, 4.0), (30, 1.0), (36, 1.0), (40, 1.0))], "instrument string, session string, direction string, position int, extremeness double")
    assert sorted(r.position for r in events.select_events(tagged).collect()) == [4, 10, 16, 30, 36]


def test_incomplete_windows_are_dropped(spark):
    ar = spark.createDataFrame([("e", "a", "overnight", "negative", t, 0.1) for t in (0, 1, 2, 3)], "event_id string, instrument string, session string, direction string, tau int, abnormal_return double")
    assert {(r["first"], r["last"]) for r in events.car(ar).collect()} == {(0, 0), (0, 1), (0, 3)}


def test_rolling_and_fill(spark):
    df = series(spark, {"close": [1, 2, 4, 8, 9, 10, 12], "open": [1] * 7, "high": [2] * 7, "low": [1] * 7})
    out = features.price_features(df).orderBy("date").collect()
    assert [r.rolling_volatility is None for r in out] == [True] * 5 + [False] * 2
    assert abs(out[0].parkinson_volatility - math.sqrt(math.log(2) ** 2 / (4 * math.log(2)))) < 1e-12
    s = features.forward_fill(series(spark, {"x": [None, 1, None, 3]}), ["x"]).orderBy("date").collect()
    assert [r.x_ffill for r in s] == [None, 1, 1, 3]
    s = features.previous_known(series(spark, {"x": [None, 1, None, 3]}), ["x"]).orderBy("date").collect()
    assert [r.x for r in s] == [None, None, 1, 1]


def test_walk_forward_equals_refit(spark):
    x, y = RNG.normal(size=70), RNG.normal(size=70)
    got = [r.prediction for r in models.expanding_line(series(spark, {"x": x, "y": y}), "y", "x").orderBy("date").collect()]
    assert got[49] is None
    for i in (50, 69):
        slope, start = np.polyfit(x[:i], y[:i], 1)
        assert abs(got[i] - (start + slope * x[i])) < 1e-8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_garch_query_forecasts_every_row(spark):
    from tidemark.plans import model_queries, tables

    d = "/root/testdata/sf0.001"
    rows = {r.instrument: r.n for r in tables.analysis(spark, d).filter("cc_return IS NOT NULL").groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.instrument: r.n for r in model_queries.m3_garch_grid(spark, d).groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: n - models.MIN_TRAIN for k, n in rows.items() if n > models.MIN_TRAIN} and max(got.values()) > 60


def test_garch_recursion(spark):
    r = RNG.normal(0, 0.02, 80)
    out = models.garch_forecast(series(spark, {"cc_return": r}), every=10).orderBy("date").collect()
    assert len(out) == 30
    row, past = out[0], r[:50] * 100
    m, v = past.mean(), past.var()
    best = None
    for a in (0.02, 0.05, 0.1, 0.15, 0.2):
        for b in (0.5, 0.6, 0.7, 0.8, 0.9):
            if a + b < 1:
                s, like = v, 0.0
                for e in past - m:
                    n = (1 - a - b) * v + a * e * e + b * s
                    like, s = like - math.log(s) - e * e / s, n
                best = max(best or (like, a, b, s), (like, a, b, s))
    assert (row.alpha, row.beta) == best[1:3] and abs(row.volatility - math.sqrt(best[3]) / 100) < 1e-10


def test_ridge_and_comparisons(spark):
    n = 80
    x = RNG.normal(size=n)
    df = models.split(series(spark, {"x": x, "z": RNG.normal(size=n), "y": 2 * x + RNG.normal(size=n) * 0.1}))
    assert [r["count"] for r in df.groupBy("split").count().orderBy("split").collect()] == [15, 50, 15]
    out = models.ridge(df, "y", ["x", "z"]).filter("split = 'holdout'")
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1.5
    d = RNG.normal(size=30)
    v = models.long_run_variance(series(spark, {"d": d}), "d", ["instrument"], "date", 0).first()
    assert abs(v.variance - d.var()) < 1e-12
    same = series(spark, {"actual": d, "p": d, "q": d})
    assert models.diebold_mariano(same, "actual", "p", "q", ["instrument"]).first().statistic is None
    pooled = models.pooled_by_date(same, "actual", "p", "q", "date", 1).first()
    assert pooled.mean == 0 and pooled.n == 30


def test_ridge_equals_brute_force(spark):
    """Alpha by expanding folds over the validation rows, then the fit on all of them, by plain matrices."""
    n = 120
    x = RNG.normal(size=(n, 3)) * [1, 5, 0.1]
    y = x @ [0.5, -0.1, 3.0] + RNG.normal(size=n)
    df = models.split(series(spark, {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    got = models.ridge(df, "y", ["a", "b", "c"]).orderBy("date").collect()
    own = np.arange(50, n - 15)

    def fit(rows, alpha):
        mu, sd = x[rows].mean(axis=0), x[rows].std(axis=0)
        z = (x[rows] - mu) / sd
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[rows] - y[rows].mean()))
        return lambda at: y[rows].mean() + (x[at] - mu) / sd @ beta

    folds = max(2, min(3, len(own) // 12))
    size = len(own) // (folds + 1)
    tests = [own[len(own) - (folds - j) * size :][:size] for j in range(folds)]
    error = {a: np.mean([np.mean((y[t] - fit(np.arange(50, t[0]), a)(t)) ** 2) for t in tests]) for a in models.ALPHAS}
    best = min(error, key=lambda a: (error[a], a))
    assert got[0].prediction_alpha == best and np.allclose([r.prediction for r in got], fit(own, best)(np.arange(n)))


def test_tree_search(spark):
    """Folds of rows, distinct seeded draws, the least mean error; predictions are those of a fit to the earlier rows."""
    n = 90
    x = RNG.normal(size=n)
    df = models.split(series(spark, {"x": x, "y": np.where(x > 0, 1.0, -1.0) + RNG.normal(size=n) * 0.05}))
    folds = [r for r in models.row_folds(df).orderBy("fold", "position").collect()]
    for k in range(1, 5):
        test = [r.position for r in folds if r.fold == k and r.test]
        assert test == list(range(75 - (5 - k) * 10, 75 - (4 - k) * 10)) and [r.position for r in folds if r.fold == k and not r.test] == list(range(test[0]))
    grid = {"maxDepth": (1, 3), "maxIter": (1, 5), "subsamplingRate": (1.0,)}  # rows are sampled by their place in partitions
    assert models.draw_parameters(3, grid=grid) == models.draw_parameters(3, grid=grid) and len({str(p) for p in models.draw_parameters(99, grid=grid)}) == 4
    assert len(models.draw_parameters()) == 150
    best, scored = models.tune_trees(df, "y", ["x"], models.draw_parameters(2, grid=grid))
    assert len(scored) == 2 and min(e for _, e in scored) == dict((str(p), e) for p, e in scored)[str(best)]
    cuts = [r.date for r in df.filter("position in (50, 70)").orderBy("date").collect()]
    out = {r.position: r.prediction for r in models.tree_walk_forward(df, "y", ["x"], cuts, params=best).collect()}
    own = {r.position: r.prediction for r in models._fit_trees(df.filter("position < 70"), df.filter("position >= 70"), "y", ["x"], "instrument", best).collect()}
    assert sorted(out) == list(range(50, n)) and all(out[k] == own[k] for k in own)
    assert np.mean([(out[k] > 0) == (x[k] > 0) for k in out]) > 0.9


def test_large_binomial_tails(spark):
    from tidemark.functions import dist

    rows = spark.createDataFrame([(10, 0), (10, 11), (10, 7), (2_000_000, 1_001_000)], "n long, k long")
    got = [r.p for r in rows.select(dist.binomial_tail(F.col("n"), F.col("k")).alias("p")).collect()]
    assert got[:2] == [1.0, 0.0] and abs(got[2] - sum(math.comb(10, i) for i in range(7, 11)) / 1024) < 1e-14
    assert abs(got[3] - 0.5 * math.erfc((1_000_999.5 - 1_000_000) / math.sqrt(500_000) / math.sqrt(2))) < 1e-4


def test_histogram_edges(spark):
    from tidemark.operators.checks import histogram

    df = spark.createDataFrame([("a", v) for v in (-1.0, 0.0, 0.5, 1.0, 1.1)], "instrument string, x double")
    got = {r.bin: r.n for r in histogram(df, "x", 0.0, 1.0, 2).collect()}
    assert got == {0: 1, 1: 2}


@pytest.mark.parametrize("n", [1, 5])
def test_one_row_keys(spark, n):
    df = series(spark, {"close": [1.0] * n, "open": [1.0] * n, "high": [1.0] * n, "low": [1.0] * n})
    assert features.price_features(df).count() == n
