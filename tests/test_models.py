"""Models against plain versions: boosted trees, the walk forward, the search of volatility parameters, the comparison table."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import boosting, models


def plain_trees(x, y, others, p):
    """Greedy trees over all values, without draws of rows or columns."""
    def grow(rows, depth):
        g = sum(f[i] - y[i] for i in rows)
        best = None
        if depth < p["depth"]:
            for c in range(x.shape[1]):
                values = sorted({x[i, c] for i in rows})
                for a, b in zip(values, values[1:]):
                    left = [i for i in rows if x[i, c] <= a]
                    right = [i for i in rows if x[i, c] > a]
                    if min(len(left), len(right)) < p["least"]:
                        continue
                    gl, gr = (sum(f[i] - y[i] for i in part) for part in (left, right))
                    gain = gl * gl / (len(left) + p["penalty"]) + gr * gr / (len(right) + p["penalty"]) - g * g / (len(rows) + p["penalty"])
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = gain, c, (a, b), left, right
        if best is None:
            return -p["rate"] * g / (len(rows) + p["penalty"])
        return best[1], best[2], grow(best[3], depth + 1), grow(best[4], depth + 1)

    def value(tree, row, known):
        while isinstance(tree, tuple):
            c, (a, b), left, right = tree
            # The cut lies halfway between neighbours among all training values.
            column = np.unique(known[:, c])
            next_value = column[np.searchsorted(column, a) + 1]
            tree = left if row[c] <= (a + next_value) / 2 else right
        return tree

    f, out = [y.mean()] * len(y), [y.mean()] * len(others)
    for _ in range(p["trees"]):
        tree = grow(list(range(len(y))), 0)
        f = [v + value(tree, r, x) for v, r in zip(f, x)]
        out = [v + value(tree, r, x) for v, r in zip(out, others)]
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_plain_ones(seed):
    r = np.random.default_rng(seed)
    x, others = np.round(r.normal(size=(50, 3)), 1), np.round(r.normal(size=(20, 3)), 1)
    y = x[:, 0] - np.abs(x[:, 1]) + r.normal(size=50) / 5
    p = {"depth": 3, "trees": 6, "rate": 0.3, "rows": 1.0, "columns": 1.0, "least": 2 + seed % 2, "penalty": 1 + seed}
    assert np.allclose(boosting.boosted(x, y, others, p), plain_trees(x, y, others, p))


def panel(n=90, keys=("a", "b")):
    r = np.random.default_rng(2)
    rows = []
    for k in keys:
        for i in range(n):
            u, v = r.normal(size=2)
            rows.append((k, date(2020, 1, 1) + timedelta(i), float(u), None if i % 9 == 4 else float(v), float(u * u + v / 3 + r.normal() / 10)))
    return pd.DataFrame(rows, columns=["instrument", "date", "u", "v", "y"])


def test_search_and_walk_forward_use_earlier_rows_only(spark, monkeypatch):
    """Every block of draws and refits against plain loops over the same fits."""
    monkeypatch.setattr(boosting, "DRAWS_TOGETHER", 2)
    monkeypatch.setattr(boosting, "REFITS_TOGETHER", 3)
    grid = {"depth": (1, 2), "trees": (3, 5), "rate": (0.1, 0.3), "rows": (0.7, 1.0), "columns": (0.5, 1.0), "least": (1,), "penalty": (1, 5)}
    own = panel()
    df = models.split(spark.createDataFrame(own.astype(object).where(own.notna(), None), "instrument string, date date, u double, v double, y double"), holdout=15, min_train=50)
    sets = {"one": ["u"], "two": ["u", "v"]}
    drawn = models.draw_parameters(5, 42, grid)
    found = {(r["instrument"], r["features"], r["draw"]): r["error"] for r in boosting.search(df, "y", sets, 5, grid=grid).collect()}
    assert len(found) == 2 * 2 * 5
    best = boosting.best_draws(boosting.search(df, "y", sets, 5, grid=grid))
    got = {(r["instrument"], r["date"], r["features"]): r["prediction"] for r in boosting.walk_forward(df, "y", sets, best, 5, every=2, grid=grid).collect()}
    assert len(got) == 2 * 2 * 40
    chosen = {(r["instrument"], r["features"]): r["draw"] for r in best.collect()}
    for key, rows in own.groupby("instrument"):
        y = rows["y"].to_numpy()
        for name, xs in sets.items():
            x = rows[xs].to_numpy()
            for i, p in enumerate(drawn):
                errors = [math.sqrt(np.mean((boosting.boosted(x[:s], y[:s], x[s : s + 10], p) - y[s : s + 10]) ** 2)) for s in (35, 45, 55, 65)]
                assert math.isclose(found[key, name, i], sum(errors) / 4)
            assert chosen[key, name] == min(range(5), key=lambda i: (found[key, name, i], i))
            for s in range(50, 90, 2):
                want = boosting.boosted(x[:s], y[:s], x[s : s + 2], drawn[chosen[key, name]])
                assert np.allclose([got[key, d, name] for d in rows["date"].iloc[s : s + 2]], want)


def test_expanding_regression_equals_refitting(spark):
    own = panel()
    df = spark.createDataFrame(own.astype(object).where(own.notna(), None), "instrument string, date date, u double, v double, y double")
    got = {(r["instrument"], r["date"]): r["prediction"] for r in models.expanding_ols(df, "y", ["u", "v"]).collect()}
    for key, rows in own.groupby("instrument"):
        for i, row in enumerate(rows.itertuples()):
            before = rows.iloc[:i].dropna()
            if i < 50 or math.isnan(row.v):
                assert got[key, row.date] is None
                continue
            a = np.column_stack([np.ones(len(before)), before["u"], before["v"]])
            c = np.linalg.lstsq(a, before["y"], rcond=None)[0]
            assert math.isclose(got[key, row.date], c @ [1, row.u, row.v], rel_tol=1e-8)


def plain_garch(r, k, a, b):
    m, v = np.mean(r[:k]), np.var(r[:k])
    s, like = v, 0.0
    for x in r[:k]:
        e = (x - m) ** 2
        like -= math.log(s) + e / s
        s = (1 - a - b) * v + a * e + b * s
    return like, s


def test_volatility_search_beats_the_grid_everywhere(spark, monkeypatch):
    """Refitted before every row, in several blocks: parameters and forecasts against the plain recursion, likelihoods no worse than the grid's."""
    monkeypatch.setattr(models, "GARCH_FOLDS", 7)
    r = np.random.default_rng(7)
    s, returns = 1.0, []
    for _ in range(80):
        returns.append(float(r.normal() * math.sqrt(s) / 100))
        s = 0.1 + 0.15 * (returns[-1] * 100) ** 2 + 0.75 * s
    rows = [(k, date(2020, 1, 1) + timedelta(i), x if k == "a" else 0.0) for k in "ac" for i, x in enumerate(returns)] + [("b", date(2020, 1, 1), 0.1)]
    df = spark.createDataFrame(rows, "instrument string, date date, cc_return double")
    got = {x["date"]: x for x in models.garch_forecast(df, every=1, rounds=3).collect()}
    grid = {x["date"]: x for x in models.garch_forecast(df, every=1).collect()}
    scaled = [x * 100 for x in returns]
    assert len(got) == len(grid) == 30
    better = 0
    for i in range(50, 80):
        x, g = (table[date(2020, 1, 1) + timedelta(i)] for table in (got, grid))
        like, var = plain_garch(scaled, i, x["alpha"], x["beta"])
        other = plain_garch(scaled, i, g["alpha"], g["beta"])[0]
        assert math.isclose(x["volatility"], math.sqrt(var) / 100, rel_tol=1e-9) and like >= other - 1e-9
        assert other >= max(plain_garch(scaled, i, a, b)[0] for a in (0.02, 0.05, 0.1, 0.15, 0.2) for b in (0.5, 0.6, 0.7, 0.8, 0.9) if a + b < 1) - 1e-9
        better += like > other + 1e-6
    assert better > 15


def test_comparison_table_has_seven_models_and_two_targets(spark):
    from tidemark.plans import model_queries

    rows = model_queries.m16_seven_models(spark, "/root/testdata/sf0.001").toPandas()
    assert set(rows["target"]) == {"pk", "5d"} and len(rows) == len(set(rows["instrument"])) * 2
    assert rows[list(model_queries.SEVEN)].notna().all().all() and (rows[list(model_queries.SEVEN)] > 0).all().all()
