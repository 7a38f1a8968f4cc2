"""Boosted trees for each instrument: the search of parameters and the walk forward as rows of one job.

A model belongs to an instrument, so its rows are days, of bounded length like a window over them. Instruments, feature
sets, blocks of draws and blocks of refits are keys of one grouped job each; a group fits its models one after another.
Trees grow level by level: histograms of gradients by (node, feature, bin), the best split of every node from their running
sums, leaves shrunk by a penalty, rows and columns drawn anew for each tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import MIN_TRAIN, dealt, draw_parameters

#: The parameters that the search draws from.
GRID = {
    "depth": (2, 3, 4), "trees": (50, 100, 150, 200), "rate": (0.01, 0.03, 0.05, 0.1, 0.15), "rows": (0.6, 0.7, 0.8, 0.9, 1.0), "columns": (0.6, 0.7, 0.8, 1.0),
    "least": (1, 3, 5), "penalty": (1, 5, 10),
}
BINS = 64
#: Draws of a group of the search, and refits of a group of the walk forward.
DRAWS_TOGETHER, REFITS_TOGETHER = 2, 4


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last, for each column: halfway between neighbours, at quantiles where there are more values than bins."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for c, e in zip(x.T, ends)], axis=1)


def splits(codes: np.ndarray, node: np.ndarray, gradient: np.ndarray, nodes: int, bins: int, least: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """codes: column * bins + bin. Of each node the column and the last bin of its left side with the greatest gain; column -1 where none gains.

    The first of equal gains counts, by column, then bin."""
    n, k = codes.shape
    place = (node[:, None] * (k * bins) + codes).ravel()
    size = nodes * k * bins
    g = np.bincount(place, np.repeat(gradient, k), size).reshape(nodes, k, bins).cumsum(axis=2)
    h = np.bincount(place, minlength=size).reshape(nodes, k, bins).cumsum(axis=2).astype(float)
    whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
    right_g, right_h = whole_g - g, whole_h - h
    gain = g * g / (h + penalty) + right_g * right_g / (right_h + penalty) - whole_g * whole_g / (whole_h + penalty)
    gain[(h < least) | (right_h < least)] = -np.inf
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    column, bin_ = best // bins, best % bins
    return np.where(flat[np.arange(nodes), best] > 1e-12, column, -1), bin_


def boosted(x: np.ndarray, y: np.ndarray, others: np.ndarray, params: dict, seed: int = 42) -> np.ndarray:
    """Predictions for ``others`` of squared-error boosting on x and y; missing values count as the least."""
    ends = edges(np.nan_to_num(x, nan=-np.inf)) if np.isnan(x).any() else edges(x)
    codes, apart = (binned(np.nan_to_num(m, nan=-np.inf), ends) for m in (x, others))
    draw, k = np.random.default_rng(seed), x.shape[1]
    bins = max(map(len, ends), default=0) + 1
    now, out = np.full(len(y), y.mean()), np.full(len(others), y.mean())
    taken = max(1, int(k * params["columns"]))
    for _ in range(params["trees"]):
        gradient = now - y
        used = np.flatnonzero(draw.random(len(y)) < params["rows"]) if params["rows"] < 1 else np.arange(len(y))
        columns = np.sort(draw.permutation(k)[:taken])
        node, away = np.zeros(len(y), np.int64), np.zeros(len(others), np.int64)
        own = codes[np.ix_(used, columns)] + np.arange(taken) * bins
        for level in range(params["depth"]):
            column, last = splits(own, node[used], gradient[used], 1 << level, bins, params["least"], params["penalty"])
            # Rows of a node without a split go left together, where it stays a leaf.
            for at, of in ((node, codes), (away, apart)):
                c = column[at]
                at *= 2
                at += (c >= 0) & (of[np.arange(len(at)), columns[c]] > last[at // 2])
        g = np.bincount(node[used], gradient[used], 1 << params["depth"])
        h = np.bincount(node[used], minlength=1 << params["depth"])
        leaf = -params["rate"] * g / (h + params["penalty"])
        now += leaf[node]
        out += leaf[away]
    return out


def _sets(df: DataFrame, sets: dict[str, list[str]], y: str, by: str, on: str) -> DataFrame:
    """by, features (a set's name), on, _y and _x (its columns) of complete targets."""
    each = F.array(*[F.struct(F.lit(name).alias("features"), F.array(*[F.col(c).cast("double") for c in xs]).alias("_x")) for name, xs in sets.items()])
    return df.filter(F.col(y).isNotNull()).select(by, on, "split", F.col(y).cast("double").alias("_y"), F.explode(each).alias("_s")).select(by, on, "split", "_y", "_s.*")


def _arrays(own: pd.DataFrame, on: str) -> tuple[np.ndarray, np.ndarray]:
    own = own.sort_values(on)
    return np.stack([np.array(v, float) for v in own["_x"]]), own["_y"].to_numpy(float)


def search(df: DataFrame, y: str, sets: dict[str, list[str]], draws: int = 150, by: str = "instrument", on: str = "date", folds: int = 4, size: int = 10, seed: int = 42, grid: dict | None = None) -> DataFrame:
    """M9: by, features, draw and error of each draw of parameters: the root mean squared error, averaged over ``folds`` blocks of ``size`` rows
    at the end of what stands before the holdout, each predicted from all rows before it. Dates of a key are distinct; keys with too few rows give none."""
    drawn = draw_parameters(draws, seed, grid or GRID)
    chunks = -(-len(drawn) // DRAWS_TOGETHER)
    rows = _sets(df.filter("split <> 'holdout'"), sets, y, by, on).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def work(own: pd.DataFrame) -> pd.DataFrame:
        x, target = _arrays(own, on)
        at = int(own["_chunk"].iloc[0]) * DRAWS_TOGETHER
        starts = [len(target) - (folds - i) * size for i in range(folds)]
        found = []
        for draw in range(at, min(at + DRAWS_TOGETHER, len(drawn))) if starts[0] > 1 else ():
            errors = [np.sqrt(np.mean((boosted(x[:s], target[:s], x[s : s + size], drawn[draw], seed) - target[s : s + size]) ** 2)) for s in starts]
            found.append((own[by].iloc[0], own["features"].iloc[0], draw, float(np.mean(errors))))
        return pd.DataFrame(found, columns=[by, "features", "draw", "error"]).astype({"draw": "int32", "error": "float64"})

    kind = df.schema[by].dataType.simpleString()
    return dealt(rows, by, "features", "_chunk").groupBy(by, "features", "_chunk").applyInPandas(work, f"{by} {kind}, features string, draw int, error double")


def best_draws(found: DataFrame, by: str = "instrument") -> DataFrame:
    """by, features and the draw of the least error, the first of equals."""
    return found.groupBy(by, "features").agg(F.min(F.struct("error", "draw")).alias("b")).select(by, "features", "b.draw")


def walk_forward(df: DataFrame, y: str, sets: dict[str, list[str]], best: DataFrame, draws: int = 150, by: str = "instrument", on: str = "date", min_train: int = MIN_TRAIN, every: int = 1,
                 last: int | None = None, seed: int = 42, grid: dict | None = None) -> DataFrame:
    """By, on, features and prediction of every row from the ``min_train``-th on (or of the ``last`` ones) by trees fitted to all earlier
    rows of its key, anew every ``every`` rows, with the parameters of the draw that ``best`` (by, features, draw) names."""
    drawn = draw_parameters(draws, seed, grid or GRID)
    span = REFITS_TOGETHER * every
    w = Window.partitionBy(by, "features")
    rows = _sets(df, sets, y, by, on).withColumns({"_p": F.row_number().over(w.orderBy(on)) - 1, "_n": F.count(F.lit(1)).over(w).cast("int")})
    start = F.lit(min_train) if last is None else F.greatest(F.lit(min_train), F.col("_n") - last)
    rows = rows.withColumn("_from", start.cast("int")).filter("_n > _from").withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1 - F.col("_from")) / span).cast("int"))))
    rows = rows.filter(F.col("_p") < F.col("_from") + (F.col("_block") + 1) * span).join(best, [by, "features"])

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(on)
        x, target = _arrays(own, on)
        first, params = int(own["_from"].iloc[0]) + int(own["_block"].iloc[0]) * span, drawn[int(own["draw"].iloc[0])]
        parts = [boosted(x[:s], target[:s], x[s : s + every], params, seed) for s in range(first, len(target), every)]
        return pd.DataFrame({by: own[by].iloc[0], on: own[on].iloc[first:], "features": own["features"].iloc[0], "prediction": np.concatenate(parts)})

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return dealt(rows, by, "features", "_block").groupBy(by, "features", "_block").applyInPandas(work, f"{by} {kind[by]}, {on} {kind[on]}, features string, prediction double")
