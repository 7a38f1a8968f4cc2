"""Pieces of SQL that several queries' SQL shares: least squares by making columns orthogonal, and the Dickey-Fuller test."""

from __future__ import annotations

from tidemark.functions import dist


def orthogonal(name: str, source: str, by: str, columns: list[str], y: str, keep: str = "") -> tuple[str, str]:
    """CTEs that center y and the columns in each key and take from every column (q0, q1, ...) what the columns before it explain;
    and the name of the last one."""
    m, keep = len(columns), f"{keep}, " if keep else ""
    steps = [f"{name}0 AS (SELECT {by}, {keep}{y} - avg({y}) OVER w AS y, {', '.join(f'{c} - avg({c}) OVER w AS q{i}' for i, c in enumerate(columns))} FROM {source} WINDOW w AS (PARTITION BY {by}))"]
    for j in range(m - 1):
        done, rest = "".join(f"q{i}, " for i in range(j + 1)), ", ".join(f"q{i} - sum(q{i} * q{j}) OVER w / sum(q{j} * q{j}) OVER w * q{j} AS q{i}" for i in range(j + 1, m))
        steps.append(f"{name}{j + 1} AS (SELECT {by}, {keep}y, {done}{rest} FROM {name}{j} WINDOW w AS (PARTITION BY {by}))")
    return ", ".join(steps), f"{name}{m - 1}"


def predicted(name: str, source: str, by: str, fit: str, y: str, xs: list[str], out: str) -> tuple[str, str]:
    """CTEs that add ``out``, the least-squares prediction of y on a constant and xs in all rows of each key, fitted to the rows where
    ``fit`` holds, by making the columns orthogonal there; and the name of the last one."""
    m, over = len(xs), f"FILTER (WHERE {fit}) OVER (PARTITION BY {by})"
    own = [f"{out}_q{i}" for i in range(m)]
    steps = [f"{name}0 AS (SELECT *, avg({y}) {over} AS {out}_m, {', '.join(f'{x} - avg({x}) {over} AS {q}' for x, q in zip(xs, own))} FROM {source})"]
    for j in range(m - 1):
        less = ", ".join(f"{own[i]} - sum({own[i]} * {own[j]}) {over} / sum({own[j]} * {own[j]}) {over} * {own[j]} AS {own[i]}" for i in range(j + 1, m))
        steps.append(f"{name}{j + 1} AS (SELECT * REPLACE ({less}) FROM {name}{j})")
    value = " + ".join(f"sum({q} * ({y} - {out}_m)) {over} / sum({q} * {q}) {over} * {q}" for q in own)
    steps.append(f"{name}_all AS (SELECT * EXCLUDE ({out}_m, {', '.join(own)}), {out}_m + {value} AS {out} FROM {name}{m - 1})")
    return ", ".join(steps), f"{name}_all"


def explained(columns: range) -> str:
    """The sum of squares of y that some of the orthogonal columns explain, as aggregates."""
    return "(" + " + ".join(f"pow(sum(y * q{i}), 2) / sum(q{i} * q{i})" for i in columns) + ")"


def adf(source: str, by: str, lags: range = range(4), pick: bool = True) -> str:
    """CTEs up to ``tests`` (by, n, lag, t): the statistic at each lag, or at the lag of the least AIC. source: by, date, v without nulls."""
    most = max(lags)
    shifted = ", ".join(f"lag(d, {i}) OVER w AS d{i}" for i in range(1, most + 1)) or "NULL AS d1"
    parts = [f"s1 AS (SELECT *, lag(v) OVER w AS y1, v - lag(v) OVER w AS d FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY date)), s2 AS (SELECT *, {shifted} FROM s1 WINDOW w AS (PARTITION BY {by} ORDER BY date))",
             f"sizes AS (SELECT {by}, count(*) AS n FROM {source} GROUP BY {by})"]
    for p in lags:
        own = [f"d{i}" for i in range(1, p + 1)]
        text, last = orthogonal(f"o{p}_", f"(SELECT * FROM s2 WHERE {own[-1] if own else 'd'} IS NOT NULL)", by, [*own, "y1"], "d")
        parts += [text, f"t{p} AS (SELECT {by}, {p} AS lag, sum(y * q{p}) / sum(q{p} * q{p}) / sqrt((sum(y * y) - {explained(range(p + 1))}) / (count(*) - {p + 2}) / sum(q{p} * q{p})) AS t FROM {last} GROUP BY {by})"]
    parts.append("each AS (" + " UNION ALL ".join(f"SELECT * FROM t{p}" for p in lags) + ")")
    if pick:
        text, last = orthogonal("c", f"(SELECT * FROM s2 WHERE d{most} IS NOT NULL)", by, ["y1", *[f"d{i}" for i in range(1, most + 1)]], "d")
        aics = " UNION ALL ".join(f"SELECT {by}, {p} AS lag, count(*) * ln((sum(y * y) - {explained(range(p + 1))}) / count(*)) + 2.0 * ({p} + 2) AS aic FROM {last} GROUP BY {by}" for p in lags)
        parts += [text, f"aics AS ({aics})", f"best AS (SELECT {by}, arg_min(lag, aic) AS lag FROM aics GROUP BY {by})", f"tests AS (SELECT * FROM each JOIN best USING ({by}, lag) JOIN sizes USING ({by}))"]
    else:
        parts.append(f"tests AS (SELECT * FROM each JOIN sizes USING ({by}))")
    return ", ".join(parts)


_LOW = "(2.1659 + 1.4412 * t + 0.038269 * t * t)"
_HIGH = "(1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t)"
#: MacKinnon's p-value of the statistic t.
ADF_P = f"CASE WHEN t > 2.74 THEN 1 WHEN t < -18.83 THEN 0 WHEN t <= -1.61 THEN {dist.normal_cdf_sql(_LOW)} ELSE {dist.normal_cdf_sql(_HIGH)} END"
ADF_STATUS = f"CASE WHEN {ADF_P} < 0.05 THEN 'STATIONARY_5PCT' ELSE 'NONSTATIONARY_5PCT' END"


def granger(source: str, by: str, lags: range) -> str:
    """CTEs up to ``f`` (by, lag, n, f, free): the F statistic at each lag. source: by, date, y, x without nulls."""
    most, parts = max(lags), []
    shifted = ", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for c in "yx" for i in range(1, most + 1))
    parts.append(f"g1 AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, {shifted} FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY date))")
    for p in lags:
        text, last = orthogonal(f"g{p}_", f"(SELECT * FROM g1 WHERE y{p} IS NOT NULL)", by, [f"{c}{i}" for c in "yx" for i in range(1, p + 1)], "y", "n")
        less, free = f"(sum(y * y) - {explained(range(2 * p))})", f"(count(*) - {2 * p + 1})"
        parts += [text, f"f{p} AS (SELECT {by}, {p} AS lag, any_value(n) AS n, {explained(range(p, 2 * p))} / {p} / ({less} / {free}) AS f, {free} AS free FROM {last} GROUP BY {by})"]
    return ", ".join(parts) + ", f AS (" + " UNION ALL ".join(f"SELECT * FROM f{p}" for p in lags) + ")"


def wilcoxon(source: str, by: str, value: str, exact_most: int = 50) -> str:
    """CTEs up to ``signed`` (by, w_n, w_plus, z, p_wilcoxon, p_less): the signed-rank test, exact for few values without ties or zeros (counts
    of rank sums grow rank by rank). They recurse."""
    top = exact_most * (exact_most + 1) // 2
    p = f"list_sum(l[1:CAST({{0}} AS INTEGER) + 1]) / pow(2, w_n)"
    normal = dist.normal_cdf_sql("z")
    two = f"2 * (1 - {dist.normal_cdf_sql('abs(z)')})"
    return f"""wr AS (SELECT {by}, {value} AS x, count(*) OVER (PARTITION BY {by}, abs({value})) AS t, rank() OVER (PARTITION BY {by} ORDER BY abs({value})) AS k FROM {source} WHERE {value} <> 0),
wa AS (SELECT {by}, count(*) AS every FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}),
wp AS (SELECT {by}, count(*) AS w_n, sum(CASE WHEN x > 0 THEN k + (t - 1) / 2 ELSE 0 END) AS w_plus, sum(t * t - 1.0) AS ties, max(t) > 1 AS tied FROM wr GROUP BY {by}),
ws AS (SELECT {by}, every, coalesce(w_n, 0) AS w_n, coalesce(w_plus, 0) AS w_plus, coalesce(tied, false) AS tied, (w_plus - w_n * (w_n + 1) / 4) / sqrt(nullif(w_n * (w_n + 1.0) * (2 * w_n + 1) / 24 - ties / 48, 0)) AS z FROM wa LEFT JOIN wp USING ({by})),
sums(k, l) AS (SELECT 0, list_transform(range(0, {top + 1}), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0 END) UNION ALL
  SELECT k + 1, list_transform(range(0, {top + 1}), lambda i: l[i + 1] + CASE WHEN i > k THEN l[i - k] ELSE 0.0 END) FROM sums WHERE k < {exact_most}),
signed AS (SELECT {by}, w_n, w_plus, z, CASE WHEN every < 2 THEN NULL WHEN w_n = 0 THEN 1 WHEN l IS NOT NULL THEN least(1, 2 * {p.format("least(w_plus, w_n * (w_n + 1) / 2 - w_plus)")}) ELSE {two} END AS p_wilcoxon,
  CASE WHEN every < 2 THEN NULL WHEN w_n = 0 THEN 1 WHEN l IS NOT NULL THEN {p.format("w_plus")} ELSE {normal} END AS p_less
  FROM ws LEFT JOIN sums ON sums.k = w_n AND w_n > 0 AND NOT tied AND w_n = every)"""
