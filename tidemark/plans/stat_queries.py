"""Queries of the statistical operators (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import events, features, large_groups, regression, testing
from tidemark.plans import sql
from tidemark.plans import tables as T
from tidemark.plans.base import registry, rounded

QUERIES, ORACLES, register = registry()
_A = f"WITH {T.ANALYSIS}"

#: (analysis, outcome, predictor)
OLS_SPECS = [("intraday", "intraday_return", "intraday_sentiment_index"), ("overnight", "cc_return", "overnight_sentiment_index"), ("volatility", "parkinson_volatility", "overnight_sentiment_index")]
FORWARD = [("intraday->return", "cc_return", "intraday_sentiment_index"), ("overnight->return", "cc_return", "overnight_sentiment_index"),
           ("intraday->volatility", "parkinson_volatility", "intraday_sentiment_index"), ("overnight->volatility", "parkinson_volatility", "overnight_sentiment_index")]
REVERSE = [("return->intraday", "intraday_sentiment_index", "cc_return"), ("return->overnight", "overnight_sentiment_index", "cc_return"),
           ("volatility->intraday", "intraday_sentiment_index", "parkinson_volatility"), ("volatility->overnight", "overnight_sentiment_index", "parkinson_volatility")]


def _long(pairs) -> str:
    return ", long AS (" + " UNION ALL ".join(f"SELECT instrument, date, '{n}' AS analysis, CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x FROM analysis WHERE {y} IS NOT NULL AND {x} IS NOT NULL" for n, y, x in pairs) + ")"


@register(f"{_A} SELECT instrument, count(*) AS n FROM analysis WHERE cc_return IS NOT NULL AND overnight_sentiment_index IS NOT NULL GROUP BY instrument")
def a1_complete_sample(spark, d):
    rows = regression.complete(T.analysis(spark, d), ["cc_return", "overnight_sentiment_index"])
    return rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


_DF0 = f"""{_A}, s AS (SELECT instrument, date, overnight_sentiment_index AS v FROM analysis WHERE overnight_sentiment_index IS NOT NULL),
l AS (SELECT *, lag(v) OVER (PARTITION BY instrument ORDER BY date) AS y1 FROM s), g AS (SELECT instrument, count(*) AS n, count(y1) AS m, regr_slope(v - y1, y1) AS b, regr_sxx(v - y1, y1) AS sxx, regr_syy(v - y1, y1) AS syy FROM l GROUP BY instrument),
tau AS (SELECT instrument, n, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS t FROM g)"""
@register(f"{_DF0} SELECT instrument, {sql.ADF_STATUS} AS status, n, 0 AS lag, round(t, 6) AS statistic, round({sql.ADF_P}, 6) AS p_value FROM tau")
def a3_a5_adf_lag0(spark, d):
    return rounded(regression.adf_fixed(T.analysis(spark, d), ["instrument"], "overnight_sentiment_index", [0]), 6)


_ADF_ROW = f"{sql.ADF_STATUS} AS status, n, lag, round(t, 6) AS statistic, round({sql.ADF_P}, 6) AS p_value FROM tests"
_VARIABLES = ["intraday_sentiment_index", "overnight_sentiment_index", "cc_return", "parkinson_volatility"]
_BY_VARIABLE = ", s AS (" + " UNION ALL ".join(f"SELECT instrument || '/{n}' AS k, date, CAST({n} AS DOUBLE) AS v FROM analysis WHERE {n} IS NOT NULL" for n in _VARIABLES) + ")"


@register(f"{_A}{_BY_VARIABLE}, {sql.adf('s', 'k')} SELECT split_part(k, '/', 1) AS instrument, split_part(k, '/', 2) AS variable, {_ADF_ROW}")
def a2_adf_aic(spark, d):
    """All variables of all instruments, the lag by AIC."""
    rows = T.analysis(spark, d)
    long = rows.select("instrument", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("value")) for n in _VARIABLES])).alias("x")).select("instrument", "date", "x.*")
    return rounded(regression.adf(long, ["instrument", "variable"], "value"), 6)


@register(f"{_A}, s AS (SELECT instrument, date, overnight_sentiment_index AS v FROM analysis WHERE overnight_sentiment_index IS NOT NULL), {sql.adf('s', 'instrument', range(1, 4), pick=False)} SELECT instrument, {_ADF_ROW}")
def a3_adf_fixed_lags(spark, d):
    return rounded(regression.adf_fixed(T.analysis(spark, d), ["instrument"], "overnight_sentiment_index", [1, 2, 3]), 6)


_FORMS = """, l AS (SELECT instrument, date, overnight_sentiment_index AS v, overnight_sentiment_index - lag(overnight_sentiment_index) OVER (PARTITION BY instrument ORDER BY date) AS d FROM analysis),
s AS (SELECT instrument || '/level' AS k, date, v FROM l WHERE v IS NOT NULL UNION ALL SELECT instrument || '/difference', date, d FROM l WHERE d IS NOT NULL)"""


@register(f"{_A}{_FORMS}, {sql.adf('s', 'k')} SELECT split_part(k, '/', 1) AS instrument, split_part(k, '/', 2) AS form, {_ADF_ROW}")
def a4_adf_level_and_difference(spark, d):
    rows = features.first_difference(T.analysis(spark, d), "overnight_sentiment_index")
    long = rows.select("instrument", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), F.col(c).alias("value")) for n, c in (("level", "overnight_sentiment_index"), ("difference", "overnight_sentiment_index_diff"))])).alias("x")).select("instrument", "date", "x.*")
    return rounded(regression.adf(long, ["instrument", "form"], "value"), 6)


_HAC = """, b AS (SELECT analysis, instrument, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, sum(x) AS sx, sum(x * x) AS sxx FROM long GROUP BY ALL),
e AS (SELECT l.analysis, l.instrument, l.date, y - b.a - b.b * x AS g0, x * (y - b.a - b.b * x) AS g1 FROM long l JOIN b ON b.analysis = l.analysis AND b.instrument = l.instrument),
k AS (SELECT *, lag(g0, 1) OVER w AS p1, lag(g0, 2) OVER w AS p2, lag(g0, 3) OVER w AS p3, lag(g1, 1) OVER w AS q1, lag(g1, 2) OVER w AS q2, lag(g1, 3) OVER w AS q3 FROM e WINDOW w AS (PARTITION BY analysis, instrument ORDER BY date)),
m AS (SELECT analysis, instrument, sum(g0 * g0) + 2 * (0.75 * sum(g0 * p1) + 0.5 * sum(g0 * p2) + 0.25 * sum(g0 * p3)) AS m00,
  sum(g0 * g1) + 0.75 * sum(g0 * q1 + g1 * p1) + 0.5 * sum(g0 * q2 + g1 * p2) + 0.25 * sum(g0 * q3 + g1 * p3) AS m01,
  sum(g1 * g1) + 2 * (0.75 * sum(g1 * q1) + 0.5 * sum(g1 * q2) + 0.25 * sum(g1 * q3)) AS m11 FROM k GROUP BY ALL),
z AS (SELECT b.*, sqrt((sx * sx * m00 - 2 * n * sx * m01 + CAST(n AS DOUBLE) * n * m11) / pow(n * sxx - sx * sx, 2)) AS se FROM b JOIN m ON m.analysis = b.analysis AND m.instrument = b.instrument)"""
_NORMAL = f"2 * (1 - {dist.normal_cdf_sql('abs(b / se)')})"


@register(f"{_A}{_long(OLS_SPECS)}{_HAC} SELECT instrument, analysis, 'OK' AS status, n, round(r2, 6) AS r2, round(b, 6) AS coef, round(se, 6) AS hac_se, round(b / se, 5) AS z, round({_NORMAL}, 5) AS p_value FROM z")
def a6_a7_hac_specs(spark, d):
    rows = regression.specs(T.analysis(spark, d), OLS_SPECS, ["instrument"], ["date"])
    return rounded(regression.hac_ols(rows, ["instrument", "analysis"], "y", ["x"]), 6, z=5, p_value=5)


#: The controls in their order; the rows may lack some of them.
CONTROLS = ["own_market", "vix_change", "foreign_change"]
_OWN = "CASE instrument WHEN 'R' THEN second_change ELSE market_change END"
_WITH_CONTROLS = ", long AS (" + " UNION ALL ".join(f"SELECT instrument || '/{n}' AS k, date, CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x, {_OWN} AS own_market, vix_change FROM analysis WHERE {y} IS NOT NULL AND {x} IS NOT NULL AND {_OWN} IS NOT NULL AND vix_change IS NOT NULL" for n, y, x in OLS_SPECS) + ")"
_ORTHOGONAL, _LAST = sql.orthogonal("o", "long", "k", ["own_market", "vix_change", "x"], "y", "date")
#: The error of the last regressor's coefficient from that regressor less what the others explain of it.
_SANDWICH = f"""{_ORTHOGONAL}, b AS (SELECT k, count(*) AS n, sum(y * q0) / sum(q0 * q0) AS b0, sum(y * q1) / sum(q1 * q1) AS b1, sum(y * q2) / sum(q2 * q2) AS b2, sum(q2 * q2) AS s2, {sql.explained(range(3))} / sum(y * y) AS r2 FROM {_LAST} GROUP BY k),
e AS (SELECT o.k, o.date, o.q2 * (o.y - b0 * o.q0 - b1 * o.q1 - b2 * o.q2) AS g FROM {_LAST} o JOIN b USING (k)),
h AS (SELECT *, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(g, 3) OVER w AS g3 FROM e WINDOW w AS (PARTITION BY k ORDER BY date)),
z AS (SELECT b.*, b2 AS b, sqrt(m) / s2 AS se FROM b JOIN (SELECT k, sum(g * g) + 2 * (0.75 * sum(g * g1) + 0.5 * sum(g * g2) + 0.25 * sum(g * g3)) AS m FROM h GROUP BY k) USING (k))"""


@register(f"{_A}{_WITH_CONTROLS}, {_SANDWICH} SELECT split_part(k, '/', 1) AS instrument, split_part(k, '/', 2) AS analysis, 'OK' AS status, n, round(r2, 6) AS r2, round(b, 6) AS coef, round(se, 6) AS hac_se, round(b / se, 5) AS z, round({_NORMAL}, 5) AS p_value FROM z")
def a7_hac_with_controls(spark, d):
    """The specs with the controls that are there: each instrument's own market and the volatility index, but no foreign index."""
    rows = events.own_market(T.analysis(spark, d), {"R": "second_change"}, "market_change")
    controls = regression.present(rows, CONTROLS)
    long = regression.specs(rows, OLS_SPECS, ["instrument"], ["date", *controls])
    return rounded(regression.hac_ols(long, ["instrument", "analysis"], "y", ["x", *controls]), 6, z=5, p_value=5)


def _granger_sql(pairs, lags: range) -> str:
    keyed = _long(pairs).replace("SELECT instrument, date, '", "SELECT instrument || '/").replace("' AS analysis", "' AS k, date")
    return f"{_A}{keyed}, {sql.granger('long', 'k', lags)} SELECT split_part(k, '/', 1) AS instrument, split_part(k, '/', 2) AS analysis, lag, 'OK' AS status, n, round(f, 5) AS statistic, round({dist.f_tail_sql('f', 'lag', 'free')}, 6) AS p_value FROM f"


def _granger(spark, d, pairs, lag):
    rows = regression.specs(T.analysis(spark, d), pairs, ["instrument"], ["date"])
    return rounded(regression.granger(rows, ["instrument", "analysis"], "y", "x", max_lag=lag), 6, statistic=5)


@register(_granger_sql(FORWARD, range(1, 2)))
def a8_a9_granger_forward_lag1(spark, d):
    return _granger(spark, d, FORWARD, 1)


@register(_granger_sql(REVERSE, range(1, 2)))
def a10_granger_reverse_lag1(spark, d):
    return _granger(spark, d, REVERSE, 1)


@register(_granger_sql(FORWARD + REVERSE, range(1, 4)))
def a9_granger_all_lags(spark, d):
    return _granger(spark, d, FORWARD + REVERSE, 3)


_Z = f"""WITH {T.RETURNS}, m AS (SELECT instrument, CAST(date_trunc('month', date) AS DATE) AS month, count(cc_return) AS n, avg(cc_return) / (stddev_samp(cc_return) / sqrt(count(cc_return))) AS z FROM featured GROUP BY ALL),
p AS (SELECT instrument, month, z, CASE WHEN n >= 20 THEN 'OK' ELSE 'SKIP_TOO_FEW' END AS status, 2 * (1 - {dist.normal_cdf_sql("abs(z)")}) AS p FROM m WHERE z IS NOT NULL),
k AS (SELECT *, count(*) OVER (PARTITION BY status) AS fam, row_number() OVER (PARTITION BY status ORDER BY p) AS k FROM p),
a AS (SELECT *, CASE WHEN status = 'OK' THEN least(1, min(p * fam / k) OVER (PARTITION BY status ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS p_bh, CASE WHEN status = 'OK' THEN least(1, p * fam) END AS p_bonferroni FROM k)"""


def _adjusted(spark, d):
    rows = features.price_features(T.bars(spark, d)).groupBy("instrument", F.trunc("date", "month").alias("month")).agg(F.count("cc_return").alias("n"), testing.t_statistic(F.col("cc_return")).alias("z")).filter("z IS NOT NULL")
    status = F.when(F.col("n") >= 20, "OK").otherwise("SKIP_TOO_FEW")
    return testing.adjust(rows.select("instrument", "month", "z", status.alias("status"), dist.two_sided_normal(F.col("z")).alias("p_value")))


@register(f"{_Z} SELECT instrument, month, round(z, 6) AS z, status, round(p, 6) AS p_value, round(p_bh, 6) AS p_bh, round(p_bonferroni, 5) AS p_bonferroni, coalesce(p_bh <= 0.05, false) AS reject_bh, coalesce(p_bonferroni <= 0.05, false) AS reject_bonferroni FROM a")
def a11_a12_adjusted(spark, d):
    return rounded(_adjusted(spark, d), 6, p_bonferroni=5)


@register(f"{_Z} SELECT status, count(p) AS tests, count(*) FILTER (WHERE p < 0.05) AS raw, count(*) FILTER (WHERE p_bh < 0.05) AS bh, count(*) FILTER (WHERE p_bonferroni < 0.05) AS bonferroni FROM a GROUP BY status")
def a13_tallies(spark, d):
    return testing.tallies(_adjusted(spark, d), by=["status"])


@register(f"WITH {T.RETURNS} SELECT instrument, n, round(mean, 8) AS mean, round(t, 6) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 6) AS p_value FROM (SELECT instrument, count(cc_return) AS n, avg(cc_return) AS mean, avg(cc_return) / (stddev_samp(cc_return) / sqrt(count(cc_return))) AS t FROM featured GROUP BY instrument)")
def a14_t_test(spark, d):
    rows = features.price_features(T.bars(spark, d))
    return rounded(testing.t_test(rows, ["instrument"], "cc_return"), 8, statistic=6, p_value=6)


_YEAR = f"WITH {T.SENTIMENT}, v AS (SELECT instrument, year(date) AS year, overnight_sentiment_index AS x FROM sentiment WHERE overnight_no_posts = 0)"


def _yearly(spark, d):
    return T.sentiment(spark, d).filter("overnight_no_posts = 0").select("instrument", F.year("date").cast("long").alias("year"), F.round("overnight_sentiment_index", 9).alias("x"))


_YEARLY = f"WITH RECURSIVE {T.SENTIMENT}, v AS (SELECT instrument, year(date) AS year, round(overnight_sentiment_index, 9) AS x FROM sentiment WHERE overnight_no_posts = 0), {sql.wilcoxon('v', 'instrument, year', 'x')}"


@register(f"{_YEARLY} SELECT instrument, year, w_n AS n, CAST(w_plus AS DOUBLE) AS w_plus, round(z, 6) AS z, round(p_wilcoxon, 6) AS p_two_sided, round(p_less, 6) AS p_less FROM signed")
def a15_wilcoxon(spark, d):
    return rounded(testing.wilcoxon(_yearly(spark, d), ["instrument", "year"], "x"), 6)


_CHOOSE = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))"


@register(f"""WITH {T.SENTIMENT}, v AS (SELECT instrument, year(date) AS year, round(overnight_sentiment_index, 9) AS x FROM sentiment WHERE overnight_no_posts = 0), s AS (SELECT instrument, year, count(*) FILTER (WHERE x <> 0) AS n, count(*) FILTER (WHERE x > 0) AS positive FROM v GROUP BY ALL),
i AS (SELECT *, unnest(range(n + 1)) AS i FROM s) SELECT instrument, year, n, positive, round(least(1, sum({_CHOOSE}) FILTER (WHERE i >= positive)), 7) AS p_greater, round(least(1, 2 * least(sum({_CHOOSE}) FILTER (WHERE i >= positive), sum({_CHOOSE}) FILTER (WHERE i >= n - positive))), 7) AS p_two_sided FROM i GROUP BY ALL""")
def a16_sign_test(spark, d):
    return rounded(testing.sign_test(_yearly(spark, d), ["instrument", "year"], "x"), 7)


@register(f"""{_YEARLY}, base AS (SELECT instrument, year, count(*) AS n, count(*) FILTER (WHERE x < 0) AS negative, count(*) FILTER (WHERE x > 0) AS positive, count(*) FILTER (WHERE x = 0) AS zero, round(avg(CASE WHEN x < 0 THEN 1.0 ELSE 0 END), 7) AS negative_ratio, round(avg(x), 7) AS mean, round(quantile_cont(x, 0.5), 7) AS median, round(stddev_samp(x), 7) AS std FROM v GROUP BY ALL),
i AS (SELECT *, unnest(range(negative + positive + 1)) AS i FROM base), tail AS (SELECT instrument, year, least(1, sum({_CHOOSE.replace("n + 1", "negative + positive + 1").replace("n - i", "negative + positive - i").replace("- n *", "- (negative + positive) *")}) FILTER (WHERE i >= negative)) AS p FROM i GROUP BY ALL)
SELECT base.*, round(p, 7) AS p_sign, round(p_less, 6) AS p_wilcoxon FROM base JOIN tail USING (instrument, year) JOIN signed USING (instrument, year)""")
def a17_bias_summary(spark, d):
    return rounded(testing.bias_summary(_yearly(spark, d), ["instrument", "year"], "x"), 7, p_wilcoxon=6)


@register(f"WITH {T.RETURNS} SELECT instrument, date, round({dist.normal_cdf_sql('(cc_return * 10)')}, 7) AS p FROM featured WHERE cc_return IS NOT NULL")
def a18_normal_cdf(spark, d):
    rows = features.price_features(T.bars(spark, d)).filter("cc_return IS NOT NULL")
    return rows.select("instrument", "date", F.round(dist.normal_cdf(F.col("cc_return") * 10), 7).alias("p"))


@register(f"WITH {T.RETURNS} SELECT instrument, month, n, round(mean, 6) AS mean, round(t, 6) AS statistic, round({dist.t_two_sided_sql('t', '(n - 1)')}, 6) AS p_value FROM (SELECT instrument, CAST(date_trunc('month', date) AS DATE) AS month, count(cc_return) AS n, avg(cc_return) AS mean, CASE WHEN count(cc_return) >= 2 THEN avg(cc_return) / (stddev_samp(cc_return) / sqrt(count(cc_return))) END AS t FROM featured GROUP BY ALL)")
def a19_t_p_values(spark, d):
    rows = features.price_features(T.bars(spark, d)).withColumn("month", F.trunc("date", "month"))
    return rounded(testing.t_test(rows, ["instrument", "month"], "cc_return"), 6)


@register(f"""{_A}, s AS (SELECT * FROM analysis WHERE cc_return IS NOT NULL AND overnight_sentiment_index IS NOT NULL AND market_change IS NOT NULL),
m AS (SELECT instrument, count(*) AS n, avg(cc_return) AS my, avg(overnight_sentiment_index) AS m1, avg(market_change) AS m2, var_pop(cc_return) AS vy, var_pop(overnight_sentiment_index) AS v1, var_pop(market_change) AS v2,
  covar_pop(cc_return, overnight_sentiment_index) AS c1, covar_pop(cc_return, market_change) AS c2, covar_pop(overnight_sentiment_index, market_change) AS c12 FROM s GROUP BY instrument),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT instrument, n, round(my - b1 * m1 - b2 * m2, 7) AS b0, round(b1, 7) AS b1, round(b2, 7) AS b2, round(n * (vy - b1 * c1 - b2 * c2), 5) AS ssr, round((b1 * c1 + b2 * c2) / vy, 7) AS r2,
  round(sqrt(n * (vy - b1 * c1 - b2 * c2) / (n - 3) * v2 / (v1 * v2 - c12 * c12) / n), 7) AS se1 FROM b""")
def a20_ols(spark, d):
    fit = regression.ols(T.analysis(spark, d), ["instrument"], "cc_return", ["overnight_sentiment_index", "market_change"])
    return rounded(fit.select("instrument", "n", F.col("coef")[0].alias("b0"), F.col("coef")[1].alias("b1"), F.col("coef")[2].alias("b2"), "ssr", "r2", F.col("se")[1].alias("se1")), 7, ssr=5)


@register("""WITH g AS (SELECT l_returnflag AS instrument, l_extendedprice / 200000 AS p FROM lineitem), r AS (SELECT instrument, p, count(*) AS n FROM g GROUP BY ALL),
q AS (SELECT *, p * sum(n) OVER (PARTITION BY instrument) / sum(n) OVER (PARTITION BY instrument ORDER BY p) AS q FROM r)
SELECT instrument, round(p, 8) AS p, n, round(least(1, min(q) OVER (PARTITION BY instrument ORDER BY p DESC)), 8) AS p_bh FROM q""")
def a11_large_groups(spark, d):
    """The adjustment of many values a key, dealt by ranges of values."""
    rows = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("instrument"), (F.col("l_extendedprice") / 200000).alias("p"))
    return rounded(large_groups.adjusted_values(rows, ["instrument"], "p").withColumnRenamed("value", "p"))


@register(f"""WITH g AS (SELECT l_returnflag AS instrument, l_extendedprice - 1000 * l_quantity AS d FROM lineitem WHERE l_extendedprice <> 1000 * l_quantity),
r AS (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY abs(d)) + (count(*) OVER (PARTITION BY instrument, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY instrument, abs(d)) AS t FROM g),
s AS (SELECT instrument, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ties, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY instrument),
z AS (SELECT instrument, n, w, (w - c * (c + 1) / 4) / sqrt(c * (c + 1) * (2 * c + 1) / 24 - ties / 48) AS z FROM s)
SELECT instrument, n, round(w, 2) AS w_plus, round(z, 6) AS z, round(2 * {dist.normal_cdf_sql('-abs(z)')}, 6) AS p_two_sided FROM z""")
def a15_large_groups(spark, d):
    """Signed ranks of many values a key."""
    rows = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("instrument"), (F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("d"))
    return rounded(large_groups.signed_ranks(rows, ["instrument"], "d"), 6, w_plus=2)


SHARES = (0.05, 0.25, 0.5, 0.95)


@register("SELECT instrument, share, round(quantile, 6) AS quantile FROM (" + " UNION ALL ".join(f"SELECT l_returnflag AS instrument, CAST({s} AS DOUBLE) AS share, quantile_cont(l_extendedprice, {s}) AS quantile FROM lineitem GROUP BY ALL" for s in SHARES) + ")")
def e1_a17_large_groups(spark, d):
    """Exact quantiles of many values a key, by counts that narrow."""
    rows = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("instrument"), "l_extendedprice")
    return rounded(large_groups.quantiles(rows, ["instrument"], "l_extendedprice", list(SHARES)), 6)
