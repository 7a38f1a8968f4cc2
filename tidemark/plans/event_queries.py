"""Queries of the event study (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import events
from tidemark.plans import sql
from tidemark.plans import tables as T
from tidemark.plans.base import registry, rounded
from tidemark.sources.shared import settle

QUERIES, ORACLES, register = registry()
SESSIONS = {"intraday": "intraday_sentiment_index", "overnight": "overnight_sentiment_index"}


#: Instruments whose market isn't the first one.
MARKETS = {"R": "second_change"}


def _rows(spark, d):
    """Analysis rows with each instrument's own market, written once as several steps read them; sentiments rounded, so that values at a
    quantile compare alike in both engines."""
    rows = events.own_market(T.analysis(spark, d), MARKETS, "market_change")
    rows = rows.withColumns({c: F.round(c, 9) for c in SESSIONS.values()})
    return settle(rows.select("instrument", "date", "cc_return", F.col("own_market").alias("market_change"), *SESSIONS.values()), "analysis")


_P = f"""WITH RECURSIVE {T.ANALYSIS}, placed AS (SELECT * REPLACE (CASE instrument WHEN 'R' THEN second_change ELSE market_change END AS market_change), CAST(row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS INTEGER) AS position FROM analysis),
long AS (SELECT instrument, date, position, 'intraday' AS session, round(intraday_sentiment_index, 9) AS sentiment FROM placed WHERE intraday_sentiment_index IS NOT NULL UNION ALL
  SELECT instrument, date, position, 'overnight', round(overnight_sentiment_index, 9) FROM placed WHERE overnight_sentiment_index IS NOT NULL),
ends AS (SELECT instrument, session, quantile_cont(sentiment, 0.05) AS low, quantile_cont(sentiment, 0.95) AS high FROM long GROUP BY ALL),
tagged AS (SELECT l.*, CASE WHEN sentiment <= low THEN 'negative' ELSE 'positive' END AS direction, CASE WHEN sentiment <= low THEN -sentiment ELSE sentiment END AS extremeness, CASE WHEN sentiment <= low THEN low ELSE high END AS threshold
  FROM long l JOIN ends e ON e.instrument = l.instrument AND e.session = l.session WHERE sentiment <= low OR sentiment >= high)"""
_M = """, models AS (SELECT instrument, date, position, cc_return, market_change, regr_count(cc_return, market_change) OVER w AS k, regr_intercept(cc_return, market_change) OVER w AS alpha, regr_slope(cc_return, market_change) OVER w AS beta, regr_r2(cc_return, market_change) OVER w AS r_squared
  FROM placed WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING))"""
_AR = """ar AS (SELECT ev.instrument, ev.session, ev.direction, ev.date AS event_date, m.position - ev.position AS tau, m.cc_return - (ev.alpha + ev.beta * m.market_change) AS ar
  FROM ev JOIN models m ON m.instrument = ev.instrument AND m.position BETWEEN ev.position - 5 AND ev.position + 5 WHERE m.cc_return IS NOT NULL AND m.market_change IS NOT NULL)"""
#: Without selection: every candidate with a model is an event.
_R = f"""{_P}{_M}, ev AS (SELECT t.*, alpha, beta FROM tagged t JOIN models m ON m.instrument = t.instrument AND m.position = t.position WHERE k >= 30), {_AR}"""
#: The greedy choice, a candidate of each group at a time in the order of extremeness.
_CHOSEN = f"""{_P}{_M}, ranked AS (SELECT *, row_number() OVER (PARTITION BY instrument, session, direction ORDER BY -extremeness, position) AS r FROM tagged),
pick AS (SELECT DISTINCT instrument, session, direction, CAST(0 AS BIGINT) AS r, CAST([] AS INTEGER[]) AS chosen FROM tagged UNION ALL
  SELECT p.instrument, p.session, p.direction, k.r, CASE WHEN len(list_filter(p.chosen, lambda q: abs(q - k.position) <= 5)) > 0 THEN p.chosen ELSE list_append(p.chosen, k.position) END
  FROM pick p JOIN ranked k ON k.instrument = p.instrument AND k.session = p.session AND k.direction = p.direction AND k.r = p.r + 1),
taken AS (SELECT instrument, session, direction, unnest(chosen) AS position FROM (SELECT instrument, session, direction, arg_max(chosen, r) AS chosen FROM pick GROUP BY ALL)),
ev AS (SELECT t.*, alpha, beta, k AS estimation_n, r_squared, row_number() OVER (ORDER BY t.instrument, t.session, t.position) AS number FROM tagged t
  JOIN taken c ON c.instrument = t.instrument AND c.session = t.session AND c.direction = t.direction AND c.position = t.position
  JOIN models m ON m.instrument = t.instrument AND m.position = t.position WHERE k >= 30)"""


@register(f"{_P} SELECT instrument, session, date, direction, round(extremeness, 7) AS extremeness, round(threshold, 7) AS threshold FROM tagged")
def e1_e2_candidates(spark, d):
    return rounded(events.candidates(_rows(spark, d), SESSIONS).select("instrument", "session", "date", "direction", "extremeness", "threshold"), 7)


@register(f"{_CHOSEN} SELECT concat_ws('_', instrument, session, direction, number) AS event_id, instrument, session, direction, date, round(sentiment, 6) AS sentiment, round(threshold, 6) AS threshold, round(alpha, 6) AS alpha, round(beta, 6) AS beta, estimation_n, round(r_squared, 6) AS r_squared FROM ev")
def e3_e7_events(spark, d):
    return rounded(events.events(_rows(spark, d), SESSIONS).select("event_id", "instrument", "session", "direction", "date", "sentiment", "threshold", "alpha", "beta", "estimation_n", "r_squared"), 6)


@register(f"{_P}{_M} SELECT instrument, date, k AS estimation_n, round(CASE WHEN k >= 30 THEN alpha END, 6) AS alpha, round(CASE WHEN k >= 30 THEN beta END, 6) AS beta FROM models")
def e4_e5_market_models(spark, d):
    return rounded(events.market_models(_rows(spark, d)).select("instrument", "date", "estimation_n", "alpha", "beta"), 6)


def _all_events(spark, d):
    rows = _rows(spark, d)
    models = events.market_models(rows).select("instrument", "position", "alpha", "beta").filter("alpha IS NOT NULL")
    chosen = events.candidates(rows, SESSIONS).join(models, ["instrument", "position"])
    return events.abnormal_returns(chosen.withColumn("event_id", F.concat_ws("_", "instrument", "session", "direction", "date")), rows)


@register(f"{_R} SELECT instrument, session, direction, event_date, CAST(tau AS INTEGER) AS tau, round(ar, 6) AS abnormal_return FROM ar")
def e6_abnormal_returns(spark, d):
    return rounded(_all_events(spark, d).select("instrument", "session", "direction", "event_date", "tau", "abnormal_return"), 6)


_CARS = f"""w(session, first, last) AS (VALUES {", ".join(f"('{s}', {a}, {b})" for s, ws in events.WINDOWS.items() for a, b in ws)}),
cars AS (SELECT instrument, ar.session, direction, event_date, first, last, sum(ar) AS car FROM ar JOIN w ON w.session = ar.session AND tau BETWEEN first AND last GROUP BY ALL HAVING count(*) = last - first + 1)"""
_CAR = f"{_R}, {_CARS}"
_KEYS = "instrument, session, direction, first, last"
#: All tests of the windows' sums, adjusted over all rows.
_TESTED = f"""{sql.wilcoxon("cars", _KEYS, "car")}, stats AS (SELECT {_KEYS}, count(*) AS n, avg(car) AS mean, quantile_cont(car, 0.5) AS median, stddev_samp(car) AS std, avg(car) / (stddev_samp(car) / sqrt(count(*))) AS t FROM cars GROUP BY ALL),
tested AS (SELECT *, {dist.t_two_sided_sql("t", "(n - 1)")} AS p_value, CASE WHEN n >= 2 THEN 'OK' ELSE 'SKIP_TOO_FEW' END AS status FROM stats JOIN signed USING ({_KEYS})),
ordered AS (SELECT *, status = 'OK' AND p_value IS NOT NULL AS ok, count(*) OVER (PARTITION BY status = 'OK' AND p_value IS NOT NULL) AS m, row_number() OVER (PARTITION BY status = 'OK' AND p_value IS NOT NULL ORDER BY p_value) AS place FROM tested),
adjusted AS (SELECT *, CASE WHEN ok THEN least(1, min(p_value * m / place) OVER (PARTITION BY ok ORDER BY place DESC ROWS UNBOUNDED PRECEDING)) END AS p_bh, CASE WHEN ok THEN least(1, p_value * m) END AS p_bonferroni FROM ordered)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "median", "std", "p_value", "p_wilcoxon", "p_bh", "p_bonferroni")) + ", round(t, 5) AS t, coalesce(p_bh <= 0.05, false) AS reject_bh, coalesce(p_bonferroni <= 0.05, false) AS reject_bonferroni, status"


@register(f"{_CAR} SELECT instrument, session, direction, event_date, first, last, round(car, 6) AS car FROM cars")
def e8_car(spark, d):
    out = events.car(_all_events(spark, d))
    return rounded(out.select("instrument", "session", "direction", F.substring_index("event_id", "_", -1).cast("date").alias("event_date"), "first", "last", "car"), 6)


@register(f"{_CAR}, {_TESTED} SELECT {_KEYS}, n, {_ROUNDED} FROM adjusted")
def e9_car_summary(spark, d):
    return rounded(events.car_summary(events.car(_all_events(spark, d))), 6, t=5)


@register(f"{_CHOSEN}, {_AR}, {_CARS}, {_TESTED} SELECT {_KEYS}, n, {_ROUNDED} FROM adjusted WHERE p_value < 0.2")
def e9_e11_significant(spark, d):
    """The whole study over the selected events: windows significant before adjustment, with all p-values."""
    rows = _rows(spark, d)
    returns = events.abnormal_returns(events.events(rows, SESSIONS), rows)
    return rounded(events.significant(events.car_summary(events.car(returns)), alpha=0.2), 6, t=5)


@register(f"{_R} SELECT session, direction, CAST(tau AS INTEGER) AS tau, round(avg(ar), 6) AS mean_ar, count(*) AS n, round(sum(avg(ar)) OVER (PARTITION BY session, direction ORDER BY tau), 6) AS mean_car FROM ar GROUP BY session, direction, tau")
def e10_average_path(spark, d):
    return rounded(events.average_path(_all_events(spark, d), ["session", "direction"]), 6)
