"""Strategies, allocation rules and features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.models.logistic import top_contributions
from tallystone.operators import allocation, bars, signals
from tallystone.plans.catalog import register
from tallystone.plans.views import RATE_COLUMNS, RATES, RATES_SQL, C, L, candles, cut_candles, literal, long_candles

W = "WINDOW w AS (PARTITION BY secid ORDER BY date)"


def _ranked_sql(base: str, table: str, lookback: int, top: int, rule: str) -> str:
    condition, highest, sign = signals.RULES[rule]
    return f"""WITH {base}, r AS (SELECT * FROM (SELECT secid, date, close / lag(close, {lookback}) OVER w - 1 AS ret FROM {table} {W}) WHERE ret IS NOT NULL {"AND ret " + condition if condition else ""}),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY ret {"DESC" if highest else "ASC"}, secid) AS INTEGER) AS place FROM r)
SELECT secid, date, ret, place, CAST({sign / top!r} AS DOUBLE) AS weight FROM k WHERE place <= {top}"""


for name, rule in (("q2_momentum", "momentum"), ("q3_absolute_momentum", "absolute_momentum"), ("q4_mean_reversion", "mean_reversion"), ("q5_short_momentum", "short_momentum"), ("q6_short_overbought", "short_overbought")):
    register(name, lambda s, d, r=rule: signals.ranked(candles(s, d), r, 5, 3), _ranked_sql(C, "c", 5, 3, rule), "ret weight")
register("q2_momentum_long", lambda s, d: signals.ranked(long_candles(s, d), "momentum", 120, 2), _ranked_sql(L, "l", 120, 2, "momentum"), "ret weight")
register("q1_buy_and_hold", lambda s, d: signals.buy_and_hold(long_candles(s, d), "ASIA"), f"WITH {L} SELECT secid, date, 1.0::DOUBLE AS weight FROM l WHERE secid = 'ASIA'", "weight")
register(
    "q7_driven_basket",
    lambda s, d: signals.driven_basket(long_candles(s, d), "EUROPE", ["AFRICA", "ASIA", "AMERICA"], 20, 5),
    f"""WITH {L}, g AS (SELECT * FROM (SELECT date, lag(close, 5) OVER w / lag(close, 25) OVER w - 1 AS signal FROM l WHERE secid = 'EUROPE' {W}) WHERE signal > 0)
SELECT l.secid, l.date, g.signal, 1.0 / count(*) OVER (PARTITION BY l.date) AS weight FROM l JOIN g USING (date) WHERE l.secid IN ('AFRICA', 'ASIA', 'AMERICA')""",
    "signal weight",
)
register(
    "q7_driven_short",
    lambda s, d: signals.driven_basket(long_candles(s, d), "EUROPE", ["AFRICA", "ASIA", "AMERICA"], 20, 5, short=True),
    f"""WITH {L}, g AS (SELECT * FROM (SELECT date, lag(close, 5) OVER w / lag(close, 25) OVER w - 1 AS signal FROM l WHERE secid = 'EUROPE' {W}) WHERE signal < 0)
SELECT l.secid, l.date, g.signal, -1.0 / count(*) OVER (PARTITION BY l.date) AS weight FROM l JOIN g USING (date) WHERE l.secid IN ('AFRICA', 'ASIA', 'AMERICA')""",
    "signal weight",
)


register(
    "w13_once_a_month",
    lambda s, d: signals.once_a_month(signals.ranked(long_candles(s, d), "momentum", 60, 2), bars.union_calendar(long_candles(s, d))),
    f"""WITH {L}, r AS (SELECT * FROM (SELECT secid, date, close / lag(close, 60) OVER w - 1 AS ret FROM l {W}) WHERE ret IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC, secid) AS place FROM r),
h AS (SELECT date, min(date) OVER (PARTITION BY date_trunc('month', date)) AS decided FROM (SELECT DISTINCT date FROM l))
SELECT k.secid, h.date, 0.5::DOUBLE AS weight FROM h JOIN k ON k.date = h.decided AND place <= 2""",
    "weight",
)


def _index(s: SparkSession, d: str, secid: str) -> DataFrame:
    return long_candles(s, d).where(F.col("secid") == secid).select(F.lit("fund").alias("run_id"), "date", "close")


def _rates(s: SparkSession) -> DataFrame:
    return literal(s, RATES, RATE_COLUMNS)


FUND = f"""{L}, {RATES_SQL}, eq AS (SELECT date, close FROM l WHERE secid = 'ASIA'), bo AS (SELECT date, close AS bond FROM l WHERE secid = 'EUROPE'),
j AS (SELECT eq.date, eq.close, bo.bond FROM eq ASOF LEFT JOIN bo ON eq.date >= bo.date),
k AS (SELECT *, lag(date) OVER o AS prev, date_diff('day', lag(date) OVER o, date) AS days, close / lag(close) OVER o - 1 AS re, bond / lag(bond) OVER o - 1 AS rb FROM j WINDOW o AS (ORDER BY date)),
fr AS (SELECT 'fund' AS run_id, k.date, re - 0.008 * days / 365.0 AS r_equity, rb - 0.006 * days / 365.0 AS r_bonds, rate * days / 365.0 AS r_cash, days
  FROM k ASOF LEFT JOIN rates ON k.prev >= rates.date WHERE prev IS NOT NULL AND rb IS NOT NULL)"""


def fund(s: SparkSession, d: str) -> DataFrame:
    return allocation.fund_returns(_index(s, d, "ASIA"), _index(s, d, "EUROPE"), _rates(s))


register(
    "j6_fund_returns",
    lambda s, d: fund(s, d).withColumn("days", F.col("days").cast("long")),
    f"WITH {FUND} SELECT * FROM fr WHERE r_cash IS NOT NULL",
    "r_equity r_bonds r_cash",
)
register(
    "j7_easing",
    lambda s, d: allocation.easing(bars.union_calendar(long_candles(s, d)), _rates(s)),
    f"""WITH {L}, {RATES_SQL}, t AS (SELECT * FROM (SELECT date, sign(rate - lag(rate) OVER (ORDER BY date)) AS direction FROM rates) WHERE direction <> 0), k AS (SELECT DISTINCT date FROM l)
SELECT k.date, coalesce(direction < 0, false) AS easing FROM k ASOF LEFT JOIN t ON k.date >= t.date""",
)
HELD = "SELECT 'fund' AS run_id, date, last_value(kept IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS share FROM (SELECT date, CASE WHEN date = max(date) OVER (PARTITION BY date_trunc('week', date)) THEN raw END AS kept FROM m)"
register(
    "q9_trend",
    lambda s, d: allocation.trend_targets(_index(s, d, "ASIA")),
    f"""WITH {L}, eq AS (SELECT date, close FROM l WHERE secid = 'ASIA'), m AS (SELECT date, CASE WHEN count(*) OVER f = 200 THEN CAST(close > avg(close) OVER f AS INTEGER)::DOUBLE END AS raw FROM eq
  WINDOW f AS (ORDER BY date ROWS 199 PRECEDING)) {HELD}""",
    "share",
)
register(
    "q9_low_volatility",
    lambda s, d: allocation.low_volatility_targets(_index(s, d, "ASIA")),
    f"""WITH {L}, eq AS (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS r FROM l WHERE secid = 'ASIA'),
v AS (SELECT date, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f * {math.sqrt(252)!r} END AS vol FROM eq WINDOW f AS (ORDER BY date ROWS 19 PRECEDING)),
m AS (SELECT date, CASE WHEN count(vol) OVER f = 250 THEN CAST(vol < quantile_cont(vol, 0.5) OVER f AS INTEGER)::DOUBLE END AS raw FROM v WINDOW f AS (ORDER BY date ROWS 249 PRECEDING)) {HELD}""",
    "share",
)
register(
    "q9_risk_rule",
    lambda s, d: allocation.risk_targets(_index(s, d, "ASIA").select("run_id", "date", (F.dayofyear("date") / 366).alias("proba"), F.lit(0.4).alias("base_rate")), 1.5, 0.6),
    f"WITH {L}, m AS (SELECT date, CASE WHEN dayofyear(date) / 366.0 > 1.5 * 0.4 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS raw FROM l WHERE secid = 'ASIA') {HELD}",
    "share",
)
register(
    "f16_targets",
    lambda s, d: allocation.trend_targets(_index(s, d, "ASIA")).join(allocation.easing(bars.union_calendar(long_candles(s, d)), _rates(s)), "date").select("date", *allocation.targets(F.col("share"), F.col("easing"))),
    f"""WITH {L}, {RATES_SQL}, eq AS (SELECT date, close FROM l WHERE secid = 'ASIA'), m AS (SELECT date, CASE WHEN count(*) OVER f = 200 THEN CAST(close > avg(close) OVER f AS INTEGER)::DOUBLE END AS raw FROM eq
  WINDOW f AS (ORDER BY date ROWS 199 PRECEDING)), h AS ({HELD}),
t AS (SELECT * FROM (SELECT date, sign(rate - lag(rate) OVER (ORDER BY date)) AS direction FROM rates) WHERE direction <> 0),
e AS (SELECT h.date, share, coalesce(direction < 0, false) AS easing FROM h ASOF LEFT JOIN t ON h.date >= t.date)
SELECT date, share AS t_equity, CASE WHEN easing THEN 1 - share ELSE 0 END AS t_bonds, CASE WHEN NOT easing THEN 1 - share ELSE 0 END AS t_cash FROM e""",
    "t_equity t_bonds t_cash",
)


def _full(fn: str, column: str, n: int) -> str:
    frame = f"(PARTITION BY secid ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {fn} OVER {frame} END"


def market(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A market's currency and index of its candles, (date, close) each."""
    return tuple(c.where(F.col("secid") == k).select("date", "close") for k in ("EUROPE", "ASIA"))


FEATURES_SQL = f"""{L}, x AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM l {W}),
cur AS (SELECT date, close / lag(close, 60) OVER (ORDER BY date) - 1 AS currency_mom60 FROM l WHERE secid = 'EUROPE'),
ind AS (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS index_mom20, CASE WHEN count(ret) OVER f = 20 THEN stddev_samp(ret) OVER f END AS index_vol20
  FROM x WHERE secid = 'ASIA' WINDOW f AS (ORDER BY date ROWS 19 PRECEDING)),
own AS (SELECT secid, date, close / lag(close, 20) OVER w - 1 AS mom20, close / lag(close, 60) OVER w - 1 AS mom60, close / lag(close, 120) OVER w - 1 AS mom120,
  {_full("stddev_samp(ret)", "ret", 20)} AS vol20, close / {_full("avg(close)", "close", 50)} - 1 AS ma50 FROM x {W}),
bf AS (SELECT own.*, currency_mom60, index_mom20, index_vol20 FROM own ASOF LEFT JOIN cur ON own.date >= cur.date ASOF LEFT JOIN ind ON own.date >= ind.date)"""
#: Exponentially weighted deviation of returns over a span of 20; only the last 600 bars weigh more than nothing.
EWM = """xr AS (SELECT secid, date, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS r FROM l WINDOW w AS (PARTITION BY secid ORDER BY date)),
es AS (SELECT a.secid, a.date, sum(pow(19.0 / 21, a.i - b.i)) AS s1, sum(pow(19.0 / 21, 2 * (a.i - b.i))) AS s2, sum(pow(19.0 / 21, a.i - b.i) * b.r) AS sx,
  sum(pow(19.0 / 21, a.i - b.i) * b.r * b.r) AS sxx, count(b.r) AS n FROM xr a LEFT JOIN xr b ON a.secid = b.secid AND b.i BETWEEN a.i - 600 AND a.i AND b.r IS NOT NULL GROUP BY 1, 2),
ewm AS (SELECT secid, date, CASE WHEN n > 1 THEN sqrt(greatest(sxx / s1 - pow(sx / s1, 2), 0) * s1 * s1 / (s1 * s1 - s2)) END AS ewm_std FROM es)"""


def _bet_features(s: SparkSession, d: str) -> DataFrame:
    c = cut_candles(s, d)
    return signals.bet_features(c, *market(c))


register("m1_bet_features", _bet_features, f"WITH {FEATURES_SQL} SELECT * FROM bf", " ".join(signals.BET_FEATURES))
register(
    "m1_bet_features_alone",
    lambda s, d: signals.bet_features(long_candles(s, d)),
    f"WITH {FEATURES_SQL} SELECT own.*, 0.0::DOUBLE AS currency_mom60, 0.0::DOUBLE AS index_mom20, 0.0::DOUBLE AS index_vol20 FROM own",
    " ".join(signals.BET_FEATURES),
)
register(
    "m2_feature_frame",
    lambda s, d: signals.feature_frame(long_candles(s, d).select("secid", "date", F.col("close").alias("vol20"), F.col("open").alias("mom20"))),
    f"WITH {L} SELECT secid, date, open AS mom20, NULL::DOUBLE AS mom60, NULL::DOUBLE AS mom120, close AS vol20, NULL::DOUBLE AS ma50, NULL::DOUBLE AS currency_mom60, NULL::DOUBLE AS index_mom20, NULL::DOUBLE AS index_vol20 FROM l",
    "mom20 vol20",
)
_MODEL = {"close": (0.8, 1300.0, 250.0), "volume": (-0.3, 20.0, 9.0), "value": (0.1, 30000.0, 9000.0)}
register(
    "t5_top_contributions",
    lambda s, d: long_candles(s, d).select(
        "secid", "date", F.explode(top_contributions([*_MODEL], *[[m[i] for m in _MODEL.values()] for i in range(3)], n=2)).alias("c")
    ).select("secid", "date", F.col("c.name").alias("name"), F.col("c.value").alias("value")),
    f"""WITH {L}, k AS ({" UNION ALL ".join(f"SELECT secid, date, '{n}' AS name, ({n} - {m!r}) / {sc!r} * {c!r} AS value FROM l" for n, (c, m, sc) in _MODEL.items())})
SELECT secid, date, name, value FROM (SELECT *, row_number() OVER (PARTITION BY secid, date ORDER BY abs(value) DESC, name DESC) AS place FROM k) WHERE place <= 2""",
    "value",
)
YEAR = repr(math.sqrt(252))


def _f(fn: str, column: str, n: int) -> str:
    frame = f"(ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {fn} OVER {frame} END"


#: The tables that risk features are selected from, and the selection.
RISK_SQL = (
    f"""{L}, eq AS (SELECT date, close FROM l WHERE secid = 'ASIA'), bo AS (SELECT date, close AS bond FROM l WHERE secid = 'EUROPE'),
j AS (SELECT eq.date, eq.close, bo.bond FROM eq ASOF LEFT JOIN bo ON eq.date >= bo.date),
x AS (SELECT *, ln(close / lag(close) OVER o) AS r, ln(bond / lag(bond) OVER o) AS b FROM j WINDOW o AS (ORDER BY date))""",
    f"""SELECT 'fund' AS run_id, date, {_f("stddev_samp(r)", "r", 20)} * {YEAR} AS vol20, {_f("stddev_samp(r)", "r", 60)} * {YEAR} AS vol60,
  {_f("stddev_samp(r)", "r", 20)} / {_f("stddev_samp(r)", "r", 250)} AS vol_ratio, close / lag(close, 20) OVER o - 1 AS mom20, close / lag(close, 120) OVER o - 1 AS mom120,
  close / {_f("max(close)", "close", 250)} - 1 AS dd250, close / {_f("avg(close)", "close", 200)} - 1 AS ma200, bond / lag(bond, 60) OVER o - 1 AS bond_mom60,
  {_f("stddev_samp(b)", "b", 20)} * {YEAR} AS bond_vol20 FROM x WINDOW o AS (ORDER BY date)""",
)
register(
    "m3_risk_features",
    lambda s, d: allocation.risk_features(_index(s, d, "ASIA"), _index(s, d, "EUROPE")),
    f"WITH {RISK_SQL[0]} {RISK_SQL[1]}",
    "vol20 vol60 vol_ratio mom20 mom120 dd250 ma200 bond_mom60 bond_vol20",
)
