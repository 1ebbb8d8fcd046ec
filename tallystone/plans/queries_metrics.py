"""Metrics, monitors and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import finance
from tallystone.operators import metrics, monitoring, validation
from tallystone.operators.bars import average_turnover
from tallystone.plans.catalog import register
from tallystone.plans.views import FILLS, LOT_COLUMNS, LOTS, RATE_COLUMNS, RATES, RATES_SQL, L, fills, literal, long_candles, table, values
from tallystone.sources.ledger import summary


def equity(s: SparkSession, d: str) -> DataFrame:
    return long_candles(s, d).select(F.col("secid").alias("run_id"), "date", F.col("close").alias("equity"))


EQ = f"{L}, e AS (SELECT secid AS run_id, date, close AS equity FROM l)"
W = "WINDOW w AS (PARTITION BY run_id ORDER BY date)"
DD = """pk AS (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e),
bl AS (SELECT *, equity < peak AS below, sum(CASE WHEN equity < peak THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell,
  lag(date) OVER w AS prev, lead(date) OVER w AS nxt FROM pk WINDOW w AS (PARTITION BY run_id ORDER BY date)),
sp AS (SELECT run_id, spell, date_diff('day', min(coalesce(prev, date)), max(coalesce(nxt, date))) AS days FROM bl WHERE below GROUP BY 1, 2),
dd AS (SELECT run_id, min(equity / peak - 1) AS max_drawdown, coalesce((SELECT max(days) FROM sp WHERE sp.run_id = pk.run_id), 0) AS max_drawdown_days FROM pk GROUP BY 1)"""
DAILY = repr(1.16 ** (1 / 252) - 1)
register("a10_drawdowns", lambda s, d: metrics.drawdowns(equity(s, d)), f"WITH {EQ}, {DD} SELECT run_id, max_drawdown, CAST(max_drawdown_days AS BIGINT) AS max_drawdown_days FROM dd", "max_drawdown")
register(
    "a8_equity_metrics",
    lambda s, d: metrics.equity_metrics(equity(s, d), 0.16),
    f"""WITH {EQ}, {DD}, r AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret FROM e {W}), x AS (SELECT *, ret - {DAILY} AS ex FROM r),
b AS (SELECT run_id, arg_min(equity, date) AS start_equity, arg_max(equity, date) AS end_equity, date_diff('day', min(date), max(date)) AS days, stddev_samp(ret) AS sd, avg(ex) AS me,
  sqrt(sum(CASE WHEN ex < 0 THEN ex * ex ELSE 0 END) / count(ex)) AS down FROM x GROUP BY 1),
a AS (SELECT *, end_equity / start_equity - 1 AS total_return, pow(end_equity / start_equity, 365.25 / days) - 1 AS annual_return FROM b)
SELECT run_id, start_equity, end_equity, total_return, annual_return, max_drawdown, CAST(max_drawdown_days AS BIGINT) AS max_drawdown_days, me / sd * {math.sqrt(252)!r} AS sharpe,
  me / down * {math.sqrt(252)!r} AS sortino, annual_return / abs(max_drawdown) AS calmar FROM a JOIN dd USING (run_id)""",
    "start_equity end_equity total_return annual_return max_drawdown sharpe sortino calmar",
)
register(
    "j5_rate_excess",
    lambda s, d: metrics.equity_metrics(equity(s, d), 0.16, literal(s, RATES, RATE_COLUMNS)).select("run_id", "sharpe", "sortino"),
    f"""WITH {EQ}, {RATES_SQL}, r AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, lag(date) OVER w AS prev, date_diff('day', lag(date) OVER w, date) AS days FROM e {W}),
x AS (SELECT r.run_id, r.date, r.ret, ret - coalesce(rates.rate, (SELECT arg_min(rate, date) FROM rates)) * days / 365.0 AS ex FROM r ASOF LEFT JOIN rates ON r.prev >= rates.date),
b AS (SELECT run_id, stddev_samp(ret) AS sd, avg(ex) AS me, sqrt(sum(CASE WHEN ex < 0 THEN ex * ex ELSE 0 END) / count(ex)) AS down FROM x GROUP BY 1)
SELECT run_id, me / sd * {math.sqrt(252)!r} AS sharpe, me / down * {math.sqrt(252)!r} AS sortino FROM b""",
    "sharpe sortino",
)
register(
    "a7_fill_metrics",
    lambda s, d: metrics.fill_metrics(fills(s, d)),
    f"""WITH {FILLS} SELECT run_id, count(*) AS n_trades, sum(order_value) AS turnover, sum(costs) AS total_costs, count(*) FILTER (realized_pnl > 0) / count(realized_pnl) AS win_rate,
  sum(realized_pnl) FILTER (realized_pnl > 0) / -sum(realized_pnl) FILTER (realized_pnl < 0) AS profit_factor FROM f GROUP BY 1""",
    "turnover total_costs win_rate profit_factor",
    4,
)
register(
    "a6_tax_by_year",
    lambda s, d: metrics.tax_by_year(fills(s, d), 0.13),
    f"WITH {FILLS} SELECT run_id, CAST(year(date) AS INTEGER) AS year, sum(realized_pnl) AS pnl, greatest(sum(realized_pnl), 0.0) * 0.13 AS tax FROM f WHERE realized_pnl IS NOT NULL GROUP BY 1, 2",
    "pnl tax",
    3,
)
register(
    "a11_monthly",
    lambda s, d: metrics.monthly(equity(s, d)),
    f"""WITH {EQ}, m AS (SELECT run_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(equity, date) AS equity FROM e GROUP BY 1, 2),
b AS (SELECT run_id, arg_min(equity, date) AS f, min(CAST(date_trunc('month', date) AS DATE)) AS lo, max(CAST(date_trunc('month', date) AS DATE)) AS hi FROM e GROUP BY 1),
k AS (SELECT run_id, f, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM b)
SELECT k.run_id, k.month, m.equity, m.equity / CASE WHEN row_number() OVER w = 1 THEN k.f ELSE lag(m.equity) OVER w END - 1 AS ret FROM k LEFT JOIN m ON m.run_id = k.run_id AND m.month = k.month
WINDOW w AS (PARTITION BY k.run_id ORDER BY k.month)""",
    "equity ret",
)
register(
    "a12_yearly",
    lambda s, d: metrics.yearly(equity(s, d)),
    f"""WITH {EQ}, y AS (SELECT run_id, CAST(year(date) AS INTEGER) AS year, arg_max(equity, date) AS a, arg_min(equity, date) AS f FROM e GROUP BY 1, 2)
SELECT run_id, year, a / coalesce(lag(a) OVER (PARTITION BY run_id ORDER BY year), f) - 1 AS ret FROM y""",
    "ret",
)
register(
    "a15_growth",
    lambda s, d: metrics.growth(table(s, d, "orders").select(F.col("o_orderpriority").alias("run_id"), (F.col("o_custkey") % 20 / 100).alias("rate"))),
    """SELECT o_orderpriority AS run_id, exp(sum(ln(1 + o_custkey % 20 / 100.0 / 365.0))) AS growth, pow(exp(sum(ln(1 + o_custkey % 20 / 100.0 / 365.0))), 365.25 / count(*)) - 1 AS annual,
  avg(o_custkey % 20 / 100.0) AS mean_rate FROM orders GROUP BY 1""",
    "growth annual mean_rate",
)
register(
    "a16_money_market",
    lambda s, d: metrics.money_market(literal(s, RATES, RATE_COLUMNS), "1995-01-01", "2001-07-01", 20_000.0),
    f"""WITH {RATES_SQL}, k AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS date),
r AS (SELECT k.date, greatest(coalesce(rates.rate, (SELECT arg_min(rate, date) FROM rates)) - 0.005, 0.0) AS rate FROM k ASOF LEFT JOIN rates ON k.date >= rates.date)
SELECT 20000.0 * exp(sum(ln(1 + rate / 365.0))) AS end_equity, pow(exp(sum(ln(1 + rate / 365.0))), 365.25 / count(*)) - 1 AS annual_return, avg(rate) AS average_rate FROM r""",
    "end_equity annual_return average_rate",
)
register(
    "a17_buy_and_hold",
    lambda s, d: metrics.buy_and_hold(long_candles(s, d)),
    f"WITH {L} SELECT secid, arg_max(close, date) / arg_min(close, date) - 1 AS total_return, pow(arg_max(close, date) / arg_min(close, date), 365.25 / date_diff('day', min(date), max(date))) - 1 AS annual_return FROM l GROUP BY 1",
    "total_return annual_return",
)


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.to_json(F.struct((F.col("c_acctbal") / 1e4).alias("annual_return"))).alias("metrics"))


register("a18_ledger_summary", lambda s, d: summary(_runs(s, d)), "SELECT count(*) AS n_runs, max(c_acctbal / 1e4) AS best, median(c_acctbal / 1e4) AS median, count(*) > 10 AS too_many FROM customer", "best median")


def _samples(s: SparkSession, d: str) -> DataFrame:
    e = long_candles(s, d)
    both = e.select(F.explode(F.array(F.struct(F.lit("close").alias("feature"), F.col("close").alias("value")), F.struct(F.lit("volume").alias("feature"), F.col("volume").alias("value")))).alias("x"), (F.col("date") >= F.lit("1999-01-01").cast("date")).alias("live"))
    return both.select("x.feature", "live", "x.value")


S = f"{L}, s AS (SELECT 'close' AS feature, date >= DATE '1999-01-01' AS live, close AS value FROM l UNION ALL SELECT 'volume', date >= DATE '1999-01-01', volume FROM l)"
register(
    "a20_psi",
    lambda s, d: monitoring.psi(_samples(s, d)),
    f"""WITH {S}, q AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q, min(value) AS lo, max(value) AS hi FROM s WHERE NOT live GROUP BY 1),
i AS (SELECT feature, list_filter(q, lambda x: x > lo AND x < hi) AS q FROM q),
b AS (SELECT feature, len(list_filter(q, lambda x: x <= value)) AS bin, count(*) FILTER (NOT live) AS e, count(*) FILTER (live) AS a FROM s JOIN i USING (feature) GROUP BY 1, 2),
p AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) + 1e-6 AS e, a / sum(a) OVER (PARTITION BY feature) + 1e-6 AS a FROM b)
SELECT feature, sum((a - e) * ln(a / e)) AS psi, sum((a - e) * ln(a / e)) > 0.25 AS strong FROM p GROUP BY 1""",
    "psi",
)
register(
    "t6_psi_table",
    lambda s, d: monitoring.worst_first(monitoring.psi(_samples(s, d)), "psi").select("feature", "place"),
    f"""WITH {S}, q AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q, min(value) AS lo, max(value) AS hi FROM s WHERE NOT live GROUP BY 1),
i AS (SELECT feature, list_filter(q, lambda x: x > lo AND x < hi) AS q FROM q),
b AS (SELECT feature, len(list_filter(q, lambda x: x <= value)) AS bin, count(*) FILTER (NOT live) AS e, count(*) FILTER (live) AS a FROM s JOIN i USING (feature) GROUP BY 1, 2),
p AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) + 1e-6 AS e, a / sum(a) OVER (PARTITION BY feature) + 1e-6 AS a FROM b)
SELECT feature, CAST(row_number() OVER (ORDER BY sum((a - e) * ln(a / e)) DESC, feature) AS INTEGER) AS place FROM p GROUP BY 1""",
)
register(
    "a22_ks_distance",
    lambda s, d: monitoring.ks_distance(_samples(s, d)),
    f"""WITH {S}, k AS (SELECT feature, value, count(*) FILTER (NOT live) AS e, count(*) FILTER (live) AS a FROM s GROUP BY 1, 2),
g AS (SELECT feature, e, a, abs(sum(e) OVER w / sum(e) OVER (PARTITION BY feature) - sum(a) OVER w / sum(a) OVER (PARTITION BY feature)) AS gap FROM k
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
r AS (SELECT feature, max(gap) AS statistic, CAST(sum(e) AS BIGINT) AS n_reference, CAST(sum(a) AS BIGINT) AS n_live FROM g GROUP BY 1),
x AS (SELECT *, statistic * sqrt(n_reference * n_live / (n_reference + n_live)::DOUBLE) AS x FROM r)
SELECT feature, statistic, n_reference, n_live, CASE WHEN x < 1e-3 THEN 1.0::DOUBLE
  ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END AS p_value FROM x""",
    "statistic p_value",
)


def _returns(s: SparkSession, d: str) -> DataFrame:
    from tallystone.operators.series import with_returns

    return with_returns(long_candles(s, d)).select("secid", "ret")


register(
    "a24_moments",
    lambda s, d: metrics.return_moments(_returns(s, d), "secid"),
    f"""WITH {L}, r AS (SELECT secid, close / lag(close) OVER (PARTITION BY secid ORDER BY date) - 1 AS ret FROM l), m AS (SELECT secid, avg(ret) AS mu, stddev_samp(ret) AS sd FROM r GROUP BY 1)
SELECT secid, count(*) AS n, any_value(mu / sd) AS sharpe, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) AS kurt
FROM r JOIN m USING (secid) WHERE ret IS NOT NULL GROUP BY 1""",
    "sharpe skew kurt",
)


def phi(x: str) -> str:
    """The normal distribution function in SQL, by its series; 0 or 1 beyond 6."""
    terms = f"list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(abs({x})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 6 THEN 1.0 WHEN {x} < -6 THEN 0.0 WHEN {x} = 0 THEN 0.5 ELSE 0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms} END)"


register(
    "a26_deflated_sharpe",
    lambda s, d: metrics.deflated_sharpe(metrics.return_moments(_returns(s, d), "secid")),
    f"""WITH RECURSIVE {L}, r AS (SELECT secid, close / lag(close) OVER (PARTITION BY secid ORDER BY date) - 1 AS ret FROM l), m AS (SELECT secid, avg(ret) AS mu, stddev_samp(ret) AS sd FROM r GROUP BY 1),
k AS (SELECT secid, count(*) AS n, any_value(mu / sd) AS sharpe, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) AS kurt
  FROM r JOIN m USING (secid) WHERE ret IS NOT NULL GROUP BY 1),
a AS (SELECT count(*) AS n_trials, stddev_samp(sharpe) AS dev FROM k),
b AS (SELECT * FROM k ORDER BY sharpe DESC LIMIT 1),
q AS (SELECT 1 - 1.0 / n_trials AS p, 1 AS which FROM a UNION ALL SELECT 1 - 1 / (n_trials * exp(1)), 2 FROM a),
z AS (SELECT which, p, -6.0::DOUBLE AS lo, 6.0::DOUBLE AS hi, 0 AS i FROM q UNION ALL
  SELECT which, p, CASE WHEN f < p THEN mid ELSE lo END, CASE WHEN f < p THEN hi ELSE mid END, i + 1 FROM (SELECT *, {phi("mid")} AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM z WHERE i < 60))),
e AS (SELECT n_trials, dev * ((1 - {metrics.GAMMA!r}) * (SELECT (lo + hi) / 2 FROM z WHERE i = 60 AND which = 1) + {metrics.GAMMA!r} * (SELECT (lo + hi) / 2 FROM z WHERE i = 60 AND which = 2)) AS expected_best FROM a),
s AS (SELECT n_trials, expected_best, sharpe * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS x, (sharpe - expected_best) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS y FROM e, b)
SELECT n_trials, expected_best, {phi("x")} AS plain, {phi("y")} AS deflated, {phi("y")} > 0.95 AS passed FROM s""",
    "expected_best plain deflated",
)


def _performance(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("t"), F.col("o_orderpriority").alias("config")).agg((F.avg("o_totalprice") / 1e5).alias("value"))
    whole = x.groupBy("t").agg(F.count("*").alias("k")).where("k = 5").select("t")
    return x.join(whole, "t")


register(
    "a27_cscv",
    lambda s, d: validation.cscv(_performance(s, d), 6),
    """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS t, o_orderpriority AS config, avg(o_totalprice) / 1e5 AS value FROM orders GROUP BY 1, 2),
p AS (SELECT t, ntile(6) OVER (ORDER BY t) - 1 AS part FROM (SELECT t FROM x GROUP BY 1 HAVING count(*) = 5)),
s AS (SELECT part, config, sum(value) AS s, count(*) AS n FROM x JOIN p USING (t) GROUP BY 1, 2),
m AS (SELECT i AS mask FROM range(0, 64) r(i) WHERE bit_count(i) = 3),
v AS (SELECT mask, config, sum(s) FILTER ((mask >> part) & 1 = 1) / sum(n) FILTER ((mask >> part) & 1 = 1) AS i, sum(s) FILTER ((mask >> part) & 1 = 0) / sum(n) FILTER ((mask >> part) & 1 = 0) AS o FROM s CROSS JOIN m GROUP BY 1, 2),
b AS (SELECT *, first_value(o) OVER (PARTITION BY mask ORDER BY i DESC, config) AS best FROM v),
k AS (SELECT mask, least(greatest(count(*) FILTER (o < best) / (count(*) - 1), 1e-6), 1 - 1e-6) AS r FROM b GROUP BY 1)
SELECT avg(CASE WHEN ln(r / (1 - r)) <= 0 THEN 1.0 ELSE 0.0 END) AS pbo, count(*) AS n_combinations, quantile_cont(ln(r / (1 - r)), 0.5) AS median_logit FROM k""",
    "pbo median_logit",
)
register(
    "a28_auc",
    lambda s, d: monitoring.auc(table(s, d, "lineitem").select(F.col("l_linestatus").alias("key"), (F.col("l_returnflag") == "A").cast("int").alias("y"), F.col("l_quantity").alias("score")), "key"),
    """WITH x AS (SELECT l_linestatus AS key, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, l_quantity AS score FROM lineitem),
r AS (SELECT key, y, rank() OVER (PARTITION BY key ORDER BY score) + (count(*) OVER (PARTITION BY key, score) - 1) / 2.0 AS r FROM x)
SELECT key, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auc FROM r GROUP BY 1""",
    "auc",
)
register(
    "a30_resolution",
    lambda s, d: metrics.resolution(
        long_candles(s, d).groupBy("secid").agg(F.min_by("close", "date").alias("price")).join(literal(s, LOTS, LOT_COLUMNS), "secid").select("secid", (F.col("price") * F.col("lot")).alias("lot_cost")), 20_000.0, 4, 0.25
    ),
    f"""WITH {L}, lots AS (SELECT * FROM {values(LOTS, LOT_COLUMNS)}), x AS (SELECT secid, arg_min(close, date) * any_value(lot) AS lot_cost FROM l JOIN lots USING (secid) GROUP BY 1)
SELECT avg(lot_cost) AS mean_lot_cost, count(*) FILTER (lot_cost <= 5000) AS affordable, min(lot_cost) / 20000 AS min_step, coalesce(string_agg(secid, ',' ORDER BY secid) FILTER (lot_cost > 5000), '') AS too_dear FROM x""",
    "mean_lot_cost min_step",
)
COSTS = finance.Costs()
COST_SQL = """greatest(v * 0.05 / 100, 1.0) AS broker, v * 0.01 / 100 AS exchange, v * 0.05 / 100 AS half_spread, v * (0.05 + 5.0 * v / adv) / 100 AS slippage"""


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 10).alias("v"), (F.col("o_custkey") * 5000.0).alias("adv"))


ORDERS = "o AS (SELECT o_orderkey, o_totalprice / 10 AS v, o_custkey * 5000.0 AS adv FROM orders)"
STATUS = "CASE WHEN v IS NULL OR v <= 0 THEN 'invalid' WHEN adv IS NULL OR NOT adv > 0 THEN 'no turnover' WHEN v / adv > 0.05 THEN 'rejected' WHEN v / adv > 0.01 THEN 'warning' ELSE 'ok' END"
register(
    "f1_costs",
    lambda s, d: _orders(s, d).withColumn("c", finance.trade_costs(F.col("v"), F.col("adv"), COSTS)).where("c is not null").select("o_orderkey", "c.*"),
    f"WITH {ORDERS} SELECT *, broker + exchange + half_spread + slippage AS total FROM (SELECT o_orderkey, {COST_SQL} FROM o WHERE {STATUS} IN ('ok', 'warning'))",
    "broker exchange half_spread slippage total",
    10,
)
register("f2_fill_status", lambda s, d: _orders(s, d).select("o_orderkey", finance.fill_status(F.col("v"), F.col("adv"), COSTS).alias("status")), f"WITH {ORDERS} SELECT o_orderkey, {STATUS} AS status FROM o")
register(
    "f3_sizing",
    lambda s, d: table(s, d, "part").select("p_partkey", finance.position_lots(F.col("p_retailprice"), F.lit(2), F.lit(12_000.0), F.lit(9_500.0), F.lit(5e6), COSTS).cast("long").alias("lots")),
    """SELECT p_partkey, coalesce(max(k), 0) AS lots FROM (SELECT p_partkey, p_retailprice * 2 AS c, unnest(range(0, 1 + CAST(floor(9500.0 / (p_retailprice * 2)) AS BIGINT))) AS k FROM part)
WHERE k = 0 OR k * c + greatest(k * c * 0.05 / 100, 1.0) + k * c * 0.01 / 100 + k * c * 0.05 / 100 + k * c * (0.05 + 5.0 * k * c / 5e6) / 100 <= 9500.0 GROUP BY 1""",
)
register(
    "f4_target_lots",
    lambda s, d: table(s, d, "customer").select("c_custkey", finance.target_lots(F.col("c_custkey") % 3, F.col("c_acctbal") / 1000).alias("lots")),
    "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN trunc(c_acctbal / 1000) ELSE sign(c_acctbal) * floor(abs(c_acctbal / 1000) + 0.5) END AS BIGINT) AS lots FROM customer",
)
register(
    "f5_power_of_ten_lot",
    lambda s, d: table(s, d, "part").select("p_partkey", finance.power_of_ten_lot(F.lit(5.0), F.col("p_retailprice")).alias("lot")),
    "SELECT p_partkey, pow(10.0, floor(log10(5.0 / p_retailprice))) AS lot FROM part",
    "lot",
    9,
)
#: Market profiles: per cent of value for commission, exchange fee, half spread and slippage (fixed values).
MARKETS = [("stocks", 0.05, 0.01, 0.05, 0.05, 0.16), ("foreign stocks", 0.005, 0.0, 0.01, 0.015, 0.05), ("coins", 0.1, 0.0, 0.02, 0.05, 0.05)]
register(
    "f6_markets",
    lambda s, d: s.createDataFrame(MARKETS, "market string, a double, b double, c double, e double, rf double").select(
        "market", (2 * (F.col("a") + F.col("b") + F.col("c") + F.col("e"))).alias("round_trip_pct"), finance.break_even(F.col("rf"), F.lit(1500.0), F.lit(20_000.0)).alias("break_even")
    ),
    f"SELECT market, 2 * (a + b + c + e) AS round_trip_pct, rf + 1500.0 / 20000.0 AS break_even FROM {values(MARKETS, 'market VARCHAR(20), a DOUBLE, b DOUBLE, c DOUBLE, e DOUBLE, rf DOUBLE')}",
    "round_trip_pct break_even",
)
register(
    "f7_verdict",
    lambda s, d: table(s, d, "customer").select("c_custkey", finance.verdict(F.col("c_acctbal") / 1e4, F.lit(0.16), F.lit(0.235)).alias("verdict")),
    """SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'no data' WHEN c_acctbal / 1e4 < 0.16 THEN 'below risk-free' WHEN c_acctbal / 1e4 < 0.235 THEN 'below break-even'
  WHEN c_acctbal / 1e4 < 0.235 + 0.1 THEN 'no margin' ELSE 'passes' END AS verdict FROM customer""",
)
register(
    "f8_formats",
    lambda s, d: table(s, d, "part").select("p_partkey", finance.spaced_number(F.col("p_retailprice") * 1000 + 0.004).alias("money"), finance.percent(F.col("p_size") / F.lit(7.0) + 0.0001).alias("share")),
    "SELECT p_partkey, replace(format('{:,.2f}', p_retailprice * 1000 + 0.004), ',', ' ') AS money, format('{:.1f}', (p_size / 7.0 + 0.0001) * 100) || '%' AS share FROM part",
)
register(
    "f10_text_amounts",
    lambda s, d: table(s, d, "part").select("p_partkey", finance.amount(F.concat(F.lit(" "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")), F.lit(" RUB"))).alias("amount"), finance.first_date(F.concat(F.lit("on "), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit(".03.2024, late"))).alias("date")),
    "SELECT p_partkey, p_retailprice AS amount, make_date(2024, 3, CAST(p_size % 28 + 1 AS BIGINT)) AS date FROM part",
    "amount",
)
register(
    "f11_logit",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", finance.logit(F.col("l_discount")).alias("logit"), finance.sigmoid(F.col("l_tax")).alias("sigmoid")),
    "SELECT l_orderkey, l_linenumber, l_partkey, ln(least(greatest(l_discount, 1e-9), 1 - 1e-9) / (1 - least(greatest(l_discount, 1e-9), 1 - 1e-9))) AS logit, 1 / (1 + exp(-l_tax)) AS sigmoid FROM lineitem",
    "logit sigmoid",
)
register(
    "f14_params_key",
    lambda s, d: table(s, d, "nation").select("n_nationkey", finance.canonical_params(F.create_map(F.lit("top_n"), F.col("n_regionkey"), F.lit("lookback"), F.col("n_nationkey"))).alias("key")),
    """SELECT n_nationkey, '{"lookback":' || n_nationkey || ',"top_n":' || n_regionkey || '}' AS key FROM nation""",
)
register(
    "f12_params_hash",
    lambda s, d: table(s, d, "nation").select("n_nationkey", finance.params_hash(F.create_map(F.lit("top_n"), F.col("n_regionkey"), F.lit("lookback"), F.col("n_nationkey"))).alias("hash")),
    """SELECT n_nationkey, substr(sha256('{"lookback":' || n_nationkey || ',"top_n":' || n_regionkey || '}'), 1, 16) AS hash FROM nation""",
)
register(
    "a4_capacity",
    lambda s, d: average_turnover(long_candles(s, d)).groupBy("secid").agg(F.max_by("adv", "date").alias("adv")).withColumn("most", F.col("adv") * COSTS.reject_share),
    f"WITH {L}, a AS (SELECT secid, date, avg(value) OVER (PARTITION BY secid ORDER BY date ROWS 19 PRECEDING) AS adv FROM l) SELECT secid, arg_max(adv, date) AS adv, arg_max(adv, date) * 0.05 AS most FROM a GROUP BY 1",
    "adv most",
    7,
)
