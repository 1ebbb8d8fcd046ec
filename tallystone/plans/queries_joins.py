"""As-of joins, memberships, dividends, labels, folds, sets and sources."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.engine.walkforward import year_windows
from tallystone.models import registry
from tallystone.models.logistic import LinearModel
from tallystone.operators import asof, bars, labeling, validation
from tallystone.plans.catalog import register
from tallystone.plans.views import (
    DIVIDEND_COLUMNS,
    DIVIDENDS,
    DIVIDENDS_SQL,
    MEMBER_COLUMNS,
    MEMBERS,
    MEMBERS_SQL,
    RATE_COLUMNS,
    RATES,
    RATES_SQL,
    C,
    L,
    candles,
    cut_candles,
    literal,
    long_candles,
    table,
)
from tallystone.operators.persist import cut, shared_folder
from tallystone.sources import dataset, html_tables, ledger, remote


def _rates(s: SparkSession) -> DataFrame:
    return literal(s, RATES, RATE_COLUMNS)


def _feature(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.concat(F.lit("U"), F.col("o_custkey") % 50).alias("secid"), F.to_date("o_orderdate").alias("event_ts"), F.col("o_totalprice").alias("value"))
    return o.groupBy("secid", "event_ts").agg(F.max("value").alias("value"))


FEATURE = "f AS (SELECT 'U' || (o_custkey % 50) AS secid, CAST(o_orderdate AS DATE) AS event_ts, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
REQUESTS = "q AS (SELECT DISTINCT 'U' || (l_partkey % 50) AS secid, CAST(l_shipdate AS DATE) AS ts FROM lineitem)"


def _requests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.concat(F.lit("U"), F.col("l_partkey") % 50).alias("secid"), F.to_date("l_shipdate").alias("ts")).distinct()


register(
    "j1_feature_asof",
    lambda s, d: asof.feature_asof(_requests(s, d), _feature(s, d), 45, ["secid"]),
    f"WITH {FEATURE}, {REQUESTS} SELECT q.secid, q.ts, f.event_ts, f.value FROM q ASOF LEFT JOIN f ON q.secid = f.secid AND q.ts >= f.event_ts + 45",
    "value",
)
for policy, filled in (("null", "rate"), ("first", "coalesce(rate, (SELECT arg_min(rate, date) FROM rates))"), ("zero", "coalesce(rate, 0.0)")):
    register(
        f"j2_rate_{policy}",
        lambda s, d, p=policy: asof.step_lookup(bars.union_calendar(long_candles(s, d)), "date", _rates(s), "date", "rate", p),
        f"WITH {L}, {RATES_SQL}, k AS (SELECT DISTINCT date FROM l) SELECT k.date, {filled} AS rate FROM k ASOF LEFT JOIN rates ON k.date >= rates.date",
        "rate",
    )
register(
    "j3_membership",
    lambda s, d: asof.members_asof(long_candles(s, d).select("secid", "date"), "date", literal(s, MEMBERS, MEMBER_COLUMNS)),
    f"""WITH {L}, {MEMBERS_SQL}, k AS (SELECT DISTINCT snapshot_date FROM members), a AS (SELECT l.secid, l.date, k.snapshot_date FROM l ASOF JOIN k ON l.date >= k.snapshot_date)
SELECT a.secid, a.date FROM a JOIN members m ON m.snapshot_date = a.snapshot_date AND m.secid = a.secid""",
)
register(
    "j8_asof_forward",
    lambda s, d: asof.asof_forward(literal(s, DIVIDENDS, DIVIDEND_COLUMNS).select("secid", "record_date", "amount"), long_candles(s, d).select("secid", F.col("date").alias("pay_date")), ["secid"], "record_date", "pay_date", ["pay_date"]),
    f"WITH {L}, {DIVIDENDS_SQL} SELECT v.secid, v.record_date, v.amount, l.date AS pay_date FROM dividends v ASOF LEFT JOIN l ON v.secid = l.secid AND v.record_date <= l.date",
    "amount",
)
EX = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM l)),
a AS (SELECT v.*, coalesce(cal.pos, -1) AS last FROM dividends v ASOF LEFT JOIN cal ON coalesce(v.last_day_with_rights, v.record_date) >= cal.date),
p AS (SELECT *, CASE WHEN last_day_with_rights IS NOT NULL THEN last + 1 ELSE last - CASE WHEN record_date >= DATE '2023-07-31' THEN 1 ELSE 2 END + 1 END AS pos FROM a),
ex AS (SELECT p.secid, cal.date AS ex_date, p.amount, min(p.record_date) AS record_date FROM p JOIN cal ON cal.pos = p.pos WHERE p.pos > 0 GROUP BY 1, 2, 3)"""
register("j9_ex_dates", lambda s, d: asof.ex_dates(literal(s, DIVIDENDS, DIVIDEND_COLUMNS), long_candles(s, d)), f"WITH {L}, {DIVIDENDS_SQL}, {EX} SELECT * FROM ex", "amount")


def _plausible(s: SparkSession, d: str) -> DataFrame:
    c = cut_candles(s, d)
    return asof.plausible_dividends(asof.ex_dates(literal(s, DIVIDENDS, DIVIDEND_COLUMNS), c), c)


register(
    "p11_plausible_dividends",
    _plausible,
    f"""WITH {L}, {DIVIDENDS_SQL}, {EX}, b AS (SELECT ex.*, l.close AS prev_close FROM ex ASOF LEFT JOIN l ON ex.secid = l.secid AND ex.ex_date > l.date),
n AS (SELECT b.*, l.open AS next_open FROM b ASOF LEFT JOIN l ON b.secid = l.secid AND b.ex_date <= l.date)
SELECT secid, ex_date, amount, amount / prev_close AS ratio,
  coalesce(amount / prev_close BETWEEN 0.0005 AND 0.35 OR (amount / prev_close > 0.35 AND coalesce(prev_close - next_open >= 0.5 * amount, false)), false) AS kept FROM n""",
    "amount ratio",
)
for name, first, sign in (("p17_own_span", False, ">"), ("p17_own_span_with_first", True, ">=")):
    register(
        name,
        lambda s, d, first=first: asof.within_span(literal(s, DIVIDENDS, DIVIDEND_COLUMNS), long_candles(s, d), with_first=first).select("secid", "record_date", "amount"),
        f"WITH {L}, {DIVIDENDS_SQL}, m AS (SELECT secid, min(date) AS lo, max(date) AS hi FROM l GROUP BY 1) SELECT v.secid, record_date, amount FROM dividends v JOIN m USING (secid) WHERE record_date {sign} lo AND record_date <= hi",
        "amount",
    )
register(
    "j14_semi", lambda s, d: long_candles(s, d).join(literal(s, MEMBERS, MEMBER_COLUMNS).where("snapshot_date = '1999-03-15'"), "secid", "left_semi").groupBy("secid").agg(F.count("*").alias("n")),
    f"WITH {L}, {MEMBERS_SQL} SELECT secid, count(*) AS n FROM l WHERE secid IN (SELECT secid FROM members WHERE snapshot_date = '1999-03-15') GROUP BY 1",
)
register(
    "j15_anti", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
register("j19_grid", lambda s, d: s.sql("SELECT lookback, lag FROM VALUES (20), (60), (120) AS a(lookback) CROSS JOIN VALUES (0), (21), (63) AS b(lag)"), "SELECT lookback, lag FROM (VALUES (20), (60), (120)) AS a(lookback) CROSS JOIN (VALUES (0), (21), (63)) AS b(lag)")


def _events(c: DataFrame) -> DataFrame:
    """An event every bar of every security, with a target of 2 % and a side by the weekday."""
    return labeling.numbered(c).select("secid", F.col("date").alias("t0"), F.lit(0.02).alias("target"), F.when(F.dayofweek("date") > 3, 1.0).otherwise(-1.0).alias("side"))


SIDES = "CASE WHEN dayofweek(date) + 1 > 3 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side"
BARRIER = f"""n AS (SELECT secid, date, close, row_number() OVER (PARTITION BY secid ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY secid) AS n_bars FROM l),
e AS (SELECT secid, date AS t0, close AS entry, pos, least(pos + 10, n_bars - 1) AS stop, {SIDES} FROM n),
p AS (SELECT e.*, n.pos AS spot, n.date AS bar, (n.close / e.entry - 1) * e.side AS ret FROM e JOIN n ON n.secid = e.secid AND n.pos BETWEEN e.pos AND e.stop WHERE e.stop > e.pos),
h AS (SELECT secid, t0, side, min(spot) FILTER (ret >= 0.02) AS up, min(spot) FILTER (ret <= -0.02) AS down, max(spot) AS stop FROM p GROUP BY 1, 2, 3),
b AS (SELECT h.secid, h.t0, h.side, p.bar AS t1, p.ret, CASE WHEN p.spot = h.up THEN 1 WHEN p.spot = h.down THEN -1 ELSE 0 END AS label
  FROM h JOIN p ON p.secid = h.secid AND p.t0 = h.t0 AND p.spot = least(h.stop, h.up, h.down))"""


def _barriers(s: SparkSession, d: str) -> DataFrame:
    c = cut_candles(s, d)
    return labeling.triple_barrier(_events(c), c)


def _meta(s: SparkSession, d: str) -> DataFrame:
    c = cut_candles(s, d)
    return labeling.meta_labels(_events(c), c)


def _concurrency(s: SparkSession, d: str) -> DataFrame:
    c = cut_candles(s, d)
    return labeling.concurrency_weights(labeling.triple_barrier(_events(c), c), c)


register("w21_triple_barrier", _barriers, f"WITH {L}, {BARRIER} SELECT * FROM b", "side ret")
register("w23_meta_labels", _meta, f"WITH {L}, {BARRIER} SELECT *, CAST(ret > 0 AS INTEGER) AS meta FROM b", "side ret")
register(
    "w24_concurrency",
    _concurrency,
    f"""WITH {L}, {BARRIER}, s AS (SELECT b.secid, b.t0, n.pos FROM b JOIN n ON n.secid = b.secid AND n.date BETWEEN b.t0 AND b.t1), k AS (SELECT secid, pos, count(*) AS c FROM s GROUP BY 1, 2),
r AS (SELECT s.secid, s.t0, avg(1.0 / c) AS raw FROM s JOIN k USING (secid, pos) GROUP BY 1, 2)
SELECT secid, t0, raw / avg(raw) OVER (PARTITION BY secid) AS weight FROM r""",
    "weight",
)
register(
    "w25_folds",
    lambda s, d: validation.folds(long_candles(s, d).select("secid", "date"), 5, "date", "secid").withColumn("fold", F.col("fold").cast("long")),
    f"WITH {L} SELECT secid, date, ntile(5) OVER (PARTITION BY secid ORDER BY date) - 1 AS fold FROM l",
)
register(
    "j16_purged_folds",
    lambda s, d: validation.purged_folds(cut(_barriers(s, d))),
    f"""WITH {L}, {BARRIER}, i AS (SELECT secid, t0, t1, row_number() OVER o - 1 AS pos, ntile(5) OVER o - 1 AS fold, count(*) OVER (PARTITION BY secid) AS n FROM b WINDOW o AS (PARTITION BY secid ORDER BY t0)),
g AS (SELECT secid, fold, n, min(t0) AS lo, max(t1) AS hi FROM i GROUP BY 1, 2, 3),
k AS (SELECT g.*, (SELECT count(*) FROM i WHERE i.secid = g.secid AND i.t0 <= g.hi) + CAST(floor(g.n * 0.01) AS BIGINT) AS r FROM g)
SELECT i.secid, CAST(k.fold AS INTEGER) AS fold, i.t0, CASE WHEN i.fold = k.fold THEN 'test' ELSE 'train' END AS role
FROM i JOIN k ON i.secid = k.secid WHERE i.fold = k.fold OR i.t1 < k.lo OR i.pos >= k.r""",
)
register(
    "u1_union", lambda s, d: long_candles(s, d).select("date").union(candles(s, d).select("date")).distinct(), f"WITH {L}, {C} SELECT date FROM l UNION SELECT date FROM c"
)
register(
    "u2_intersect", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))),
    "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
)
register(
    "u3_difference", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(s, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()),
    "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem",
)
register(
    "j15_anti_year",
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("year(o_orderdate) = 1995"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)",
)
register(
    "u3_difference_year",
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(s, d, "orders").where("year(o_orderdate) = 1996").select(F.col("o_custkey").alias("k")).distinct()),
    "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996",
)
register(
    "u4_union_all", lambda s, d: table(s, d, "customer").select(F.col("c_acctbal").alias("v")).unionByName(table(s, d, "supplier").select(F.col("s_acctbal").alias("v"))),
    "SELECT c_acctbal AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier", "v",
)
register(
    "u5_keep_last",
    lambda s, d: remote.latest_by(table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice"), ["date"], [F.desc("o_orderkey")]),
    "SELECT CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "o_totalprice",
)
register(
    "e15_windows",
    lambda s, d: year_windows(s, 1995, 2001),
    """SELECT CAST(y - 1995 AS INTEGER) AS "window", make_date(y, 1, 1) AS train_from, make_date(y + 3, 12, 31) AS train_to, make_date(y + 4, 1, 1) AS test_from, make_date(y + 4, 12, 31) AS test_to
FROM range(1995, 1998) AS t(y)""",
)
_RATE_PAGE = """<div>Rates<table class="a"><tr><th>Day</th><th>Rate</th></tr><TR><TD class="d">03.02.2014</TD><TD>5,50</TD>
<tr><td> 14.03.2014 <td><b>7,00</b><tr><td>03.02.2014</td><td>5,50</td></tr><tr><td>n/a</td><td>1,00</td></tr></table></div>"""
register(
    "s16_key_rates",
    lambda s, d: html_tables.key_rates(s.createDataFrame([(_RATE_PAGE,)], "html string")),
    "SELECT * FROM (VALUES (DATE '2014-02-03', 5.5::DOUBLE), (DATE '2014-03-14', 7.0)) AS t(date, rate_pct)",
    "rate_pct",
)


def _rates_twice(s: SparkSession, d: str) -> DataFrame:
    """Key rates through a store; the second time nothing is fetched."""
    store, asked = dataset.Datasets(s, f"{shared_folder(s)}/datasets-{uuid.uuid4().hex}"), []

    def fetch(first: str, last: str) -> DataFrame:
        asked.append((first, last))
        return s.createDataFrame([(_RATE_PAGE,)], "html string")

    html_tables.cached_key_rates(store, "2014-01-01", "2014-12-31", fetch)
    out = html_tables.cached_key_rates(store, "2014-01-01", "2014-12-31", fetch)
    return out.withColumn("fetched", F.lit(len(asked)))


register("s20_cached_rates", _rates_twice, "SELECT *, 1 AS fetched FROM (VALUES (DATE '2014-02-03', 5.5::DOUBLE), (DATE '2014-03-14', 7.0)) AS t(date, rate_pct)", "rate_pct")
_REGISTER_PAGE = """<p>x</p><table border=1><tr><td>Год<td>Дивиденд, руб.<td>День закрытия реестра</tr><tr><td>2016<td>6&nbsp;<td>14.06.2017</tr>
<tr><td>2015<td>1,97</td><td><i>14.06.2016</i></td></tr><tr><td>2017 (прогноз)<td>12<td>26.06.2018<tr><td>2014<td>0,45<tr><td>2013<td>-<td>17.06.2014</table>"""
_CUTOFF_PAGE = """<table><tr><td>Выплаты</td></tr><tr><th>Дивиденд</th><th>Дата отсечки</th><th>Купить до T-1</th></tr><tr><td>21,3</td><td>16.10.2018</td><td>12.10.2018</td></tr>
<tr><td>4,1</td><td>28.12.2018</td></tr></table>"""
register(
    "s17_dividend_pages",
    lambda s, d: html_tables.dividend_history(
        html_tables.register_dividends(s.createDataFrame([(1, _REGISTER_PAGE), (2, "<p>none</p>"), (3, None)], "page_id int, html string")),
        html_tables.cutoff_dividends(s.createDataFrame([(1, _CUTOFF_PAGE), (2, _CUTOFF_PAGE)], "page_id int, html string")),
        s.createDataFrame([(1, "mtss"), (2, "X5"), (3, "Q")], "page_id int, secid string"),
    ),
    """SELECT * FROM (VALUES ('MTSS', DATE '2017-06-14', 6.0::DOUBLE, CAST(NULL AS DATE), 'register'), ('MTSS', DATE '2016-06-14', 1.97, NULL, 'register'),
  ('FIVE', DATE '2018-10-16', 21.3, DATE '2018-10-12', 'cut-off'), ('FIVE', DATE '2018-12-28', 4.1, NULL, 'cut-off')) AS t(secid, record_date, amount, last_day_with_rights, source)""",
    "amount",
)


def _exchange(s: SparkSession) -> remote.Exchange:
    return remote.Exchange(s, "http://exchange.invalid/iss", transport="tallystone.plans.feed:answer")


for name, kind, series, board in (("s9_daily_candles", "share", "AAA", "TQBR"), ("s10_index_candles", "index", "III", "RTSI"), ("s10_currency_candles", "currency", "CCC", "CETS")):
    register(
        name,
        lambda s, d, kind=kind, series=series, board=board: _exchange(s).candles(kind, series, "2019-12-15", "2020-04-20", board),
        f"""WITH k AS (SELECT CAST(unnest(generate_series(DATE '2019-12-15', DATE '2020-04-20', INTERVAL 1 DAY)) AS DATE) AS date),
n AS (SELECT date, CAST((date_diff('day', DATE '0001-01-01', date) + 1) % 1000 + {len(board)} AS DOUBLE) AS p FROM k)
SELECT '{series}' AS secid, date, p AS open, p + 2 AS high, p - 1 AS low, p + 1 AS close, 10 * p AS value, 10.0::DOUBLE AS volume FROM n""",
        "open high low close value volume",
    )
register(
    "s12_trade_history",
    lambda s, d: _exchange(s).trades("AAA", "2020-01-01", "2020-03-31", "begin string, volume double").select(F.to_date("begin").alias("date"), "volume"),
    "SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2020-03-31', INTERVAL 1 DAY)) AS DATE) AS date, 10.0::DOUBLE AS volume",
    "volume",
)
register("s13_composition", lambda s, d: _exchange(s).composition("III", "2020-03-07"), "SELECT DATE '2020-03-07' AS snapshot_date, 'M' || (7 + i) AS secid FROM range(50) AS t(i)")


def _saved(s: SparkSession, d: str) -> DataFrame:
    """Candles that went through a dataset in the session's shared folder, saved twice."""
    store = dataset.Datasets(s, f"{shared_folder(s)}/datasets-{uuid.uuid4().hex}")
    store.save("bars/daily", candles(s, d).where("false"))
    store.save("bars/daily", candles(s, d))
    assert store.keys() == ["bars/daily"] and store.has("bars/daily")
    return store.cached("bars/daily", lambda: None)


register("s4_file_digests", lambda s, d: dataset.file_digests(s, d).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size", "digest"))
register("s1_dataset", _saved, f"WITH {C} SELECT * FROM c", "open high low close value volume", 7)


def _text_of(s: SparkSession, d: str) -> DataFrame:
    """A report's lines through a text sink, read back."""
    where = f"{shared_folder(s)}/lines-{uuid.uuid4().hex}"
    ledger.write_lines(table(s, d, "nation"), where, ["n_nationkey", "n_name"])
    return s.read.text(where).withColumnRenamed("value", "line")


register("s23_lines", _text_of, "SELECT n_nationkey || '  ' || n_name AS line FROM nation")


def _events_of(s: SparkSession, d: str) -> DataFrame:
    """Events through a JSON sink in two batches, read back."""
    where = f"{shared_folder(s)}/events-{uuid.uuid4().hex}"
    rows = table(s, d, "region").select("r_regionkey", "r_name")
    ledger.write_events(rows.where("r_regionkey < 2"), where)
    ledger.write_events(rows.where("r_regionkey >= 2"), where)
    return s.read.schema("r_regionkey int, r_name string").json(where)


register("s23_events", _events_of, "SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name FROM region")


def _csv_of(s: SparkSession, d: str) -> DataFrame:
    where = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    ledger.write_csv(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), where)
    return s.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(where)


register("s24_csv", _csv_of, "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")


def _registered(s: SparkSession, d: str) -> DataFrame:
    """Predictions of a linear model that went through the registry."""
    store = registry.Models(s, f"{shared_folder(s)}/models-{uuid.uuid4().hex}")
    model = LinearModel(["close", "volume"], np.array([1300.0, 20.0]), np.array([250.0, 9.0]), np.array([0.8, -0.3]), 0.1, 1.2, -0.05)
    store.register(registry.Card("m", model.names, "1998-12-31", "h", {"auc": 0.6}), model)
    return long_candles(s, d).select("secid", "date", store.load("m")[0].column().alias("proba"))


register(
    "m10_registered_model",
    _registered,
    f"""WITH {L}, p AS (SELECT secid, date, least(greatest(1 / (1 + exp(-(0.1 + (close - 1300.0) / 250.0 * 0.8 - (volume - 20.0) / 9.0 * 0.3))), 1e-9), 1 - 1e-9) AS p FROM l)
SELECT secid, date, 1 / (1 + exp(-(1.2 * ln(p / (1 - p)) - 0.05))) AS proba FROM p""",
    "proba",
)
register(
    "j1_registered_feature",
    lambda s, d: _features().as_of("price", _requests(s, d), ["secid"], _feature(s, d)),
    f"WITH {FEATURE}, {REQUESTS} SELECT q.secid, q.ts, f.event_ts, f.value FROM q ASOF LEFT JOIN f ON q.secid = f.secid AND q.ts >= f.event_ts + 10",
    "value",
)


def _features() -> registry.Features:
    known = registry.Features()
    known.add(registry.Feature("price", lambda rows: rows, dt.timedelta(days=10), "orders", "greatest order of the day"))
    return known


def _ledger(s: SparkSession, d: str) -> DataFrame:
    book = ledger.Ledger(s, f"{shared_folder(s)}/ledger-{uuid.uuid4().hex}")
    runs = [{"hypothesis": f"momentum over {n}", "source": "grid", "params": {"lookback": n}, "data_hash": "d", "metrics": {"annual_return": n / 1000}} for n in range(5, 125, 5)]
    book.record(runs)
    book.record(runs[:4])
    return ledger.summary(book.runs())


register("s22_ledger", _ledger, "SELECT count(*) AS n_runs, max(n / 1000) AS best, median(n / 1000) AS median, count(*) > 10 AS too_many FROM range(5, 125, 5) AS t(n)", "best median")
register(
    "s15_array_candles",
    lambda s, d: remote.array_candles(s.createDataFrame([("BTC", "[[1704067200000,10,12,13,9,2],[1704153600000,12,11,12,10,3],[1704067200000,1,1,1,1,1]]")], "secid string, body string")),
    """SELECT * FROM (VALUES ('BTC', DATE '2024-01-01', 10.0::DOUBLE, 13.0::DOUBLE, 9.0::DOUBLE, 12.0::DOUBLE, 24.0::DOUBLE, 2.0::DOUBLE),
  ('BTC', DATE '2024-01-02', 12.0, 12.0, 10.0, 11.0, 33.0, 3.0)) AS t(secid, date, open, high, low, close, value, volume)""",
    "open high low close value volume",
)
