"""As-of joins, labels, metrics, monitors, models, sources and streams: known answers and properties."""

import datetime as dt
import json
import urllib.error

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.functions import finance
from tallystone.models import logistic, registry
from tallystone.operators import allocation, asof, bars, labeling, metrics, monitoring, quality, series, validation
from tallystone.sources import dataset, html_tables, ledger, remote, settings
from tallystone.streaming import bars as streams
from tests import plain_fits

D = dt.date


def closes(spark, prices, secid="A", start=D(2024, 1, 1)):
    return spark.createDataFrame([(secid, start + dt.timedelta(i), float(p)) for i, p in enumerate(prices)], "secid string, date date, close double")


def test_a_feature_waits_for_its_lag(spark):
    feature = spark.createDataFrame([("A", D(2024, 3, 31), 100.0)], "secid string, event_ts date, value double")
    asked = spark.createDataFrame([("A", D(2024, 5, 14)), ("A", D(2024, 5, 15)), ("B", D(2024, 6, 1))], "secid string, ts date")
    got = {(r.secid, r.ts): r.value for r in asof.feature_asof(asked, feature, 45, ["secid"]).collect()}
    assert got == {("A", D(2024, 5, 14)): None, ("A", D(2024, 5, 15)): 100.0, ("B", D(2024, 6, 1)): None}
    with pytest.raises(asof.LookAheadError):
        asof.forbid_event_time_join(asked, feature)


def test_a_null_value_is_still_the_last_one(spark):
    right = spark.createDataFrame([(1, 1, 5.0), (1, 3, None)], "k int, t int, v double")
    left = spark.createDataFrame([(1, 2), (1, 3), (1, 0)], "k int, ts int")
    assert {r.ts: r.v for r in asof.asof_backward(left, right, ["k"], "ts", "t", ["v"]).collect()} == {0: None, 2: 5.0, 3: None}
    assert {r.ts: r.t for r in asof.asof_forward(left, right, ["k"], "ts", "t", ["t"]).collect()} == {0: 1, 2: 3, 3: 3}


def test_rate_lookups(spark):
    rates = spark.createDataFrame([(D(2024, 7, 28), 0.16), (D(2024, 7, 29), 0.18)], "date date, rate double")
    days = spark.createDataFrame([(D(2024, 7, 1),), (D(2024, 7, 28),), (D(2024, 9, 1),)], "date date")
    for policy, before in (("null", None), ("first", 0.16), ("zero", 0.0)):
        assert [r.rate for r in asof.step_lookup(days, "date", rates, "date", "rate", policy).orderBy("date").collect()] == [before, 0.16, 0.18]


def test_ex_dates(spark):
    cal = [d for d in (D(2021, 4, 1) + dt.timedelta(i) for i in range(1700)) if d.weekday() < 5]
    calendar = spark.createDataFrame([(d,) for d in cal], "date date")
    rows = [("A", D(2025, 7, 18), 1.0, None), ("B", D(2023, 5, 11), 1.0, None), ("C", D(2021, 5, 7), 1.0, D(2021, 5, 5)), ("D", D(2019, 1, 1), 1.0, None)]
    got = {r.secid: r.ex_date for r in asof.ex_dates(spark.createDataFrame(rows, "secid string, record_date date, amount double, last_day_with_rights date"), calendar).collect()}
    assert got == {"A": D(2025, 7, 18), "B": D(2023, 5, 10), "C": D(2021, 5, 6)}


@pytest.mark.parametrize(("prices", "side", "label", "bar"), [([100, 102, 106, 110, 108], 1.0, 1, 2), ([100, 97, 94, 96], -1.0, 1, 2), ([100, 98, 94, 110], 1.0, -1, 2), ([100, 101, 102], 1.0, 0, 2)])
def test_triple_barriers(spark, prices, side, label, bar):
    events = spark.createDataFrame([("A", D(2024, 1, 1), 0.05, side)], "secid string, t0 date, target double, side double")
    r = labeling.triple_barrier(events, closes(spark, prices), 10).first()
    assert (r.label, r.t1) == (label, D(2024, 1, 1) + dt.timedelta(bar))


def test_lone_labels_weigh_more(spark):
    labels = spark.createDataFrame([("A", D(2024, 1, 1), D(2024, 1, 4)), ("A", D(2024, 1, 2), D(2024, 1, 5)), ("A", D(2024, 1, 10), D(2024, 1, 12))], "secid string, t0 date, t1 date")
    w = {r.t0: r.weight for r in labeling.concurrency_weights(labels, closes(spark, range(100, 120))).collect()}
    assert w[D(2024, 1, 10)] > w[D(2024, 1, 1)] and sum(w.values()) / 3 == pytest.approx(1)


def test_purged_folds_keep_train_and_test_apart(spark):
    start = D(2024, 1, 1)
    rows = [("A", start + dt.timedelta(i), start + dt.timedelta(min(i + 5, 99))) for i in range(100)]
    got = validation.purged_folds(spark.createDataFrame(rows, "secid string, t0 date, t1 date"), 5).collect()
    tests = [r.t0 for r in got if r.role == "test"]
    assert len(tests) == 100 == len({*tests})
    end = {r[1]: r[2] for r in rows}
    for k in range(5):
        test = [r.t0 for r in got if r.fold == k and r.role == "test"]
        lo, hi = min(test), max(end[t] for t in test)
        assert all(end[r.t0] < lo or r.t0 > hi for r in got if r.fold == k and r.role == "train")
    with pytest.raises(validation.ForbiddenPracticeError):
        validation.forbid_shuffle(True)


def test_overfitting_probability(spark):
    x = np.random.default_rng(42).standard_normal((256, 10))
    frame = lambda m: spark.createDataFrame(pd.DataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], columns=["t", "config", "value"]))
    r = validation.cscv(frame(x), 8).first()
    assert 0.3 < r.pbo < 0.7 and r.n_combinations == 70
    x[:, 0] += 1
    assert validation.cscv(frame(x), 8).first().pbo < 0.1


def test_drawdowns(spark):
    eq = lambda v: closes(spark, v).select(F.col("secid").alias("run_id"), "date", F.col("close").alias("equity"))
    r = metrics.drawdowns(eq([100, 110, 99, 105, 110, 120])).first()
    assert (r.max_drawdown, r.max_drawdown_days) == (pytest.approx(99 / 110 - 1), 3)
    r = metrics.drawdowns(eq([100, 120, 90, 91])).first()
    assert (r.max_drawdown, r.max_drawdown_days) == (pytest.approx(90 / 120 - 1), 2)
    assert spark.range(1).select(metrics.annualised(F.lit(1.21), F.lit(730.5))).first()[0] == pytest.approx(0.1)


def test_sharpe_statistics(spark):
    numbers = [F.lit(float(x)) for x in (100, 0.0, 0.0, 3.0)]
    r = spark.range(1).select(metrics.probabilistic_sharpe(*numbers), metrics.expected_best_sharpe(F.lit(1.0), F.lit(1)), metrics.expected_best_sharpe(F.lit(1.0), F.lit(10))).first()
    assert r[0] == pytest.approx(0.5) and r[1] == 0.0 and 1.4 < r[2] < 1.7


def test_the_normal_distribution(spark):
    from statistics import NormalDist

    from tallystone.functions.normal import normal_cdf, normal_quantile

    points = [-7.0, -5.5, -3.0, -1.0, 0.0, 0.3, 2.0, 5.9, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in points], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in points], abs=2e-9)
    shares = [0.001, 0.3, 0.5, 0.975]
    back = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(normal_quantile(F.col("x"))).collect()]
    assert back == pytest.approx([NormalDist().inv_cdf(x) for x in shares], abs=1e-9)
    assert spark.range(1).select(normal_cdf(F.lit(None).cast("double"))).first()[0] is None


def test_quantiles_and_running_totals_by_brute_force(spark):
    rng = np.random.default_rng(2)
    values = np.r_[rng.standard_normal(500), np.repeat(1.5, 40), 1e6]
    counts = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double").groupBy("feature", "value").agg(F.count("*").alias("e"))
    shares = [0.1, 0.37, 0.5, 0.9]
    r = monitoring.quantiles(counts, shares).first()
    assert list(r.q) == pytest.approx(np.quantile(values, shares).tolist()) and (r.lo, r.hi, r.n) == (values.min(), 1e6, len(values))
    for row in monitoring.running(counts, "feature", "value", ["e"]).collect():
        assert (row.before_e, row.all_e) == ((values < row.value).sum(), len(values))


def test_drift_monitors(spark):
    rng = np.random.default_rng(1)
    for shift, strong in ((0.0, False), (3.0, True)):
        rows = [("x", False, float(v)) for v in rng.standard_normal(2000)] + [("x", True, float(v)) for v in rng.standard_normal(2000) + shift]
        samples = spark.createDataFrame(rows, "feature string, live boolean, value double")
        r = monitoring.psi(samples).first()
        assert r.strong == strong and (r.psi < 0.1) != strong
        ks = monitoring.ks_distance(samples).first()
        assert (ks.p_value < 0.01) == strong
    assert monitoring.cusum(closes(spark, [0] * 20 + [10] * 20), 3.0).first().direction == 1
    with pytest.raises(ValueError):
        monitoring.cusum(closes(spark, [1]), 0.0)


def test_fractional_difference(spark):
    assert series.fraction_weights(1.0) == [1.0, -1.0]
    assert series.fraction_weights(0.0) == [1.0]
    got = series.fractional_difference(closes(spark, [1, 3, 6]), "close", 1.0, "x").orderBy("date").collect()
    assert [r.x for r in got] == [None, 2.0, 3.0]


def test_a_walk_needs_differencing_and_noise_does_not(spark):
    rng = np.random.default_rng(7)
    noise = rng.standard_normal(400)
    both = closes(spark, np.cumsum(noise), "walk").unionByName(closes(spark, noise, "noise"))
    p = {r.secid: r.p_value for r in series.adf_p_values(both, "close").collect()}
    assert p["noise"] < 0.01 < 0.1 < p["walk"]
    d = {r.secid: r.d for r in series.least_stationary_order(both, "close").collect()}
    assert d["noise"] == 0.0 and d["walk"] > 0


def test_forward_labels_and_weekly_hold(spark):
    y = closes(spark, [100, 99, 94, 100, 100, 100]).select("date", series.forward_drawdown_label("close", 2, 0.05, series.bars()).alias("y")).orderBy("date").collect()
    assert [r.y for r in y] == [1, 1, 0, 0, None, None]
    days = [d for d in (D(2024, 1, 1) + dt.timedelta(i) for i in range(12)) if d.weekday() < 5]
    held = series.hold_weekly(spark.createDataFrame([("A", d, float(i)) for i, d in enumerate(days)], "secid string, date date, x double"), "x", "h").orderBy("date").collect()
    by = {r.date: r.h for r in held}
    assert by[D(2024, 1, 1)] is None and by[D(2024, 1, 8)] == 4.0 and by[D(2024, 1, 12)] == 9.0


def test_no_window_sees_the_future(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(50, 150, 300)
    b = a.copy()
    b[200:] *= 3
    w = series.bars()
    columns = [series.bar_return("close", 20, w).alias("m"), series.distance_to_mean("close", 50, w).alias("d"), series.drawdown_from_high("close", 100, w).alias("h")]
    first, second = ([tuple(r) for r in closes(spark, x).select("date", *columns).orderBy("date").limit(200).collect()] for x in (a, b))
    assert first == second


def test_easing(spark):
    easing = allocation.easing(spark.createDataFrame([(D(2024, 1, i),) for i in (1, 2, 3)], "date date"), spark.createDataFrame([(D(2023, 1, 1), 16.0), (D(2024, 1, 1), 16.0), (D(2024, 1, 2), 15.0)], "date date, rate double"))
    assert [x.easing for x in easing.orderBy("date").collect()] == [False, True, True]


def test_quality_counts_each_defect(spark):
    fine = [("A", D(2024, 1, 1) + dt.timedelta(i), 10.0, 11.0, 9.0, 10.0, 1e6, 100.0) for i in range(10)]
    names = "secid string, date date, open double, high double, low double, close double, value double, volume double"
    calendar = spark.createDataFrame([(r[1],) for r in fine], "date date")
    none = spark.createDataFrame([], "date date, secid string, reason string")

    def report(rows, events=none):
        return quality.validation(spark.createDataFrame(rows, names), calendar, events).first()

    assert report(fine).anomalies == 0
    assert report(fine + fine[:1]).duplicate_dates == 1
    assert report(fine[:4] + fine[5:]).missing_days == 1
    assert report([(*fine[0][:3], 9.5, *fine[0][4:]), *fine[1:]]).high_below_body == 1
    assert report([(*fine[0][:7], -1.0), *fine[1:]]).negative_volume == 1
    jump = [*fine[:5], *[(s, d, 20.0, 21.0, 19.0, 20.0, v, n) for s, d, _, _, _, _, v, n in fine[5:]]]
    assert report(jump).suspicious
    known = spark.createDataFrame([(fine[5][1], None, "split")], "date date, secid string, reason string")
    r = report(jump, known)
    assert not r.suspicious and r.confirmed_jumps == 1


def test_resampled_weeks(spark):
    rows = [("A", d, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1e6, 1000.0) for i, d in enumerate(d for d in (D(2024, 1, 1) + dt.timedelta(k) for k in range(14)) if d.weekday() < 5)]
    week = bars.resample(spark.createDataFrame(rows, "secid string, date date, open double, high double, low double, close double, value double, volume double"), "week").orderBy("date").first()
    assert (week.open, week.close, week.high, week.low, week.volume, week.date) == (100.0, 104.5, 105.0, 99.0, 5000.0, D(2024, 1, 5))


def test_sizing_and_formats(spark):
    c = finance.Costs()
    one = spark.range(1)
    lots = lambda target: one.select(finance.position_lots(F.lit(312.4), F.lit(10), F.lit(target), F.lit(20_000.0), F.lit(1e7), c)).first()[0]
    assert (lots(5000.0), lots(10_000.0), lots(100.0)) == (1, 3, 0)
    rng, rows = np.random.default_rng(9), []
    for _ in range(400):
        price, lot, cash = float(rng.uniform(0.01, 900)), int(rng.integers(1, 50)), float(rng.uniform(1, 30_000))
        rows.append((price, lot, float(rng.uniform(0, 1.5) * cash), cash, float(10 ** rng.uniform(3, 8))))
    frame = spark.createDataFrame(rows, "price double, lot int, target double, cash double, adv double")
    for own in (c, finance.Costs(stress=3.0), finance.Costs(impact=0.0)):
        got = [r[0] for r in frame.coalesce(1).select(finance.position_lots(*map(F.col, frame.columns), own)).collect()]

        def least(price, lot, target, cash, adv):
            best, k = 0, 1
            while (v := k * price * lot) <= target and v / adv <= own.reject_share:
                broker = max(v * own.broker_pct / 100, own.broker_min)
                costs = own.stress * (broker + v * (own.exchange_pct + own.half_spread_pct + own.base_slippage_pct + own.impact * v / adv) / 100)
                best, k = (k if v + costs <= cash else best), k + 1
            return best

        assert got == [least(*r) for r in rows]
    r = one.select(finance.spaced_number(F.lit(1234.5)), finance.percent(F.lit(0.1234)), finance.percent(F.lit(float("nan"))), finance.amount(F.lit("1 234,50 ₽")), finance.amount(F.lit("-3"))).first()
    assert tuple(r) == ("1 234.50", "12.3%", "n/a", 1234.5, None)


def test_linear_models():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(600) > 0.5).astype(int)
    model = plain_fits.fit_calibrated(["a", "b", "c"], x, y)
    p = model.proba(x)
    assert (((p > 0.5) == y).mean()) > 0.9 and abs(p.mean() - y.mean()) < 0.1
    assert max(model.importance(), key=lambda k: abs(model.importance()[k])) == "a"
    flipped = np.r_[y[:480], 1 - y[480:]]  # calibration must not turn the ranking round
    turned = plain_fits.fit_calibrated(["a", "b", "c"], x, flipped)
    assert turned.a == 1.0 and np.corrcoef(turned.proba(x), turned.raw(x))[0, 1] > 0


def test_models_are_kept_as_they_were(spark, tmp_path):
    model = plain_fits.fit(["a"], np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0, 0, 1, 1]))
    store = registry.Models(spark, f"{tmp_path}/models")
    card = registry.Card("m", ["a"], "2024-01-01", "h", {"auc": 0.6}, 0.55)
    store.register(card, model)
    back, same = store.load("m")
    assert same == card and back.proba(np.array([[2.5]])) == model.proba(np.array([[2.5]])) and card.retired(0.5)
    with pytest.raises(registry.RegistryError):
        store.register(card, model)
    row = store._rows()[0]
    spark.createDataFrame([("x", row.blob + " ", row.sha256, row.card)], store.SCHEMA).write.mode("append").parquet(store.path)
    with pytest.raises(registry.RegistryError):
        store.load("x")
    with pytest.raises(registry.RegistryError):
        registry.Feature("f", lambda: None, 3, "s", "d")
    features = registry.Features()
    features.add(registry.Feature("f", lambda d: d, dt.timedelta(days=1), "s", "d", True))
    assert features.by_language_model() == ["f"]


def test_datasets(spark, tmp_path):
    store = dataset.Datasets(spark, f"file://{tmp_path}/data")
    assert store.keys() == [] and not store.has("a/b")
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(3)

    assert store.cached("a/b", fetch).count() == 3 and store.cached("a/b", fetch).count() == 3 and len(calls) == 1
    first = store.version()
    store.save("a/b", spark.range(4))
    assert store.keys() == ["a/b"] and store.version() != first and len(first) == 16
    with pytest.raises(ValueError):
        store.path("../x")
    pair = lambda *rows: dataset.logical_version(spark.createDataFrame(list(rows), "a string, b string")).first()
    assert pair((None, "x")) != pair(("x", None)) and pair(("x", None), ("y", "z")) == pair(("y", "z"), ("x", None)) and pair((None, "")) != pair(("", None))
    fs, target = store._fs(store.path("a/b"))
    fs.rename(target, store._fs(store._aside("a/b"))[1])  # as a save that broke off between its renames leaves it
    assert not store.has("a/b")
    store.restore("a/b")
    assert store.has("a/b") and store.load("a/b").count() == 4
    assert dataset.logical_version(spark.range(5)).first() == dataset.logical_version(spark.range(5).orderBy(F.desc("id"))).first()


def fake_exchange(url, params):
    start = int(params["start"])
    rows = [[f"S{i}", i] for i in range(start, min(start + 3, 7))]
    body = {"t": {"columns": ["SECID", "LOTSIZE"], "data": rows}}
    if url.endswith("cursor"):
        body["t.cursor"] = {"columns": ["INDEX", "TOTAL", "PAGESIZE"], "data": [[start, 7, 3]]}
    return json.dumps(body)


@pytest.mark.parametrize("url", ["x/plain", "x/cursor"])
def test_paged_tables(spark, url):
    spark.dataSource.register(remote.PagedTable)
    df = spark.read.format("paged_table").schema("SECID string, LOTSIZE int").options(url=url, table="t", transport="tests.test_operators:fake_exchange").load()
    assert sorted(r.SECID for r in df.collect()) == [f"S{i}" for i in range(7)]
    assert remote.lot_sizes(df).count() == 7
    with pytest.raises(remote.RemoteError):
        remote.lot_sizes(df.drop("LOTSIZE"))


def test_retries():
    waits, answers = [], [urllib.error.HTTPError("u", 503, "", None, None), OSError(), "ok"]

    def transport(url, params):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert remote.Patient(transport, sleep=waits.append)("u", {}) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(remote.RemoteError):
        remote.Patient(lambda u, p: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", None, None)), sleep=waits.append)("u", {})


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, f"{tmp_path}/ledger")
    runs = [{"hypothesis": f"h{i}", "source": "grid", "params": {"n": i}, "data_hash": "d", "metrics": {"annual_return": i / 100}} for i in range(15)]
    hashes = book.record(runs)
    book.record(runs[:1])
    assert book.runs().count() == 15 and book.all_rows().count() == 16 and book.get(hashes[3]).count() == 1
    s = ledger.summary(book.runs()).first()
    assert (s.best, s.median, s.too_many) == (0.14, 0.07, True)
    with pytest.raises(ValueError):
        book.record([{**runs[0], "hypothesis": " "}])


def test_settings():
    s = settings.load_settings("capital: 5000\ncosts:\n  stress: 2\nbounds: {positions: 3}")
    assert s.capital == 5000.0 and s.costs.stress == 2.0 and s.bounds.positions == 3
    for bad in ("capitl: 1", "costs: {stres: 1}", "capital: x", "capital: 1\ncapital: 2", "short_sales: 1"):
        with pytest.raises(settings.SettingsError):
            settings.load_settings(bad)
    assert settings.load_universe("tickers: [sber, GAZP]") == ["SBER", "GAZP"]
    with pytest.raises(settings.SettingsError):
        settings.load_universe("tickers: [a, A]")
    with pytest.raises(settings.SettingsError):
        settings.iso_date("01.02.2024")


def test_key_rates_keep_one_of_equal_dates(spark):
    page = "<td>26.07.2024</td> <td>16,00</td><td>29.07.2024</td><td>18,00</td><td>29.07.2024</td><td>18,00</td><td>30.07.2024</td><td>-</td>"
    got = html_tables.key_rates(spark.createDataFrame([(page,)], "html string")).orderBy("date").collect()
    assert [(r.date, r.rate_pct) for r in got] == [(D(2024, 7, 26), 16.0), (D(2024, 7, 29), 18.0)]


def test_streams_give_the_batch_results(spark, tmp_path):
    prices = [0.0] * 10 + [10.0] * 10
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), p) for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "secid string, ts timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("secid string, ts timestamp, price double").parquet(f"{tmp_path}/in")
    for name, df, mode in (("cusum", streams.cusum_stream(source, 3.0), "append"), ("bars", streams.windowed_bars(source), "complete"), ("spells", streams.sessions(source, "90 minutes"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert [r.direction for r in spark.table("cusum").collect()] == [1]
    bar = spark.table("bars").first()
    assert (bar.open, bar.close, bar.volume) == (0.0, 10.0, 20)
    assert spark.table("spells").first().n == 20


def test_nan_never_becomes_a_verdict(spark):
    r = spark.range(1).select(finance.verdict(F.lit(float("nan")), F.lit(0.1), F.lit(0.2)), finance.verdict(F.lit(0.35), F.lit(0.1), F.lit(0.2))).first()
    assert tuple(r) == ("no data", "passes")


def test_strategies_by_name(spark):
    from tallystone.operators import signals, strategies

    rows = [(k, D(2024, 1, 1) + dt.timedelta(i), 100.0 + i * step) for k, step in (("A", 1), ("B", 2), ("C", -1)) for i in range(10)]
    candles = spark.createDataFrame(rows, "secid string, date date, close double")
    both = strategies.weights_of(candles, {"up": strategies.strategy("momentum", lookback=5, top_n=1), "one": strategies.strategy("buy_and_hold", secid="C", weight=0.5)})
    assert {(r.config, r.secid, r.weight) for r in both.collect()} == {("up", "B", 1.0), ("one", "C", 0.5)}
    assert {*signals.RULES} < {*strategies.BUILDERS}
    for bad in (lambda: strategies.strategy("luck"), lambda: strategies.strategy("momentum", days=3), lambda: strategies.weights_of(candles, {})):
        with pytest.raises(strategies.NoSuchStrategy):
            bad()
