"""Walk-forward choice on set operations, training sets and fitted models against brute force."""

import datetime as dt

import numpy as np
import pytest

from tallystone.engine import walkforward
from tallystone.models import logistic
from tallystone.operators import signals
from tests import plain_fits

D = dt.date


def test_grids_are_small():
    assert walkforward.grid({}) == [{}]
    assert len(walkforward.grid({"b": [1, 2], "a": [3]})) == 2
    with pytest.raises(walkforward.TooManyParameters):
        walkforward.grid({k: [1] for k in "abcd"})


def test_the_best_in_training_is_followed_out_of_sample(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(7 * 365):
        day = D(2015, 1, 1) + dt.timedelta(i)
        for config, drift in (("a", 0.002 if day.year < 2019 else -0.002), ("b", 0.0)):
            rows.append((config, day, float(drift + 0.001 * rng.standard_normal())))
    returns = spark.createDataFrame(rows, "config string, date date, ret double")
    windows = walkforward.year_windows(spark, 2015, 2021)
    results = walkforward.window_results(returns, windows)
    chosen = {r.window: r.config for r in walkforward.choose(results).collect()}
    assert chosen[0] == "a"
    for r in results.collect():
        lo, hi = (2015 + r.window, 2018 + r.window) if r.phase == "train" else (2019 + r.window,) * 2
        own = np.array([x for c, day, x in rows if c == r.config and lo <= day.year <= hi])
        assert (r.n, r.log_growth, r.sharpe) == (len(own), pytest.approx(np.log1p(own).sum()), pytest.approx(own.mean() / own.std(ddof=1)))
    path = walkforward.out_of_sample(returns, windows, walkforward.choose(results)).orderBy("date").collect()
    assert [r.date for r in path] == [D(2019, 1, 1) + dt.timedelta(i) for i in range((D(2021, 12, 29) - D(2019, 1, 1)).days + 1)][: len(path)]
    assert all(r.config == chosen[r.window] and r.date.year == 2019 + r.window for r in path)
    annual = walkforward.config_results(results, windows)
    assert {r.config for r in annual.collect()} == {"a", "b"} and walkforward.best_and_median(annual).first().n == 2


def _market(spark, n=400, names=("A", "B", "C")):
    rng = np.random.default_rng(8)
    rows, day = [], D(2020, 1, 1)
    prices = {k: 100.0 for k in names}
    for _ in range(n):
        while day.weekday() > 4:
            day += dt.timedelta(1)
        for k in names:
            prices[k] *= 1 + 0.02 * rng.standard_normal()
            rows.append((k, day, prices[k]))
        day += dt.timedelta(1)
    return rows, spark.createDataFrame(rows, "secid string, date date, close double")


def test_features_of_a_bet_by_plain_loops(spark):
    rows, candles = _market(spark)
    index = [(d, c) for k, d, c in rows if k == "C"]
    currency = index[::2]  # known every other day
    frame = lambda x: spark.createDataFrame(x, "date date, close double")
    got = {(r.secid, r.date): r for r in signals.bet_features(candles, frame(currency), frame(index)).collect()}

    def momentum(line, n):
        return line[-1] / line[-1 - n] - 1 if len(line) > n else None

    def volatility(line, n):
        return float(np.std(np.diff(line)[-n:] / np.array(line)[-n - 1 : -1], ddof=1)) if len(line) > n else None

    days = sorted({d for _, d, _ in rows})
    for day in (days[10], days[30], days[100], days[127], days[399]):
        own = [c for k, d, c in rows if k == "A" and d <= day]
        cur, ind = [c for d, c in currency if d <= day], [c for d, c in index if d <= day]
        want = [momentum(own, 20), momentum(own, 60), momentum(own, 120), volatility(own, 20), own[-1] / np.mean(own[-50:]) - 1 if len(own) >= 50 else None, momentum(cur, 60), momentum(ind, 20), volatility(ind, 20)]
        mine = [got["A", day][f] for f in signals.BET_FEATURES]
        assert [x is None for x in mine] == [x is None for x in want]
        assert [x for x in mine if x is not None] == pytest.approx([x for x in want if x is not None])
    alone = signals.bet_features(candles).where("secid = 'A'").collect()
    assert all((r.currency_mom60, r.index_mom20, r.index_vol20) == (0.0, 0.0, 0.0) for r in alone)
    assert signals.feature_frame(candles).columns == ["secid", "date", "close", *signals.BET_FEATURES]


def test_a_training_set_doesnt_look_beyond_its_window(spark):
    rows, candles = _market(spark)
    days = sorted({d for _, d, _ in rows})
    end = days[330]
    got = signals.training_set(candles, str(days[0]), str(end), 60, 2, 15, 1.0).collect()
    place = {d: i for i, d in enumerate(days)}
    last = {}
    for d in days:
        if d <= end:
            last[d.year, d.month] = d
    fine = [t for t in last.values() if place[t] + 15 <= 330 and place[t] >= 120]
    assert {r.t0 for r in got} == {*fine} and all(r.t1 <= end and place[r.t1] <= place[r.t0] + 15 for r in got)
    prices = {(k, d): c for k, d, c in rows}
    for t in fine:
        best = sorted("ABC", key=lambda k: -prices[k, t] / prices[k, days[place[t] - 60]])[:2]
        assert {r.secid for r in got if r.t0 == t} == {*best}
    for r in got:
        assert r.y == int(prices[r.secid, r.t1] > prices[r.secid, r.t0])


def test_a_fitted_model_scores_as_the_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2))
    y = (x[:, 0] + rng.standard_normal(200) > 0).astype(int)
    rows = [(D(2020, 1, 1) + dt.timedelta(i), float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))]
    data = spark.createDataFrame(rows, "t0 date, a double, b double, y int")
    model, plain = logistic.fitted(data, ["a", "b"]), plain_fits.fit_calibrated(["a", "b"], x, y)
    scores = [r.p for r in data.select("t0", model.column().alias("p")).orderBy("t0").collect()]
    assert scores == pytest.approx(plain.proba(x).tolist())
    assert logistic.fitted(data.limit(30), ["a", "b"]) is None and logistic.fitted(data.where("y = 1"), ["a", "b"]) is None


def test_risk_forecasts_by_plain_loops(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.standard_normal(n)
    days = [D(2018, 1, 1) + dt.timedelta(i) for i in range(n)]
    y = [int(v) if i < n - 21 else None for i, v in enumerate(x + rng.standard_normal(n) > 0.8)]
    rows = [("r", d, float(a) if i != 500 else None, k) for i, (d, a, k) in enumerate(zip(days, x, y, strict=True))]
    got = {r.date: (r.proba, r.base_rate) for r in logistic.walk_forward_risk(spark.createDataFrame(rows, "run_id string, date date, x double, y int"), ["x"], 2019, 21, 300).collect()}
    want = {}
    for year in (2019, 2020):
        first = next(i for i, d in enumerate(days) if d.year == year)
        train = [(a, k) for _, _, a, k in rows[: first - 21] if a is not None and k is not None]
        if len(train) < 300:
            continue
        xs, ys = np.array([[a] for a, _ in train]), np.array([k for _, k in train])
        model = plain_fits.fit_calibrated(["x"], xs, ys)
        for _, d, a, _ in rows[first:]:
            if d.year == year and a is not None:
                want[d] = (float(model.proba(np.array([[a]]))[0]), ys.mean())
    assert {*got} == {*want} and want
    assert all(got[d] == pytest.approx(want[d]) for d in want)
