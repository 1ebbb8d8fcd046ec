"""Fits by aggregates against plain loops, and what is built on them."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.models import fits, logistic
from tests import plain_fits

SCHEMA = "key string, rank long, a double, b double, c double, y int, w double"


def panel(seed=3, keys="pqr", n=400):
    rng, rows = np.random.default_rng(seed), {}
    for i, k in enumerate(keys):
        size = n - 37 * i
        x = rng.standard_normal((size, 3)) * [1, 20, 0.01] + [0, 5, 1]
        y = (x[:, 0] + (x[:, 1] - 5) / 30 * (-1) ** i + rng.standard_normal(size) > 0.4).astype(int)
        rows[k] = x, y, rng.uniform(0.1, 3, size)
    return rows


def frame(spark, rows):
    flat = [(k, j, *map(float, x[j]), int(y[j]), float(w[j])) for k, (x, y, w) in rows.items() for j in range(len(y))]
    return spark.createDataFrame(flat, SCHEMA).repartition(5)


def test_weighted_fits_of_all_models_equal_plain_loops(spark):
    rows = panel()
    rows["one class"] = rows["p"][0][:50], np.ones(50, int), np.ones(50)
    rows["level feature"] = np.column_stack([rows["p"][0][:80, :2], np.full(80, 2.0)]), rows["p"][1][:80], np.ones(80)
    for weight in (None, "w"):
        found = fits.fit(frame(spark, rows), ["key"], ["a", "b", "c"], weight=weight)
        assert [k for (k,) in found.names] == ["level feature", "p", "q", "r"]
        for i, (k,) in enumerate(found.names):
            x, y, w = rows[k]
            plain = plain_fits.fit(["a", "b", "c"], x, y, w if weight else None)
            assert found.coef[i] == pytest.approx(plain.coef, abs=1e-8) and found.constant[i] == pytest.approx(plain.constant, abs=1e-8)
            assert found.mean[i] == pytest.approx(plain.mean) and found.scale[i] == pytest.approx(plain.scale)


def test_calibrated_fits_equal_plain_loops(spark):
    rows = panel(5)
    x, y, w = rows["q"]
    late = int(0.8 * len(y))
    rows["turned"] = x, np.r_[y[:late], 1 - y[late:]], w
    rows["few late"] = x, np.r_[y[:late], np.ones(len(y) - late, int)], w
    found = fits.fit_calibrated(frame(spark, rows), ["key"], ["a", "b", "c"], "rank", weight="w")
    assert len(found.names) == 5
    for i, (k,) in enumerate(found.names):
        plain = plain_fits.fit_calibrated(["a", "b", "c"], *rows[k])
        for mine, theirs in ((found.coef[i], plain.coef), (found.constant[i], plain.constant), (found.a[i], plain.a), (found.b[i], plain.b)):
            assert mine == pytest.approx(theirs, abs=1e-6)
        assert (found.n[i], found.ones[i]) == (len(rows[k][1]), rows[k][1].sum())
    assert found.a[found.names.index(("turned",))] == 1.0 and found.a[found.names.index(("few late",))] == 1.0
    assert fits.fit_calibrated(frame(spark, rows), ["key"], ["a"], "rank", least_rows=10_000).names == []


def test_newton_halves_a_step_that_raises_the_loss(spark):
    """Labels that a feature parts: without a penalty of weight the first steps overshoot."""
    rows = [("k", i, float(v), 0.0, 0.0, int(v > 0), 1.0) for i, v in enumerate([-9, -8, -7, 8, 9, 10, 400])]
    df = spark.createDataFrame(rows, SCHEMA)
    for penalty in (1e-4, 1e-2, 1.0):
        found = fits.newton(df, ["key"], [F.col("a")], F.col("y"), F.lit(1.0), [("k",)], penalty)[0]
        plain = plain_fits.newton(np.array([[r[2]] for r in rows]), np.array([r[5] for r in rows]), np.ones(7), penalty)
        assert found == pytest.approx(plain, abs=1e-6)


def test_fits_keep_no_group_in_python(spark):
    plan = logistic.walk_forward_risk(frame(spark, panel()).select(F.col("key").alias("run_id"), F.date_add(F.lit("2015-01-01"), F.col("rank").cast("int") * 5).alias("date"), "a", "b", "y"), ["a", "b"], 2017, 2, 100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() and "InPandas" not in text and "InArrow" not in text


def test_ranks_in_time(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), float(x)) for t, x in zip(rng.integers(0, 9, 60), rng.permutation(60), strict=True)]
    found = {(r.t, r.x): r["rank"] for r in fits.ranked_in_time(spark.createDataFrame(rows, "t int, x double"), "t", ["x"]).collect()}
    assert [found[r] for r in sorted(rows)] == list(range(60))


def test_importance_by_plain_loops(spark):
    rng = np.random.default_rng(9)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(120)]
    data, folds = [], []
    for key in "uv":
        for i, d in enumerate(days):
            x = rng.standard_normal(2)
            data.append((key, d, *map(float, x), int(x[0] + 0.3 * rng.standard_normal() > 0)))
            folds += [(key, f, d, "test" if i // 40 == f else "train") for f in range(3) if abs(i - 40 * f - 20) != 22]
    found = logistic.permutation_importance(spark.createDataFrame(data, "key string, t0 date, a double, b double, y int"), ["a", "b"], spark.createDataFrame(folds, "key string, fold int, t0 date, role string"))
    drops = {"a": [], "b": []}
    for fold in range(3):
        role = {(k, d): r for k, f, d, r in folds if f == fold}
        train, test = ([r for r in data if role.get(r[:2]) == kind] for kind in ("train", "test"))
        model = plain_fits.fit(["a", "b"], np.array([r[2:4] for r in train]), np.array([r[4] for r in train]))
        x, y = np.array([r[2:4] for r in test]), np.array([r[4] for r in test])
        base = ((model.raw(x) >= 0.5) == y).mean()
        for i, name in enumerate("ab"):
            order = {side: sorted(range(len(test)), key=lambda j: hashlib.md5(f"42:{fold}:{name}:{side}:{test[j][0]}:{test[j][1]}".encode()).hexdigest()) for side in ("to", "from")}
            moved = x.copy()
            moved[order["to"], i] = x[order["from"], i]
            drops[name].append(base - ((model.raw(moved) >= 0.5) == y).mean())
    for r in found.collect():
        assert (r.mean_drop, r.std_drop) == (pytest.approx(np.mean(drops[r.feature])), pytest.approx(np.std(drops[r.feature])))
    assert {r.feature for r in found.collect()} == {"a", "b"}


def test_normal_bayes_equals_plain_moments(spark, tmp_path):
    from tallystone.models import bayes, registry

    x, y, _ = panel(8)["p"]
    df = frame(spark, {"p": (x, y, np.ones(len(y)))})
    model = bayes.fit_bayes(df, ["a", "b", "c"])
    odds = np.log(y.sum() / (len(y) - y.sum()))
    for i in range(3):
        for k, sign in ((0, -1), (1, 1)):
            own = x[y == k, i]
            odds = odds + sign * (-0.5 * np.log(own.var()) - (x[:, i] - own.mean()) ** 2 / (2 * own.var()))
    store = registry.Models(spark, f"file://{tmp_path}/models")
    store.register(registry.Card("m", model.names, "x", "h", {}), model)
    loaded, _ = store.load("m")
    got = [r.proba for r in registry.scored(df, loaded).orderBy("rank").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-odds))).tolist(), rel=1e-9)
    assert sum(loaded.contributions(x[0]).values()) + loaded.prior == pytest.approx(odds[0]) and loaded.importance()["a"] > 0.5
    assert bayes.fit_bayes(df.where("y = 1"), ["a"]) is None
    with pytest.raises(registry.RegistryError):
        registry.scored(df.drop("a"), loaded)
    with pytest.raises(registry.RegistryError):
        store.register(registry.Card("other", [], "x", "h", {}), object())
