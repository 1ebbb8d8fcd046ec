"""Operators whose work must spread over tasks or stay bounded: against brute force, on skewed and long inputs."""

import datetime as dt
import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.operators import asof, blocks, monitoring, series, validation
from tallystone.sources import dataset

D = dt.date


def test_an_outlier_leaves_the_ranges_even(spark):
    """One value of 1e9 and a heavy tie among 200,000 normal ones: no range has more than 2/1024 of the distinct values."""
    rows = spark.range(200_000).select(F.lit("f").alias("feature"), F.when(F.col("id") == 7, 1e9).when(F.col("id") % 3 == 0, 0.5).otherwise(F.randn(3)).alias("value"))
    counts = rows.groupBy("feature", "value").agg(F.count("*").alias("e"))
    placed = monitoring.ranged(counts, "feature", "value", F.count("*").alias("all")).groupBy("_b").agg(F.count("*").alias("n"), F.max("all").alias("all"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    found = placed.orderBy("_b").collect()
    assert len(found) > 900 and max(r.n for r in found) <= 2 / 1024 * found[0]["all"] + 1
    assert all(a.hi < b.lo for a, b in zip(found, found[1:], strict=False))


def test_infinite_and_unknown_values_are_left_out(spark):
    rng = np.random.default_rng(1)
    rows = [("x", live, float(v)) for live in (False, True) for v in rng.standard_normal(500)]
    odd = [("x", True, math.inf), ("x", False, -math.inf), ("x", True, math.nan), ("x", False, None)]
    schema = "feature string, live boolean, value double"
    one, two = (monitoring.psi(spark.createDataFrame(r, schema)).first() for r in (rows, rows + odd))
    assert one.psi == pytest.approx(two.psi) and one.psi < 0.1


def _asof_rows(seed):
    rng = np.random.default_rng(seed)
    day = lambda: D(2020, 1, 1) + dt.timedelta(int(rng.integers(0, 700)))
    left = [("hot" if i % 2 else rng.choice(["a", "b", None]), day() if i % 17 else None, i) for i in range(600)]
    right = [("hot" if i % 2 else rng.choice(["a", "b", None]), day() if i % 19 else None, float(i) if i % 5 else None, i) for i in range(150)]
    return [(None if k is None else str(k), t, i) for k, t, i in left], [(None if k is None else str(k), t, v, i) for k, t, v, i in right]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_joins_over_months_equal_plain_loops(spark, forward):
    left, right = _asof_rows(4)
    find = asof.asof_forward if forward else asof.asof_backward
    got = find(spark.createDataFrame(left, "k string, at date, i int"), spark.createDataFrame(right, "k string, ts date, v double, j int"), ["k"], "at", "ts", ["v", "j"], F.col("j"))
    first = D(1, 1, 1)
    for r in got.collect():
        # times that are null come first
        fits = [(t or first, j, v) for k, t, v, j in right if k == r.k and ((t or first) >= (r["at"] or first) if forward else (t or first) <= (r["at"] or first))]
        want = (min(fits) if forward else max(fits)) if fits else (None, None, None)
        assert (r.v, r.j) == (want[2], want[1])
    assert got.count() == len(left)


def test_a_hot_key_is_spread_over_its_months(spark):
    """A key with all rows of three years: no task of the join has more than a few months of them."""
    left = spark.range(30_000).select(F.lit("hot").alias("k"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 1095).cast("int")).alias("at"), "id")
    right = spark.range(1000).select(F.lit("hot").alias("k"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("ts"), "id")
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = asof.asof_backward(left, right.withColumnRenamed("id", "v"), ["k"], "at", "ts", ["v"])
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("v")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
    assert sum(sizes) == 30_000 and len(sizes) > 8 and max(sizes) < 30_000 / 3


@pytest.mark.parametrize("span", [2, 20, 61])
def test_ewm_equals_the_definition(spark, span):
    rng = np.random.default_rng(span)
    n, frames = 900, []
    for key in ("a", "b"):
        prices = 100 * np.exp(np.cumsum(0.02 * rng.standard_normal(n)))
        prices[[0, 1, 5, 6, 400]] = np.nan
        frames.append(pd.DataFrame({"secid": key, "date": [D(2019, 1, 1) + dt.timedelta(i) for i in range(n)], "close": prices}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame([(r.secid, r.date, None if math.isnan(r.close) else float(r.close)) for r in pdf.itertuples()], "secid string, date date, close double")
    out = series.ewm_volatility(df, span)
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "InPandas" not in plan
    got = {(r.secid, r.date): r.ewm_std for r in out.collect()}
    for key, part in pdf.groupby("secid"):
        want = part["close"].ffill().pct_change(fill_method=None).ewm(span=span).std()
        for day, value in zip(part["date"], want, strict=True):
            mine = got[key, day]
            assert (mine is None) == bool(np.isnan(value)) and (mine is None or mine == pytest.approx(value, rel=1e-9, abs=1e-13))


def test_ewm_is_unknown_ever_after_a_price_of_zero(spark):
    """Three blocks of 34 bars and more, the zero in the first."""
    rows = [(key, D(2024, 1, 1) + dt.timedelta(i), 0.0 if i == 3 and key == "zero" else 2.0 + i % 3) for key in ("zero", "fine") for i in range(150)]
    out = series.ewm_volatility(spark.createDataFrame(rows, "secid string, date date, close double"), 2).orderBy("secid", "date")
    got = {key: [r.ewm_std for r in out.where(f"secid = '{key}'").collect()] for key in ("zero", "fine")}
    assert not any(map(math.isnan, got["fine"][2:])) and got["zero"][:2] == [None, None]
    assert not math.isnan(got["zero"][2]) and not math.isnan(got["zero"][3]) and all(map(math.isnan, got["zero"][4:]))


def test_cusum_is_a_stream_with_a_bounded_state(spark):
    """A million bars of one key, with an event at every fourth, by plain loops."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("secid"), F.col("id").alias("date"), F.when(F.col("id") % 8 < 4, F.col("id") % 8).otherwise(8 - F.col("id") % 8).cast("double").alias("close"))
    found = monitoring.cusum(df, 2.5)
    got = [(r.date, r.direction) for r in found.orderBy("date").limit(2000).collect()]
    want, up, down, last = [], 0.0, 0.0, 0.0
    for i in range(1, 20_000):
        v = float(i % 8 if i % 8 < 4 else 8 - i % 8)
        up, down, last = max(0.0, up + v - last), min(0.0, down + v - last), v
        if up > 2.5:
            up = 0.0
            want.append((i, 1))
        elif down < -2.5:
            down = 0.0
            want.append((i, -1))
    assert got == want[: len(got)] and len(got) == 2000
    assert abs(found.count() - n / 4) < n / 50


def test_splits_are_numbered_without_gaps():
    for parts in (2, 4, 8, 10):
        masks = [validation.half_of(r, parts) for r in range(math.comb(parts, parts // 2) // 2)]
        whole = {sum(1 << p for p in c) for c in combinations(range(parts), parts // 2)}
        assert {*masks} | {(1 << parts) - 1 - m for m in masks} == whole and len({*masks}) == len(masks)


def test_overfitting_of_many_configurations(spark):
    """12,870 splits of 1,000 configurations; a small case against plain loops."""
    rng = np.random.default_rng(0)
    values = rng.standard_normal((48, 7))
    frame = lambda m: spark.createDataFrame(pd.DataFrame({"t": np.repeat(np.arange(m.shape[0]), m.shape[1]), "config": np.tile(np.arange(m.shape[1]), m.shape[0]), "value": m.ravel()}))
    r, logits = validation.cscv(frame(values), 8).first(), []
    blocks = np.split(np.arange(48), 8)
    for chosen in combinations(range(8), 4):
        inside = np.concatenate([blocks[p] for p in chosen])
        outside = np.setdiff1d(np.arange(48), inside)
        best = values[inside].mean(0).argmax()
        oos = values[outside].mean(0)
        share = min(max((oos < oos[best]).sum() / 6, 1e-6), 1 - 1e-6)
        logits.append(math.log(share / (1 - share)))
    assert (r.pbo, r.n_combinations, r.median_logit) == (pytest.approx(np.mean(np.array(logits) <= 0)), 70, pytest.approx(np.median(logits)))
    many = validation.cscv(frame(rng.standard_normal((64, 1000))), 16).first()
    assert many.n_combinations == math.comb(16, 8) and 0.2 < many.pbo < 0.8


def test_folds_by_plain_loops(spark):
    rng = np.random.default_rng(6)
    rows = []
    for key, n in (("a", 103), ("b", 60), ("c", 3)):
        for i in range(n):
            t0 = D(2020, 1, 1) + dt.timedelta(2 * i)
            rows.append((key, t0, t0 + dt.timedelta(int(rng.integers(0, 25)))))
    got = {(r.secid, r.fold, r.t0): r.role for r in validation.purged_folds(spark.createDataFrame(rows, "secid string, t0 date, t1 date"), 5, 0.03).collect()}
    want = {}
    for key in "abc":
        own = [r for r in rows if r[0] == key]
        for fold, part in enumerate(np.array_split(np.arange(len(own)), 5)):
            if not len(part):
                continue
            begin, end = own[part[0]][1], max(own[i][2] for i in part)
            right = sum(r[1] <= end for r in own) + int(len(own) * 0.03)
            for i, (_, t0, t1) in enumerate(own):
                role = "test" if i in part else "train" if t1 < begin or i >= right else None
                if role:
                    want[key, fold, t0] = role
    assert got == want


@pytest.mark.parametrize("size", [16, 4096])
def test_sliding_windows_over_blocks_by_plain_loops(spark, monkeypatch, size):
    """Blocks of sixteen bars, or one for all: medians and differences with unknown values, ties and windows longer than a block."""
    monkeypatch.setattr(blocks, "BARS", size)
    rng, rows = np.random.default_rng(size), []
    for key, n in (("a", 90), ("b", 33), ("c", 3), (None, 20)):
        values = np.round(rng.standard_normal(n), 1)
        values[rng.random(n) < 0.04] = np.nan
        rows += [(key, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame([(k, i, None if math.isnan(v) else v) for k, i, v in rows], "secid string, date int, v double").repartition(3)
    for n in (1, 4, 21):
        got = {(r.secid, r.date): r.m for r in blocks.rolling_medians(df, "v", n, "m").collect()}
        weights = {"x": series.fraction_weights(0.4, 0.03)[:n], "y": [1.0] * n}
        diffs = {(r.secid, r.date): (r.x, r.y) for r in blocks.fractional_differences(df, "v", weights).collect()}
        assert len(got) == len(diffs) == len(rows)
        for key in ("a", "b", "c", None):
            own = [v for k, _, v in rows if k == key]
            for i in range(len(own)):
                window = own[max(0, i - n + 1) : i + 1]
                full = len(window) == n and not any(map(math.isnan, window))
                assert got[key, i] == (pytest.approx(np.median(window)) if full else None)
                for name, mine in zip(weights, diffs[key, i], strict=True):
                    tail = own[max(0, i - len(weights[name]) + 1) : i + 1]
                    known = len(tail) == len(weights[name]) and not any(map(math.isnan, tail))
                    assert mine == (pytest.approx(float(np.dot(tail[::-1], weights[name])), abs=1e-12) if known else None)


def test_digests_of_files_by_plain_loops_and_whatever_the_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    contents = {"a.parquet": rng.bytes(300_000), "b.parquet": b"one\n\ntwo\r\n\xff\n", "c.parquet": b"x" * 50_000, "d.parquet": b"\n" * 1000 + b"end", "e.txt": b"no"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "64k", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append({r.path.rpartition("/")[2]: (r["size"], r.digest) for r in dataset.file_digests(spark, f"file://{tmp_path}").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] and {*found[0]} == {"a.parquet", "b.parquet", "c.parquet", "d.parquet"}
    for name, (size, digest) in found[0].items():
        h, parts = 0, contents[name].split(b"\n")
        for part in parts[:-1] if not parts[-1] else parts:
            h = (h * dataset.BASE + int.from_bytes(hashlib.blake2b(part, digest_size=15).digest(), "big") + 1) % dataset.PRIME
        assert (size, digest) == (len(contents[name]), f"{h:032x}")
    assert len({d for _, d in found[0].values()}) == 4
