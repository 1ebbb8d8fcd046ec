"""Every query of the library runs on the smallest tables and, where it has SQL, equals DuckDB's answer."""

import datetime as dt
import glob
import os

import pandas as pd
import pytest

from tallystone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


#: The bytes of files, which SQL doesn't see; test_scale holds them against a plain loop.
HELD_BY_BRUTE_FORCE = {"s4_file_digests"}


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        if hasattr(x, "isoformat"):
            return x.isoformat()[:10]
        return f"{x:.9g}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)

    columns = sorted(df.columns)
    return sorted(tuple(one(x) for x in row) for row in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name == "j19_grid" or not any(x in plan for x in ("NestedLoopJoin", "CartesianProduct"))  # j19 is the product of two lists
    got = df.toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert name in HELD_BY_BRUTE_FORCE
        assert got.shape[1] and len(got)


#: Queries that divide by a price.
ZERO_PRICES = ["p10_without_suspicious", "q2_momentum", "q3_absolute_momentum", "q4_mean_reversion", "q5_short_momentum", "q6_short_overbought", "w11_ewm_volatility"]


@pytest.mark.parametrize("name", ZERO_PRICES)
def test_a_price_of_zero_divides_as_in_sql(spark, tmp_path, name):
    """Zero once, zero five bars apart (0 / 0), from zero to below it, never, and far jumps without one."""
    import duckdb

    prices = {1: [2, 3, 0, 2, 3, 2, 2, 3, 4, 2, 3, 2], 2: [2, 3, 0, 2, 3, 2, 2, 0, 4, 2, 3, 2], 3: [2, 3, 0, 2, 3, 2, 2, -1, 0, 2, 3, 2], 4: [2, 3, 2, 2, 3, 2, 2, 3, 4, 2, 3, 2], 5: [2, 9, 2, 9, 3, 2, 2, 3, 9, 2, 3, 1]}
    rows = [(u, dt.datetime(2024, 1, 1 + k), float(v)) for u, values in prices.items() for k, v in enumerate(values)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) != []


#: Prices of days by security; a list has several of one day.
ODD_PRICES = {
    "negative zero": {1: [-0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0], 2: [-0.0, 1.0, 1.0, 1.0, 1.0, -2.0, -3.0], 3: [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0.5]},
    "unknown price": {1: [[2.0, None], 1.0, 1.0, 1.0, 1.0, 3.0], 2: [[None, 4.0, None], 1.0, 1.0, 1.0, 1.0, [1.0, None]], 3: [None, 1.0, 1.0, 1.0, 1.0, 3.0]},
    "unknown security": {None: [2.0, 4.0, 1.0, 1.0, 1.0, 4.0, 1.0], 1: [2.0, 4.0, 1.0, 1.0, 1.0, 4.0, 1.0]},
}
#: Queries that rank securities of events by their returns.
RANKED = ["q3_absolute_momentum", "q4_mean_reversion", "q5_short_momentum", "q6_short_overbought"]


@pytest.mark.parametrize("odd", ODD_PRICES)
@pytest.mark.parametrize("name", RANKED)
def test_odd_prices_rank_as_in_sql(spark, tmp_path, name, odd):
    """A zero's sign is that of the infinite return, a day closes at its last known price, and a security without a name comes last of equals."""
    import duckdb

    days = [(u, k, v if isinstance(v, list) else [v]) for u, prices in ODD_PRICES[odd].items() for k, v in enumerate(prices)]
    rows = [(u, dt.datetime(2024, 1, 1 + k, hour), v) for u, k, several in days for hour, v in enumerate(several)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) != []


@pytest.mark.parametrize("name", ["p10_calm_customers", "p10_without_suspicious"])
def test_no_event_excuses_a_jump(spark, tmp_path, name):
    """Security 1 jumps on the day of an event that p8 and p9 take as the reason for any jump, 2 on another day, 3 on none."""
    import duckdb

    rows = [(k, dt.datetime(1998, 8, 15 + i), price) for k, prices in {1: [1.0, 1.0, 20.0, 20.0], 2: [1.0, 20.0, 20.0, 20.0], 3: [1.0, 2.0, 1.0, 2.0]}.items() for i, price in enumerate(prices)]
    con = duckdb.connect()
    for table, names in {"orders": ("o_custkey", "o_orderdate", "o_totalprice"), "events": ("user_id", "ts", "value")}.items():
        spark.createDataFrame(rows, "k long, t timestamp, v double").toDF(*names).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = catalog.queries()[name](spark, str(tmp_path)).select("secid", "n")
    assert sorted(map(tuple, got.collect())) == con.execute(f"SELECT secid, n FROM ({catalog.oracle_sql()[name]})").fetchall() == [("C3" if "calm" in name else "U3", 4)]


def test_whole_queries_take_every_bar_and_line_item(spark):
    from tallystone.operators import labeling
    from tallystone.plans.views import long_candles, table

    whole = labeling.numbered(long_candles(spark, SF)).where("pos < n_bars - 1").select("secid", "date")
    for name in ("w21_triple_barrier", "w23_meta_labels", "w24_concurrency"):
        assert {(r.secid, r.t0) for r in catalog.queries()[name](spark, SF).select("secid", "t0").collect()} == {(r.secid, r.date) for r in whole.collect()}
    items = table(spark, SF, "lineitem").selectExpr("concat('U', l_partkey % 50) secid", "to_date(l_shipdate) ts").distinct()
    assert catalog.queries()["j1_feature_asof"](spark, SF).count() == items.count()


def test_every_key_of_a_subset_is_taken(spark):
    """No query's input is cut down by a remainder, a prefix or a sample."""
    import pathlib

    for path in (pathlib.Path(catalog.__file__).parent).glob("queries_*.py"):
        text = path.read_text()
        assert ".sample(" not in text and "pos % " not in text and "l_linenumber = 1" not in text, path


def test_importance_takes_every_security_and_bar(spark, monkeypatch):
    from tallystone.models import logistic
    from tallystone.operators import signals
    from tallystone.plans import queries_engine
    from tallystone.plans.views import long_candles

    taken = {}
    monkeypatch.setattr(logistic, "permutation_importance", lambda data, names, folds: taken.update(data=data))
    queries_engine.importance(spark, SF)
    full = signals.bet_features(long_candles(spark, SF)).select("secid", "date", "mom20", "vol20", "ma50").na.drop()
    last = long_candles(spark, SF).groupBy("secid").agg({"date": "max"}).toDF("secid", "last")
    assert taken["data"].count() == full.join(last, "secid").where("date < last").count() > 0
    assert taken["data"].select("key").distinct().count() == full.select("secid").distinct().count() > 1


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_the_library_stands_without_the_subpackage():
    """Nothing outside llm imports it."""
    import pathlib

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tallystone.llm" not in path.read_text(), path
