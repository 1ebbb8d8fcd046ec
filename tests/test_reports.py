import datetime as dt

from pyspark.sql import functions as F

from tallystone.engine import reports
from tallystone.functions.finance import Costs
from tallystone.operators import metrics, universe

D = dt.date


def test_reports_say_what_matters_first(spark):
    curve = [("run", D(2024, 1, 1 + i), 20_000.0 - i) for i in range(10)]
    eq = metrics.equity_metrics(spark.createDataFrame(curve, "run_id string, date date, equity double"), 0.16)
    fills = metrics.fill_metrics(spark.createDataFrame([("run", 5000.0, 8.0, None)], "run_id string, order_value double, costs double, realized_pnl double"))
    text = reports.run_report("run", eq, fills, spark.createDataFrame([("cash", 0.16)], "name string, annual_return double"), None, ["lots are today's"], 0.16)
    assert text.startswith("LOSES TO CASH") and "1 trades" in text and "against cash: 16.0%" in text and text.endswith("lots are today's")
    taxed = metrics.tax_by_year(spark.createDataFrame([("run", D(2024, 5, 1), 100.0), ("run", D(2025, 5, 1), -5.0), ("other", D(2024, 1, 1), 9.0)], "run_id string, date date, realized_pnl double"), 0.13)
    lots = metrics.resolution(spark.createDataFrame([("A", 500.0), ("B", 9000.0)], "secid string, lot_cost double"), 20_000, 4, 0.25)
    full = reports.run_report("run", eq, fills, spark.createDataFrame([("cash", 0.16), ("index", 0.1), ("fund", 0.12)], "name string, annual_return double"), None, [], 0.16, taxed, lots, 2.0)
    for line in ("tax of 2024: 13.00 on 100.00", "tax of 2025: 0.00 on -5.00", "too dear: B", "stressed: costs are 2 times", "against fund: 12.0%", "against index: 10.0%"):
        assert line in full
    assert "9.00" not in full
    chosen = spark.createDataFrame([(0, "a")], "window int, config string")
    annual = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "config string, annual double")
    out = reports.walk_forward_report(chosen, annual, eq, "below risk-free")
    assert "best made 30.0%, the median 20.0%" in out and out.endswith("below risk-free")
    assert "23.5%" in reports.break_even_header(20_000, 0.16, 1500, Costs())


def test_schedules_probe_the_first_days(spark):
    rows = [(D(2024, 1, 3), "a"), (D(2024, 1, 4), "z"), (D(2024, 2, 1), "a"), (D(2024, 2, 1), "b"), (D(2024, 3, 20), "c")]
    c = spark.createDataFrame(rows, "date date, secid string")
    got = sorted((r.snapshot_date, r.secid) for r in universe.schedule(c, "2024-01-01", "2024-03-31").collect())
    assert got == [(D(2024, 1, 3), "A"), (D(2024, 2, 1), "A"), (D(2024, 2, 1), "B")]
    white = spark.createDataFrame([("A",), ("Q",)], "secid string")
    assert [(r.secid, r.from_index) for r in universe.on_date(c, "2024-02-01", white).collect()] == [("A", True)]
    alone = universe.on_date(c, "2023-02-01", white)
    assert alone.count() == 2 and alone.where(F.col("limitation").isNull()).count() == 0
    s = universe.membership_stats(universe.schedule(c, "2024-01-01", "2024-03-31")).first()
    assert (s.n_snapshots, s.least, s.most, s.n_ever) == (2, 1, 2, 2)
