"""The domain's inputs over the star-schema tables: candles of events and of line items, and small literal tables that are the same text in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators.bars import tick_bars, trade_bars
from tallystone.operators.persist import cut

RATES = [
    ("1995-03-01", 0.16), ("1996-01-15", 0.18), ("1997-06-01", 0.15), ("1998-02-10", 0.21), ("1999-05-05", 0.17), ("2000-09-09", 0.12), ("2001-04-04", 0.14),
]
MEMBERS = [
    ("1995-06-01", "AFRICA"), ("1995-06-01", "ASIA"), ("1995-06-01", "EUROPE"), ("1997-01-01", "AMERICA"), ("1997-01-01", "ASIA"), ("1999-03-15", "EUROPE"), ("1999-03-15", "MIDDLE EAST"),
]
DIVIDENDS = [
    ("AFRICA", "1996-05-10", 34.5, None), ("AFRICA", "1998-05-11", 25.0, "1998-05-07"), ("ASIA", "1997-07-18", 900.0, None), ("ASIA", "1999-07-19", 0.2, None),
    ("EUROPE", "1995-01-03", 5.0, None), ("EUROPE", "2000-11-11", 120.0, "2000-11-08"), ("AMERICA", "2001-03-30", 61.25, None), ("AMERICA", "2011-03-30", 61.25, None),
]
EVENTS = [("1996-02-01", "AFRICA", "split"), ("1997-03-03", None, "holiday"), ("1998-08-17", None, "crisis"), ("1999-10-05", "ASIA", "merger")]
LOTS = [("AFRICA", 10), ("AMERICA", 1), ("ASIA", 10), ("EUROPE", 1), ("MIDDLE EAST", 5)]


def values(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL table; columns are `name type` pairs."""
    names = [c.strip().rsplit(" ", 1) for c in columns.split(",")]

    def literal(v: object) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {body}) AS t({', '.join(n for n, _ in names)}))"


def literal(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values(rows, columns)}")


RATE_COLUMNS, MEMBER_COLUMNS, DIVIDEND_COLUMNS, EVENT_COLUMNS, LOT_COLUMNS = (
    "date DATE, rate DOUBLE", "snapshot_date DATE, secid VARCHAR(20)", "secid VARCHAR(20), record_date DATE, amount DOUBLE, last_day_with_rights DATE",
    "date DATE, secid VARCHAR(20), reason VARCHAR(20)", "secid VARCHAR(20), lot DOUBLE",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of events: 30 days, a security for each user."""
    return tick_bars(table(spark, sf_dir, "events"), F.concat(F.lit("U"), F.col("user_id")), "ts", "value")


def long_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of line items: seven years, a security for each region of the supplier. The chain of dimensions is joined smallest first."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("secid"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "secid")
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"))
    return trade_bars(item.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("secid", "date", "amount", "quantity"))


def cut_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long_candles written once, for queries that read them several times."""
    return cut(long_candles(spark, sf_dir))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of orders: runs by priority; filled orders close a position."""
    o = table(spark, sf_dir, "orders")
    pnl = F.when(F.col("o_orderstatus") == "F", (F.col("o_custkey") % 7 - 3) * F.col("o_totalprice") * 0.01)
    return o.select(F.col("o_orderpriority").alias("run_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("order_value"), (F.col("o_totalprice") * 0.001).alias("costs"), pnl.alias("realized_pnl"))


#: The same views in SQL.
C = """c AS (SELECT 'U' || user_id AS secid, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, sum(value) AS value, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
L = """l AS (SELECT r_name AS secid, CAST(l_shipdate AS DATE) AS date, (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close,
  sum(l_extendedprice) AS value, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
FILLS = """f AS (SELECT o_orderpriority AS run_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS order_value, o_totalprice * 0.001 AS costs,
  CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 7 - 3) * o_totalprice * 0.01 END AS realized_pnl FROM orders)"""
RATES_SQL = f"rates AS (SELECT * FROM {values(RATES, RATE_COLUMNS)})"
MEMBERS_SQL = f"members AS (SELECT * FROM {values(MEMBERS, MEMBER_COLUMNS)})"
DIVIDENDS_SQL = f"dividends AS (SELECT * FROM {values(DIVIDENDS, DIVIDEND_COLUMNS)})"
EVENTS_SQL = f"confirmed AS (SELECT * FROM {values(EVENTS, EVENT_COLUMNS)})"
