"""Bars: daily candles from ticks or trades, resampling, calendars, grids, turnover averages, and scans for gaps and delisted securities.

Candles are rows (secid, date, open, high, low, close, value, volume); `value` is turnover in money.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, secid: Column, ts: str, price: str) -> DataFrame:
    """Daily candles of ticks; the first and last known price by time. Value is the sum of prices, volume the number of ticks."""
    known = F.when(F.col(price).isNotNull(), F.col(ts))
    return (
        ticks.groupBy(secid.alias("secid"), F.to_date(ts).alias("date"))
        .agg(
            F.min_by(price, known).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, known).alias("close"),
            F.sum(price).alias("value"),
            F.count("*").cast("double").alias("volume"),
        )
    )


def trade_bars(trades: DataFrame) -> DataFrame:
    """Daily candles of trades (secid, date, amount, quantity); the close is the volume-weighted price, the open the mean of the extremes."""
    price = F.col("amount") / F.col("quantity")
    return (
        trades.groupBy("secid", "date")
        .agg(F.max(price).alias("high"), F.min(price).alias("low"), F.sum("amount").alias("value"), F.sum("quantity").alias("volume"))
        .select("secid", "date", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", (F.col("value") / F.col("volume")).alias("close"), "value", "volume")
    )


def bucket(date: Column, freq: str) -> Column:
    """The period that a date belongs to: weeks end on Fridays; months and quarters by their first day."""
    if freq == "week":
        return F.next_day(F.date_sub(date, 1), "FRI")
    if freq in ("month", "quarter"):
        return F.trunc(date, freq)
    raise ValueError(f"no such frequency: {freq}")


def resample(candles: DataFrame, freq: str) -> DataFrame:
    """One bar for each security and period with trades, dated by its last traded day; null prices are passed over."""
    first = F.min_by("open", F.when(F.col("open").isNotNull(), F.col("date")))
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date")))
    bars = candles.groupBy("secid", bucket(F.col("date"), freq).alias("period")).agg(
        first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), F.sum("value").alias("value"), F.sum("volume").alias("volume"), F.max("date").alias("date")
    )
    return bars.drop("period")


def union_calendar(candles: DataFrame) -> DataFrame:
    return candles.select("date").distinct()


def between(candles: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the span, both ends included; securities without rows in it vanish."""
    return candles.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def grid(candles: DataFrame) -> DataFrame:
    """Every date of the union calendar for every security, with its candle or nulls. Each security makes the days of the calendar's span by itself, and
    those that nobody traded on go by a join on the date."""
    calendar = union_calendar(candles)
    first, last = calendar.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return candles.select("secid", "date", *[c for c in candles.columns if c not in ("secid", "date")])
    days = candles.select("secid").distinct().select("secid", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    return days.join(calendar, "date", "left_semi").join(candles, ["secid", "date"], "left")


def by_security() -> Window:
    return Window.partitionBy("secid").orderBy("date")


def forward_fill(df: DataFrame, columns: list[str], key: str = "secid", order: str = "date") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def back_fill(df: DataFrame, columns: list[str], key: str = "secid", order: str = "date") -> DataFrame:
    """The next known value where one is missing, as before the first one after a forward fill."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def average_turnover(candles: DataFrame, bars: int = 20) -> DataFrame:
    """adv: mean turnover of the last bars, of as many as there are."""
    return candles.withColumn("adv", F.avg("value").over(by_security().rowsBetween(1 - bars, 0)))


def month_ends(candles: DataFrame) -> DataFrame:
    """Last traded day of each month."""
    return candles.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))


def week_lasts(calendar: DataFrame) -> DataFrame:
    """Last traded day of each week from Monday to Sunday."""
    return calendar.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max("date").alias("date"))


def delisted(candles: DataFrame, quiet_days: int = 30) -> DataFrame:
    """Securities whose last bar is more than quiet_days before the last day of all."""
    last = candles.groupBy("secid").agg(F.max("date").alias("last_date"))
    end = last.agg(F.max("last_date")).first()[0]  # one date
    return last.where(F.col("last_date") < F.date_sub(F.lit(end).cast("date"), quiet_days)).select("secid", "last_date")


def gaps_and_moves(candles: DataFrame, move: float = 0.15) -> DataFrame:
    """Per security: the longest gap in days and the number of closes that moved by more than `move`."""
    w = by_security()
    change = F.abs(F.col("close") / F.lag("close").over(w) - 1)
    steps = candles.select("secid", F.date_diff("date", F.lag("date").over(w)).alias("gap"), change.alias("change"))
    return steps.groupBy("secid").agg(F.max("gap").cast("long").alias("max_gap"), F.count_if(F.col("change") > move).alias("big_moves"))


def bars_until(candles: DataFrame) -> DataFrame:
    """n_bars: how many bars of a security are known at each date; what a decision on that date may see."""
    return candles.withColumn("n_bars", F.row_number().over(by_security()))
