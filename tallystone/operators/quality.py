"""Data quality of candles: one report row for each security, and the exclusions that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.finance import quotient


def missing_days(candles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days inside a security's own span on which it has no candle."""
    span = candles.groupBy("secid").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select("secid", F.explode(F.sequence("lo", "hi")).alias("date"))
    due = days.join(calendar.select("date").distinct(), "date", "left_semi").select("secid", "date")
    return due.join(candles.select("secid", "date").distinct(), ["secid", "date"], "left_anti")


def price_jumps(candles: DataFrame, confirmed: DataFrame, threshold: float) -> DataFrame:
    """(secid, date, change, reason): closes that moved by more than the threshold, from zero too; reason is a confirmed event's (date, secid or null for all, reason), else null."""
    w = Window.partitionBy("secid").orderBy("date")
    moved = candles.select("secid", "date", (quotient(F.col("close"), F.lag("close").over(w)) - 1).alias("change")).where(F.abs("change") > threshold)
    events = confirmed.groupBy(F.col("date").alias("_date"), F.col("secid").alias("_secid")).agg(F.min("reason").alias("_reason"))
    hit = (F.col("date") == F.col("_date")) & (F.col("_secid").isNull() | (F.col("_secid") == F.col("secid")))  # an equi-join on the date, then the residual
    joined = moved.join(events, hit, "left")
    return joined.groupBy("secid", "date", "change").agg(F.min("_reason").alias("reason"))


def validation(candles: DataFrame, calendar: DataFrame, confirmed: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each security: counts of duplicate dates, missing days, broken highs and lows, negative volumes, prices of zero or less, jumps
    that no event confirms and jumps that one does; total, and `suspicious` if there is an unconfirmed jump."""
    body = candles.groupBy("secid").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count_distinct("date")).alias("duplicate_dates"),
        F.count_if(F.col("high") < F.greatest("open", "close")).alias("high_below_body"),
        F.count_if(F.col("low") > F.least("open", "close")).alias("low_above_body"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("non_positive_price"),
    )
    missing = missing_days(candles, calendar).groupBy("secid").agg(F.count("*").alias("missing_days"))
    jumps = price_jumps(candles, confirmed, threshold).groupBy("secid").agg(
        F.count_if(F.col("reason").isNull()).alias("suspicious_jumps"), F.count_if(F.col("reason").isNotNull()).alias("confirmed_jumps")
    )
    report = body.join(missing, "secid", "left").join(jumps, "secid", "left").na.fill(0, ["missing_days", "suspicious_jumps", "confirmed_jumps"])
    counted = ["duplicate_dates", "missing_days", "high_below_body", "low_above_body", "negative_volume", "non_positive_price", "suspicious_jumps"]
    total = sum((F.col(c) for c in counted[1:]), F.col(counted[0]))
    return report.withColumns({"anomalies": total, "suspicious": F.col("suspicious_jumps") > 0})


def without_suspicious(candles: DataFrame, report: DataFrame) -> DataFrame:
    return candles.join(report.where("suspicious").select("secid"), "secid", "left_anti")


def tradeable(candles: DataFrame, lookback: int) -> DataFrame:
    """Rows at which a security trades and has more bars than the lookback."""
    w = Window.partitionBy("secid").orderBy("date")
    return candles.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > lookback).drop("_n")


def invalid_event_dates(events: DataFrame, column: str = "date") -> DataFrame:
    """Events whose date is no ISO date."""
    return events.where(F.expr(f"try_to_date(`{column}`, 'yyyy-MM-dd')").isNull())
