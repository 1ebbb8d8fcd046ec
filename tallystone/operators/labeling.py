"""Labels of events on price paths: triple barriers, meta labels, concurrency weights. Paths are found by bar ordinals, so joins are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(candles: DataFrame) -> DataFrame:
    """(secid, date, pos, close, n_bars): bar ordinals from 0."""
    w = Window.partitionBy("secid")
    return candles.select("secid", "date", (F.row_number().over(w.orderBy("date")) - 1).alias("pos"), "close", F.count("*").over(w).alias("n_bars"))


def vertical_barriers(events: DataFrame, candles: DataFrame, max_holding: int) -> DataFrame:
    """events (secid, t0, target[, side]) with pos and vertical_pos: max_holding bars on, or the last bar. Events off the bars, and those without a positive target, go."""
    at = numbered(candles).select("secid", F.col("date").alias("t0"), "pos", "n_bars", F.col("close").alias("entry"))
    return events.join(at, ["secid", "t0"]).where("target > 0").withColumn("vertical_pos", F.least(F.col("pos") + max_holding, F.col("n_bars") - 1)).drop("n_bars")


def triple_barrier(events: DataFrame, candles: DataFrame, max_holding: int = 10, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """(secid, t0, t1, ret, label): the first touch of +up or -down targets or the vertical barrier; a tie goes to the upper, then the lower one.

    Each event is exploded to its path of at most max_holding bars and joined on the bar's ordinal.
    """
    placed = vertical_barriers(events, candles, max_holding).where("vertical_pos > pos")
    if "side" not in placed.columns:
        placed = placed.withColumn("side", F.lit(1.0))
    path = placed.withColumn("at", F.explode(F.sequence("pos", "vertical_pos")))
    bars = numbered(candles).select("secid", F.col("pos").alias("at"), F.col("date").alias("bar_date"), "close")
    walked = path.join(bars, ["secid", "at"]).withColumn("ret", (F.col("close") / F.col("entry") - 1) * F.col("side"))
    first = walked.groupBy("secid", "t0", "side").agg(
        F.min(F.when(F.col("ret") >= up * F.col("target"), F.col("at"))).alias("at_up"),
        F.min(F.when(F.col("ret") <= -down * F.col("target"), F.col("at"))).alias("at_down"),
        F.max("at").alias("at_end"),
        F.map_from_entries(F.collect_list(F.struct("at", F.struct("bar_date", "ret")))).alias("bars"),
    )
    at = F.least("at_up", "at_down", "at_end")
    label = F.when(at == F.col("at_up"), 1).when(at == F.col("at_down"), -1).otherwise(0)
    touched = first.withColumn("hit", F.col("bars")[at])
    return touched.select("secid", "t0", "side", F.col("hit.bar_date").alias("t1"), F.col("hit.ret").alias("ret"), label.alias("label"))


def meta_labels(events: DataFrame, candles: DataFrame, max_holding: int = 10, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """Triple barriers of sided events, with meta = 1 if the sided return was positive."""
    return triple_barrier(events.where("side is not null"), candles, max_holding, up, down).withColumn("meta", (F.col("ret") > 0).cast("int"))


def concurrency_weights(labels: DataFrame, candles: DataFrame) -> DataFrame:
    """(secid, t0, weight): mean over a label's bars of one over the labels alive on that bar, scaled to a mean of 1 within the security."""
    bars = numbered(candles).select("secid", "date", "pos")
    spans = labels.select("secid", "t0", "t1").join(bars.select("secid", F.col("date").alias("t0"), F.col("pos").alias("pos0")), ["secid", "t0"])
    spans = spans.join(bars.select("secid", F.col("date").alias("t1"), F.col("pos").alias("pos1")), ["secid", "t1"])
    alive = spans.withColumn("pos", F.explode(F.sequence("pos0", "pos1")))
    counted = alive.groupBy("secid", "pos").agg(F.count("*").alias("n"))
    raw = alive.join(counted, ["secid", "pos"]).groupBy("secid", "t0").agg(F.avg(1 / F.col("n")).alias("raw"))
    return raw.select("secid", "t0", (F.col("raw") / F.avg("raw").over(Window.partitionBy("secid"))).alias("weight"))
