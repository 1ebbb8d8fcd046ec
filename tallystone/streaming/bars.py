"""Streaming forms: bars of ticks under a watermark, sessions, and keyed CUSUM state. An addition; the batch operators are the reference for results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_bars(ticks: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(secid, start, open, high, low, close, value, volume) of ticks (secid, ts, price); ticks later than `late` are dropped by the watermark."""
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "secid").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("price").alias("value"), F.count("*").alias("volume")
    )
    return bars.select("secid", F.col("w.start").alias("start"), "open", "high", "low", "close", "value", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "secid").agg(F.count("*").alias("n"), F.sum("price").alias("value")).select(
        "secid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value"
    )


def cusum_stream(prices: DataFrame, threshold: float) -> DataFrame:
    """(secid, ts, direction) of prices (secid, ts, price): the batch operator's fold with its sums and last price kept as state."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last = state.get if state.exists else (0.0, 0.0, None)
        found = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            if last is not None:
                up, down = max(0.0, up + row.price - last), min(0.0, down + row.price - last)
                if up > threshold:
                    up = 0.0
                    found.append((key[0], row.ts, 1))
                elif down < -threshold:
                    down = 0.0
                    found.append((key[0], row.ts, -1))
            last = row.price
        state.update((up, down, last))
        yield pd.DataFrame(found, columns=["secid", "ts", "direction"])

    return prices.groupBy("secid").applyInPandasWithState(
        step, "secid string, ts timestamp, direction int", "up double, down double, last double", "append", GroupStateTimeout.NoTimeout
    )
