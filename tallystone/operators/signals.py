"""Signal queries: weights (secid, date, weight) of strategies for every date at once. A date's weights use bars up to that date and no later.

A slot weighs 1/top_n even if fewer securities qualify; what is left over stays cash. Ties go by `secid`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.asof import step_lookup
from tallystone.operators.series import bar_return, bars

#: Rules: which returns qualify, whether the highest come first, and the sign of a weight.
RULES = {
    "momentum": (None, True, 1),
    "absolute_momentum": ("> 0", True, 1),
    "mean_reversion": (None, False, 1),
    "short_momentum": ("< 0", False, -1),
    "short_overbought": ("> 0", True, -1),
}


def returns(candles: DataFrame, lookback: int, lag: int = 0) -> DataFrame:
    """(secid, date, ret) where the lookback is known."""
    return candles.select("secid", "date", bar_return("close", lookback, bars(), lag).alias("ret")).where("ret is not null")


def ranked(candles: DataFrame, rule: str, lookback: int, top_n: int) -> DataFrame:
    """The top_n securities of each date by the rule."""
    condition, highest, sign = RULES[rule]
    scored = returns(candles, lookback)
    if condition:
        scored = scored.where(f"ret {condition}")
    order: Column = F.desc("ret") if highest else F.asc("ret")
    place = F.row_number().over(Window.partitionBy("date").orderBy(order, F.asc_nulls_last("secid")))
    return scored.withColumn("place", place).where(F.col("place") <= top_n).select("secid", "date", "ret", "place", F.lit(sign / top_n).alias("weight"))


def buy_and_hold(candles: DataFrame, secid: str, weight: float = 1.0) -> DataFrame:
    return candles.where(F.col("secid") == secid).select("secid", "date", F.lit(weight).alias("weight"))


def once_a_month(weights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weights of the first date of each month, held through it; decided then and not again."""
    held = calendar.select("date", F.min("date").over(Window.partitionBy(F.trunc("date", "month"))).alias("decided"))
    return held.join(weights.withColumnRenamed("date", "decided"), "decided").select("secid", "date", "weight")


def driven_basket(candles: DataFrame, driver: str, basket: list[str], lookback: int, lag: int, short: bool = False) -> DataFrame:
    """Equal weights over the basket's tradeable members while the driver's lagged return is positive (short: negative weights while it is negative)."""
    signal = returns(candles.where(F.col("secid") == driver), lookback, lag).select("date", F.col("ret").alias("signal"))
    on = signal.where("signal < 0" if short else "signal > 0")
    members = candles.where(F.col("secid").isin(basket)).select("secid", "date")
    share = (-1.0 if short else 1.0) / F.count("*").over(Window.partitionBy("date"))
    return members.join(on, "date").select("secid", "date", "signal", share.alias("weight"))


def meta_filtered(candidates: DataFrame, proba: DataFrame, threshold: float) -> DataFrame:
    """Candidates (secid, date, weight) whose probability reaches the threshold; their weights don't grow for those that fall out."""
    return candidates.join(proba, ["secid", "date"]).where(F.col("proba") >= threshold).select("secid", "date", "weight", "proba")


def most_confident(proba: DataFrame, threshold: float, slots: int) -> DataFrame:
    """Of all that reach the threshold the most confident, 1/slots each."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("proba"), "secid"))
    found = proba.where(F.col("proba") >= threshold).withColumn("place", place).where(F.col("place") <= slots)
    return found.select("secid", "date", F.lit(1 / slots).alias("weight"), "proba")


def weighted_returns(weights: DataFrame, candles: DataFrame) -> DataFrame:
    """(config, date, ret) of weights (config, secid, date, weight): each bar's return by the weights of the bar before it, before costs. What isn't weighted stays cash."""
    w = bars()
    steps = candles.select("secid", F.lag("date").over(w).alias("_decided"), F.col("date").alias("_bar"), bar_return("close", 1, w).alias("ret")).where("ret is not null")
    earned = weights.withColumnRenamed("date", "_decided").join(steps, ["secid", "_decided"])
    return earned.groupBy("config", F.col("_bar").alias("date")).agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


#: The features of a bet, in the order that models see them.
BET_FEATURES = ["mom20", "mom60", "mom120", "vol20", "ma50", "currency_mom60", "index_mom20", "index_vol20"]


def _market(series: DataFrame | None, **columns: Callable) -> DataFrame | None:
    """(date, name: struct of the columns) of a market series (date, close)."""
    if series is None:
        return None
    w = Window.partitionBy("_all").orderBy("date")  # one security's bars
    one = series.select("date", "close", F.lit(0).alias("_all"))
    one = one.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return one.select("date", F.struct(*[c(w).alias(n) for n, c in columns.items()]).alias("_market"))


def bet_features(candles: DataFrame, currency: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(secid, date, BET_FEATURES): own momentum over 20, 60 and 120 bars, volatility over 20 and distance to the mean of 50; of the market's currency its momentum over 60 bars, of its
    index momentum and volatility over 20, as they were known at the date. Nothing where history is short; 0 for a series that the market hasn't got."""
    from tallystone.operators.series import distance_to_mean, rolling_std, with_returns

    w = bars()
    own = with_returns(candles).select(
        "secid", "date", *[bar_return("close", n, w).alias(f"mom{n}") for n in (20, 60, 120)], rolling_std("ret", 20, w).alias("vol20"), distance_to_mean("close", 50, w).alias("ma50")
    )
    series = {
        "_currency": _market(currency, currency_mom60=lambda v: bar_return("close", 60, v)),
        "_index": _market(index, index_mom20=lambda v: bar_return("close", 20, v), index_vol20=lambda v: rolling_std("ret", 20, v)),
    }
    for name, steps in series.items():
        if steps is not None:
            own = step_lookup(own, "date", steps.withColumnRenamed("_market", name), "date", name)
    market = [F.col(f"{s}.{n}") if series[s] is not None else F.lit(0.0) for s, n in (("_currency", BET_FEATURES[5]), ("_index", BET_FEATURES[6]), ("_index", BET_FEATURES[7]))]
    return own.select("secid", "date", *BET_FEATURES[:5], *[m.alias(n) for m, n in zip(market, BET_FEATURES[5:], strict=True)])


def feature_frame(df: DataFrame) -> DataFrame:
    """df with the features of a bet in their order, null where it hasn't got one, after its own other columns."""
    others = [c for c in df.columns if c not in BET_FEATURES]
    return df.select(*others, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in BET_FEATURES])


def training_set(
    candles: DataFrame, start: str, end: str, lookback: int = 120, top_n: int = 4, max_holding: int = 60, targets: float = 2.0, span: int = 20,
    currency: DataFrame | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """(secid, t0, t1, y, BET_FEATURES): the top_n by momentum at each month's last traded day in the span, labelled by triple barriers at so many times their
    volatility, with the features known then; bets with an unknown feature go. A bet whose longest holding would pass the end of the span is left out, so that no label looks beyond it."""
    from tallystone.operators.bars import month_ends, union_calendar
    from tallystone.operators.labeling import meta_labels
    from tallystone.operators.series import ewm_volatility

    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    calendar = union_calendar(candles).withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # trading days
    cutoff = calendar.where(F.col("date") < last).count()  # how many days of the calendar come before the end
    entries = month_ends(union_calendar(candles).where(F.col("date").between(first, last))).join(calendar, "date")
    entries = entries.where(F.col("pos") + max_holding <= cutoff).select("date")
    picks = ranked(candles, "momentum", lookback, top_n).join(entries, "date", "left_semi").select("secid", F.col("date").alias("t0"))
    width = ewm_volatility(candles, span).select("secid", F.col("date").alias("t0"), F.col("ewm_std").alias("target"))
    events = picks.join(width, ["secid", "t0"]).withColumn("side", F.lit(1.0))
    labelled = meta_labels(events, candles, max_holding, targets, targets).select("secid", "t0", "t1", F.col("meta").alias("y"))
    features = bet_features(candles, currency, index).withColumnRenamed("date", "t0")
    return labelled.join(features, ["secid", "t0"]).na.drop(subset=BET_FEATURES)
