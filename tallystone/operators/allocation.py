"""Fund allocation over equity, bonds and cash: returns of the three assets, regimes, features and target rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.asof import asof_backward, step_before, step_lookup
from tallystone.operators.blocks import rolling_medians
from tallystone.operators.series import annual_volatility, bar_return, bars, distance_to_mean, drawdown_from_high, hold_weekly, rolling_mean, rolling_std


def aligned(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (run_id, date, ...) with the last value of right (run_id, date, value) at or before each date."""
    return asof_backward(left, right.withColumnRenamed("date", "_at"), ["run_id"], "date", "_at", [value])


def fund_returns(equity: DataFrame, bonds: DataFrame, rates: DataFrame, equity_fee: float = 0.008, bond_fee: float = 0.006) -> DataFrame:
    """(run_id, date, r_equity, r_bonds, r_cash, days) on the equity's calendar: index returns less fees over calendar days, and cash at the rate known the
    bar before. Days without any of the three go. equity and bonds: (run_id, date, close); rates: (date, rate)."""
    w = Window.partitionBy("run_id").orderBy("date")
    both = aligned(equity, bonds.select("run_id", "date", F.col("close").alias("bond")), "bond")
    steps = both.withColumns({"prev": F.lag("date").over(w), "days": F.date_diff("date", F.lag("date").over(w))})
    priced = steps.withColumns({"r_equity": bar_return("close", 1, w) - equity_fee * F.col("days") / 365.0, "r_bonds": bar_return("bond", 1, w) - bond_fee * F.col("days") / 365.0})
    cash = step_lookup(priced, "prev", rates, "date", "rate")
    out = cash.withColumn("r_cash", F.col("rate") * F.col("days") / 365.0)
    return out.na.drop(subset=["r_equity", "r_bonds", "r_cash"]).select("run_id", "date", "r_equity", "r_bonds", "r_cash", "days")


def easing(days: DataFrame, rates: DataFrame) -> DataFrame:
    """days (date) with easing: whether the last change of the rate was a cut."""
    steps = rates.join(step_before(rates, "date", "rate"), "date")
    turns = steps.select("date", F.signum(F.col("rate") - F.col("before")).alias("direction")).where("direction != 0")
    return step_lookup(days, "date", turns, "date", "direction", "zero").withColumn("easing", F.col("direction") < 0).drop("direction")


def targets(equity_share: Column, rest_in_bonds: Column) -> list[Column]:
    rest = 1 - equity_share
    to_bonds = F.coalesce(rest_in_bonds, F.lit(False))
    return [equity_share.alias("t_equity"), F.when(to_bonds, rest).otherwise(F.lit(0.0)).alias("t_bonds"), F.when(~to_bonds, rest).otherwise(F.lit(0.0)).alias("t_cash")]


def trend_targets(equity: DataFrame) -> DataFrame:
    """(run_id, date, share): all in equity while it is above its mean of 200 bars, decided weekly."""
    w = bars("run_id")
    mean = rolling_mean("close", 200, w)
    marked = equity.withColumn("raw", F.when(mean.isNotNull(), (F.col("close") > mean).cast("double")))
    return hold_weekly(marked, "raw", "share", "run_id").select("run_id", "date", "share")


def low_volatility_targets(equity: DataFrame) -> DataFrame:
    """All in equity while its volatility is below its median of 250 bars, decided weekly."""
    w = bars("run_id")
    ret = equity.withColumn("logret", F.log(F.col("close") / F.lag("close").over(w)))
    vol = ret.withColumn("vol", annual_volatility("logret", 20, w))
    both = vol.join(rolling_medians(vol, "vol", 250, "median", "run_id"), ["run_id", "date"])
    marked = both.withColumn("raw", F.when(F.col("median").isNotNull(), (F.col("vol") < F.col("median")).cast("double")))
    return hold_weekly(marked, "raw", "share", "run_id").select("run_id", "date", "share")


def risk_targets(forecast: DataFrame, k: float, most: float) -> DataFrame:
    """Out of equity while the forecast risk is above k times its base rate, else the most; decided weekly. forecast: (run_id, date, proba, base_rate)."""
    marked = forecast.withColumn("raw", F.when(F.col("proba") > k * F.col("base_rate"), 0.0).otherwise(F.lit(float(most))))
    return hold_weekly(marked, "raw", "share", "run_id").select("run_id", "date", "share")


def risk_features(equity: DataFrame, bonds: DataFrame) -> DataFrame:
    """Nine features of drawdown risk on the equity's calendar."""
    w = bars("run_id")
    both = aligned(equity, bonds.select("run_id", "date", F.col("close").alias("bond")), "bond")
    base = both.withColumns({"logret": F.log(F.col("close") / F.lag("close").over(w)), "bond_logret": F.log(F.col("bond") / F.lag("bond").over(w))})
    return base.select(
        "run_id", "date", annual_volatility("logret", 20, w).alias("vol20"), annual_volatility("logret", 60, w).alias("vol60"),
        (rolling_std("logret", 20, w) / rolling_std("logret", 250, w)).alias("vol_ratio"), bar_return("close", 20, w).alias("mom20"), bar_return("close", 120, w).alias("mom120"),
        drawdown_from_high("close", 250, w).alias("dd250"), distance_to_mean("close", 200, w).alias("ma200"), bar_return("bond", 60, w).alias("bond_mom60"),
        annual_volatility("bond_logret", 20, w).alias("bond_vol20"),
    )
