"""Metrics of equity curves, fills and rate series. Equity is (run_id, date, equity)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.normal import normal_cdf, normal_quantile
from tallystone.operators.asof import step_lookup

YEAR = 252
#: Euler and Mascheroni's constant (fixed value).
GAMMA = 0.5772156649015329


def annualised(factor: Column, days: Column) -> Column:
    """Growth a year of 365.25 days; null if there is no time or no positive factor."""
    return F.when((days > 0) & (factor > 0), F.pow(factor, F.lit(365.25) / days) - 1)


def drawdowns(equity: DataFrame) -> DataFrame:
    """(run_id, max_drawdown, max_drawdown_days): the longest time from the bar before the first below the peak to the first back at it, or to the end."""
    w = Window.partitionBy("run_id").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = equity.withColumn("peak", F.max("equity").over(upto)).withColumn("below", F.col("equity") < F.col("peak"))
    # a spell below the peak is named by the number of bars at a peak before it
    marked = marked.withColumns({"spell": F.count_if(~F.col("below")).over(upto), "prev": F.lag("date").over(w), "next": F.lead("date").over(w)})
    spells = marked.where("below").groupBy("run_id", "spell").agg(F.min(F.coalesce("prev", "date")).alias("from"), F.max_by(F.coalesce("next", "date"), "date").alias("to"))
    longest = spells.groupBy("run_id").agg(F.max(F.date_diff("to", "from")).alias("days"))
    depth = marked.groupBy("run_id").agg(F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"))
    return depth.join(longest, "run_id", "left").select("run_id", "max_drawdown", F.coalesce("days", F.lit(0)).cast("long").alias("max_drawdown_days"))


def equity_metrics(equity: DataFrame, risk_free: float, rates: DataFrame | None = None) -> DataFrame:
    """Per run: start and end, total and annual return, drawdown, Sharpe (mean excess over the deviation of raw returns), Sortino, Calmar.

    The excess is over the constant rate; with rates (date, rate), over the rate known at the bar before, for the days since it (over the first rate before that).
    """
    w = Window.partitionBy("run_id").orderBy("date")
    ret = F.col("equity") / F.lag("equity").over(w) - 1
    steps = equity.withColumn("ret", ret)
    if rates is None:
        steps = steps.withColumn("excess", F.col("ret") - ((1 + risk_free) ** (1 / YEAR) - 1))
    else:
        before = steps.withColumns({"_prev": F.lag("date").over(w), "_days": F.date_diff("date", F.lag("date").over(w))})
        rated = step_lookup(before, "_prev", rates.select("date", F.col("rate").alias("_rate")), "date", "_rate", "first")
        steps = rated.withColumn("excess", F.col("ret") - F.col("_rate") * F.col("_days") / 365.0)
    base = steps.groupBy("run_id").agg(
        F.min_by("equity", "date").alias("start_equity"),
        F.max_by("equity", "date").alias("end_equity"),
        F.date_diff(F.max("date"), F.min("date")).alias("days"),
        F.stddev_samp("ret").alias("std"),
        F.avg("excess").alias("mean_excess"),
        F.sqrt(F.sum(F.when(F.col("excess") < 0, F.col("excess") ** 2).otherwise(F.when(F.col("excess").isNotNull(), 0.0))) / F.count("excess")).alias("downside"),
    )
    both = base.join(drawdowns(equity), "run_id")
    growth = F.col("end_equity") / F.col("start_equity")
    annual = annualised(growth, F.col("days"))
    return both.select(
        "run_id", "start_equity", "end_equity", (growth - 1).alias("total_return"), annual.alias("annual_return"), "max_drawdown", "max_drawdown_days",
        F.when(F.col("std") > 0, F.col("mean_excess") / F.col("std") * math.sqrt(YEAR)).alias("sharpe"),
        F.when(F.col("downside") > 0, F.col("mean_excess") / F.col("downside") * math.sqrt(YEAR)).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).alias("calmar"),
    )


def fill_metrics(fills: DataFrame) -> DataFrame:
    """Per run of fills (run_id, order_value, costs, realized_pnl): trades, turnover, costs, win rate and profit factor of closing fills (null factor: no losses)."""
    won, lost = F.sum(F.when(F.col("realized_pnl") > 0, F.col("realized_pnl"))), F.sum(F.when(F.col("realized_pnl") < 0, -F.col("realized_pnl")))
    closers = F.count("realized_pnl")
    return fills.groupBy("run_id").agg(
        F.count("*").alias("n_trades"),
        F.sum("order_value").alias("turnover"),
        F.sum("costs").alias("total_costs"),
        F.when(closers > 0, F.count_if(F.col("realized_pnl") > 0) / closers).alias("win_rate"),
        F.when(F.coalesce(lost, F.lit(0.0)) > 0, F.coalesce(won, F.lit(0.0)) / lost).alias("profit_factor"),
    )


def tax_by_year(fills: DataFrame, rate: float) -> DataFrame:
    """(run_id, year, pnl, tax): realised profit of each year and its tax, none on a loss."""
    year = fills.where("realized_pnl is not null").groupBy("run_id", F.year("date").alias("year")).agg(F.sum("realized_pnl").alias("pnl"))
    return year.withColumn("tax", F.greatest("pnl", F.lit(0.0)) * rate)


def monthly(equity: DataFrame) -> DataFrame:
    """(run_id, month, equity, ret) for every month of a run's span: the month's last equity and its change on the month before, the first month's on the first equity.
    Months without bars have nulls."""
    last = equity.groupBy("run_id", F.trunc("date", "month").alias("month")).agg(F.max_by("equity", "date").alias("equity"))
    first = equity.groupBy("run_id").agg(F.min_by("equity", "date").alias("first_equity"), F.min(F.trunc("date", "month")).alias("lo"), F.max(F.trunc("date", "month")).alias("hi"))
    months = first.select("run_id", "first_equity", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("run_id").orderBy("month")
    joined = months.join(last, ["run_id", "month"], "left")
    before = F.when(F.row_number().over(w) == 1, F.col("first_equity")).otherwise(F.lag("equity").over(w))
    return joined.select("run_id", "month", "equity", (F.col("equity") / before - 1).alias("ret"))


def yearly(equity: DataFrame) -> DataFrame:
    """(run_id, year, ret): the change of a year's last equity on the last one before, the first year's on the first equity."""
    last = equity.groupBy("run_id", F.year("date").alias("year")).agg(F.max_by("equity", "date").alias("last"), F.min_by("equity", "date").alias("first"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy("run_id").orderBy("year")), F.col("first"))
    return last.select("run_id", "year", (F.col("last") / before - 1).alias("ret"))


def growth(daily_rates: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, growth, annual, mean_rate) of yearly rates, one for each calendar day, compounded over 365 days a year."""
    out = daily_rates.groupBy(key).agg(F.exp(F.sum(F.log1p(F.col("rate") / 365.0))).alias("growth"), F.avg("rate").alias("mean_rate"), F.count("*").alias("days"))
    return out.select(key, "growth", annualised(F.col("growth"), F.col("days")).alias("annual"), "mean_rate")


def money_market(rates: DataFrame, start: str, end: str, capital: float, spread: float = 0.005) -> DataFrame:
    """(end_equity, annual_return, average_rate) of a money market fund from start up to, not with, end: compounded each calendar day at the last rate (date, rate) known then, the first
    one before that, less the spread but not below nothing."""
    spark = rates.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1))).alias("date"))
    daily = step_lookup(days, "date", rates, "date", "rate", "first").select(F.lit("fund").alias("run_id"), F.greatest(F.col("rate") - spread, F.lit(0.0)).alias("rate"))
    return growth(daily).select((F.col("growth") * capital).alias("end_equity"), F.col("annual").alias("annual_return"), F.col("mean_rate").alias("average_rate"))


def buy_and_hold(prices: DataFrame) -> DataFrame:
    """Per security: total and annual return from its first close to its last."""
    factor = F.max_by("close", "date") / F.min_by("close", "date")
    out = prices.groupBy("secid").agg(factor.alias("factor"), F.date_diff(F.max("date"), F.min("date")).alias("days"))
    return out.select("secid", (F.col("factor") - 1).alias("total_return"), annualised(F.col("factor"), F.col("days")).alias("annual_return"))


def return_moments(returns: DataFrame, key: str) -> DataFrame:
    """(key, n, sharpe, skew, kurt): per-period Sharpe ratio with a sample deviation, population skewness and kurtosis (3 for a normal); null Sharpe below 3 values."""
    sd = F.stddev_samp("ret")
    return returns.where("ret is not null").groupBy(key).agg(
        F.count("*").alias("n"),
        F.when((F.count("*") >= 3) & (sd > 0), F.avg("ret") / sd).alias("sharpe"),
        F.skewness("ret").alias("skew"),
        (F.kurtosis("ret") + 3).alias("kurt"),
    )


def probabilistic_sharpe(n: Column, sharpe: Column, skew: Column, kurt: Column, against: Column | float = 0.0) -> Column:
    """Probability that the true ratio exceeds `against`; null with fewer than 3 returns."""
    spread = F.sqrt(F.greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2, F.lit(1e-12)))
    against = F.lit(against) if isinstance(against, float) else against
    return F.when((n >= 3) & sharpe.isNotNull(), normal_cdf((sharpe - against) * F.sqrt(n - 1) / spread))


def expected_best_sharpe(deviation: Column, trials: Column) -> Column:
    """The best ratio that so many worthless trials are expected to show; 0 for fewer than 2, or without a deviation."""
    best = (1 - GAMMA) * normal_quantile(1 - 1 / trials) + GAMMA * normal_quantile(1 - 1 / (trials * math.e))
    return F.when((trials >= 2) & (deviation > 0), deviation * best).otherwise(0.0)


def deflated_sharpe(moments: DataFrame) -> DataFrame:
    """(n_trials, expected_best, plain, deflated, passed) of the run with the best ratio among all runs of `return_moments`, which are first reduced to one row: the
    probabilities that its true ratio exceeds 0, and that it exceeds what the best of so many worthless runs would show."""
    best = moments.where("sharpe is not null").agg(
        F.count("*").alias("n_trials"), F.stddev_samp("sharpe").alias("deviation"), F.max_by(F.struct("n", "sharpe", "skew", "kurt"), "sharpe").alias("b")
    )
    rated = best.withColumn("expected_best", expected_best_sharpe(F.col("deviation"), F.col("n_trials")))
    of_best = (F.col("b.n"), F.col("b.sharpe"), F.col("b.skew"), F.col("b.kurt"))
    rated = rated.withColumns({"plain": probabilistic_sharpe(*of_best), "deflated": probabilistic_sharpe(*of_best, F.col("expected_best"))})
    return rated.select("n_trials", "expected_best", "plain", "deflated", F.coalesce(F.col("deflated") > 0.95, F.lit(False)).alias("passed"))


def resolution(lots: DataFrame, capital: float, max_positions: int, max_share: float) -> DataFrame:
    """How finely a capital can be split: lots (secid, lot_cost) to mean lot cost, securities whose lot fits in a position, the step of a weight, and those too dear."""
    room = capital * min(max_share, 1 / max_positions)
    return lots.agg(
        F.avg("lot_cost").alias("mean_lot_cost"),
        F.count_if(F.col("lot_cost") <= room).alias("affordable"),
        (F.min("lot_cost") / capital).alias("min_step"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("lot_cost") > room, F.col("secid")))), ",").alias("too_dear"),
    )
