"""Walk-forward search as set operations: windows, grids, the choice of each window's best parameters on its training metric, and what all of them made
out of sample. The equity curves that it judges come from the caller; no account is simulated here."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_PARAMETERS, RUIN = 3, 1e-6


class TooManyParameters(Exception):
    """Each parameter more multiplies the chance of a lucky fit."""


def grid(parameters: dict[str, list]) -> list[dict]:
    if len(parameters) > MOST_PARAMETERS:
        raise TooManyParameters(f"{len(parameters)} parameters, at most {MOST_PARAMETERS}")
    names = sorted(parameters)
    return [dict(zip(names, values, strict=True)) for values in product(*(parameters[n] for n in names))]


def year_windows(spark: SparkSession, first: int, last: int, train: int = 4, test: int = 1) -> DataFrame:
    """(window, train_from, train_to, test_from, test_to): training years, then test years, moved on by the test years."""
    starts = [y for y in range(first, last - train - test + 2, test)]
    years = spark.createDataFrame([(i, y) for i, y in enumerate(starts)], "window int, y int")
    day = lambda year, rest: F.to_date(F.concat(year.cast("string"), F.lit(rest)))
    y = F.col("y")
    return years.select("window", day(y, "-01-01").alias("train_from"), day(y + train - 1, "-12-31").alias("train_to"), day(y + train, "-01-01").alias("test_from"), day(y + train + test - 1, "-12-31").alias("test_to"))


def window_returns(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, config, phase, date, ret) of returns (config, date, ret): every row once for each window and phase that it lies in.

    Windows begin and end with years, so a window is a few rows of (year, window, phase), and rows meet them by their year.
    """
    spans = None
    for phase in ("train", "test"):
        years = F.explode(F.sequence(F.year(f"{phase}_from"), F.year(f"{phase}_to")))
        part = windows.select("window", F.lit(phase).alias("phase"), years.alias("year"))
        spans = part if spans is None else spans.unionByName(part)
    return returns.withColumn("year", F.year("date")).join(spans, "year").select("window", "config", "phase", "date", "ret")


def window_results(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, config, phase, log_growth, sharpe, n) of daily returns (config, date, ret). The logarithm holds growth of any size; a day
    that loses everything or more leaves RUIN of it."""
    sd = F.stddev_samp("ret")
    return window_returns(returns, windows).where("ret is not null").groupBy("window", "config", "phase").agg(
        F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(RUIN)))).alias("log_growth"), F.when(sd > 0, F.avg("ret") / sd).alias("sharpe"), F.count("*").alias("n")
    )


def choose(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """(window, config, metric): the greatest training metric, unknown ones last, ties to the least config."""
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc_nulls_last(metric), "config"))
    return results.where("phase = 'train'").withColumn("place", place).where("place = 1").select("window", "config", F.col(metric).alias("metric"))


def out_of_sample(returns: DataFrame, windows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(date, window, config, ret) of the chosen configs in their test windows; of two windows' equal dates the later one's."""
    tests = window_returns(returns, windows).where("phase = 'test'").join(chosen.select("window", "config"), ["window", "config"])
    latest = F.max_by(F.struct("window", "config", "ret"), "window").alias("row")
    return tests.groupBy("date").agg(latest).select("date", "row.*")


def config_results(results: DataFrame, windows: DataFrame) -> DataFrame:
    """(config, annual, log_annual): growth over all test windows a year of their calendar length, and its logarithm."""
    spans = windows.select("window", F.date_diff("test_to", "test_from").alias("days"))
    out = results.where("phase = 'test'").join(spans, "window").groupBy("config").agg(F.sum("log_growth").alias("total"), F.sum("days").alias("days"))
    yearly = F.col("total") * 365.25 / F.col("days")
    return out.select("config", F.expm1(yearly).alias("annual"), yearly.alias("log_annual"))


def best_and_median(annual: DataFrame, column: str = "annual") -> DataFrame:
    return annual.where(F.col(column).isNotNull()).agg(F.max(column).alias("best"), F.percentile(column, 0.5).alias("median"), F.count("*").alias("n"))
