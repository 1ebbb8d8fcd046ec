"""Window functions over a security's own bars. A lookback counts bars, not days; a rolling statistic is null until its window is full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallystone.functions.finance import quotient
from tallystone.functions.normal import normal_cdf
from tallystone.operators.blocks import fractional_differences

YEAR = 252


def bars(key: str = "secid", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def bar_return(price: str | Column, n: int, w: WindowSpec, lag: int = 0) -> Column:
    """Return over n bars that ended `lag` bars ago; from a price of zero it is infinite, or NaN to zero."""
    c = F.col(price) if isinstance(price, str) else price
    last = F.lag(c, lag).over(w) if lag else c
    return quotient(last, F.lag(c, lag + n).over(w)) - 1


def full(value: Column, of: Column, n: int, w: WindowSpec) -> Column:
    """value over the last n bars, null unless all n are known."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(of).over(frame) == n, value.over(frame))


def log_return(price: str, w: WindowSpec) -> Column:
    return F.log(F.col(price) / F.lag(price).over(w))


def with_returns(df: DataFrame, price: str = "close") -> DataFrame:
    """ret and logret of each bar; windows can't be nested, so rolling statistics of returns need them as columns first."""
    w = bars()
    return df.withColumns({"ret": bar_return(price, 1, w), "logret": log_return(price, w)})


def rolling_std(column: str, n: int, w: WindowSpec) -> Column:
    return full(F.stddev_samp(column), F.col(column), n, w)


def rolling_mean(column: str, n: int, w: WindowSpec) -> Column:
    return full(F.avg(column), F.col(column), n, w)


def rolling_max(column: str, n: int, w: WindowSpec) -> Column:
    return full(F.max(column), F.col(column), n, w)


def annual_volatility(column: str, n: int, w: WindowSpec) -> Column:
    return rolling_std(column, n, w) * math.sqrt(YEAR)


def distance_to_mean(price: str, n: int, w: WindowSpec) -> Column:
    return F.col(price) / rolling_mean(price, n, w) - 1


def drawdown_from_high(price: str, n: int, w: WindowSpec) -> Column:
    return F.col(price) / rolling_max(price, n, w) - 1


def running_peak(price: str, w: WindowSpec) -> Column:
    return F.max(price).over(w.rowsBetween(Window.unboundedPreceding, 0))


def forward_drawdown_label(price: str, horizon: int, depth: float, w: WindowSpec) -> Column:
    """1 if the lowest of the next `horizon` prices is `depth` or more below this one, else 0; null where fewer follow."""
    ahead = w.rowsBetween(1, horizon)
    return F.when(F.count(price).over(ahead) == horizon, (F.min(price).over(ahead) / F.col(price) - 1 <= -depth).cast("int"))


def ewm_volatility(df: DataFrame, span: int = 20, price: str = "close", key: str = "secid", order: str = "date") -> DataFrame:
    """(key, order, ewm_std): exponentially weighted, bias-corrected deviation of returns; gaps in the price are carried over first.

    Decayed sums of weights, squared weights and the first two moments. Bars are dealt in blocks as long as a weight takes to fall below a double's precision; a block's sums are
    its own running ones and, decayed, those that the block before it ends with, which stand before its first bar. What came before that weighs nothing, unless it is
    infinite or NaN, as after a price of zero: from there on the deviation is NaN.
    """
    d = 1 - 2 / (span + 1)
    block = math.ceil(40 / -math.log(d))
    w = bars(key, order)
    filled = df.select(key, order, F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"), (F.row_number().over(w) - 1).alias("_i"))
    rows = filled.select(key, order, F.floor(F.col("_i") / block).alias("_block"), (F.col("_i") % block).alias("_q"), bar_return("_p", 1, w).alias("_r"))
    odd = F.max(F.col("_r").isin(math.inf, -math.inf, math.nan)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_r", F.when(odd, math.nan).otherwise(F.col("_r")))  # in every block after it, too
    known = F.col("_r").isNotNull()
    parts = {"_s1": F.when(known, 1.0), "_s2": F.when(known, 1.0), "_x": F.col("_r"), "_xx": F.col("_r") * F.col("_r"), "_n": known.cast("double")}
    rows = rows.select(key, order, "_block", "_q", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in parts.items()])
    left = F.lit(block) - F.col("_q")  # bars from here to the first of the next block
    decayed = lambda n, by: F.pow(F.lit(d), (2 if n == "_s2" else 0 if n == "_n" else 1) * by)
    ends = rows.groupBy(key, (F.col("_block") + 1).alias("_block")).agg(*[F.sum(F.col(n) * decayed(n, left)).alias(n) for n in parts])
    both = rows.unionByName(ends.withColumn("_q", F.lit(-1)), allowMissingColumns=True)
    upto = Window.partitionBy(key, "_block").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    place = F.greatest("_q", F.lit(0))
    sums = both.select(key, order, "_q", *[(F.sum(F.col(n) * decayed(n, -place)).over(upto) * decayed(n, place)).alias(n) for n in parts]).where("_q >= 0")
    variance = F.greatest(F.col("_xx") / F.col("_s1") - F.pow(F.col("_x") / F.col("_s1"), F.lit(2)), F.lit(0.0))
    bias = F.col("_s1") * F.col("_s1") / (F.col("_s1") * F.col("_s1") - F.col("_s2"))
    return sums.select(key, order, F.when(F.col("_n") > 1, F.sqrt(variance * bias)).alias("ewm_std"))


def weekly_hold(df: DataFrame, signal: str, key: str, order: str = "date") -> Column:
    """The signal of the last traded day of its week (Monday to Sunday), held until the next one; null before the first."""
    week = Window.partitionBy(key, F.date_trunc("week", order))
    kept = F.when(F.col(order) == F.max(order).over(week), F.col(signal))
    return kept


def hold_weekly(df: DataFrame, signal: str, out: str, key: str = "secid", order: str = "date") -> DataFrame:
    marked = df.withColumn("_kept", weekly_hold(df, signal, key, order))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.last("_kept", ignorenulls=True).over(w)).drop("_kept")


def fraction_weights(d: float, threshold: float = 1e-3, most: int = 10_000) -> list[float]:
    """Weights of a fractional difference of order d, cut where they fall below the threshold."""
    weights = [1.0]
    while len(weights) < most:
        k = len(weights)
        w = -weights[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            break
        weights.append(w)
    return weights


def fractional_difference(df: DataFrame, column: str, d: float, out: str, threshold: float = 1e-3, key: str = "secid", order: str = "date") -> DataFrame:
    """(key, order, out): weighted sum of this and earlier values; null while the window isn't full or holds a null."""
    return fractional_differences(df, column, {out: fraction_weights(d, threshold)}, key, order)


def _adf_p_value(t: Column) -> Column:
    """Approximate p-value of an augmented Dickey-Fuller statistic with a constant, by MacKinnon's response surface (1994)."""
    #: Fixed values of the published surface: bounds, and polynomials left and right of the break.
    low, high, split = -18.83, 2.74, -1.61
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)

    def at(poly: tuple[float, ...]) -> Column:
        total = F.lit(0.0)
        for c in reversed(poly):
            total = total * t + c
        return total

    return F.when(t > high, 1.0).when(t < low, 0.0).otherwise(normal_cdf(F.when(t <= split, at(small)).otherwise(at(large))))


def adf_p_values(df: DataFrame, column: str, key: str | list[str] = "secid", order: str = "date") -> DataFrame:
    """(key, n, p_value) of a Dickey-Fuller test with a constant and one lag; null with fewer than 20 values, or where the regression leaves nothing. The regression of each
    step on the level before it and on the step before has two slopes, so that five covariances solve it in closed form."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(order)
    known = df.where(F.col(column).isNotNull())
    steps = known.select(*keys, order, F.lag(column).over(w).alias("level"), (F.col(column) - F.lag(column).over(w)).alias("diff"))
    steps = steps.withColumn("before", F.lag("diff").over(w))
    use = F.col("before").isNotNull()
    x, b, y = (F.when(use, F.col(c)) for c in ("level", "before", "diff"))
    m = F.count(F.when(use, F.lit(1)))
    both = lambda one, two: F.covar_pop(one, two) * m
    sums = steps.groupBy(*keys).agg(F.count("*").alias("n"), m.alias("m"), both(x, x).alias("xx"), both(b, b).alias("bb"), both(x, b).alias("xb"), both(x, y).alias("xy"), both(b, y).alias("by"), both(y, y).alias("yy"))
    det = F.col("xx") * F.col("bb") - F.col("xb") ** 2
    slope, other = (F.col("xy") * F.col("bb") - F.col("by") * F.col("xb")) / det, (F.col("by") * F.col("xx") - F.col("xy") * F.col("xb")) / det
    rest = (F.col("yy") - slope * F.col("xy") - other * F.col("by")) / (F.col("m") - 3)
    fine = (F.col("n") >= 20) & (det > 0) & (rest > 0)
    statistic = F.when(fine, slope / F.sqrt(rest * F.col("bb") / det))
    return sums.withColumn("t", statistic).select(*keys, "n", F.when(F.col("t").isNotNull(), _adf_p_value(F.col("t"))).alias("p_value"))


def least_stationary_order(df: DataFrame, column: str, key: str = "secid", order: str = "date", p_limit: float = 0.05) -> DataFrame:
    """(key, d): the least order on the grid 0, 0.1, ..., 1 whose fractional difference is stationary; null if none is. One pass over blocks of bars differences by all orders."""
    weights = {f"_d{step}": fraction_weights(step / 10) for step in range(11)}
    differenced = fractional_differences(df, column, weights, key, order)
    each = F.array(*[F.struct(F.lit(i / 10).alias("d"), F.col(n).alias("x")) for i, n in enumerate(weights)])
    differenced = differenced.select(key, order, F.explode(each).alias("_e")).select(key, order, "_e.d", F.col("_e.x").alias("_x"))
    found = adf_p_values(differenced, "_x", [key, "d"], order)
    return df.select(key).distinct().join(found.where(F.col("p_value") < p_limit).groupBy(key).agg(F.min("d").alias("d")), key, "left")
