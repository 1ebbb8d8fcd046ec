"""As-of joins: each left row gets the last right row at or before its time (or the first at or after it), by union and fill, in one shuffle by key and month.

Ties on the right are settled by `tie`; a right row whose value is null still counts as the last one. A left row without a match gets nulls.
Only availability times are joined on: `feature_asof` adds the mandatory lag, and `forbid_event_time_join` refuses a join on event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LookAheadError(Exception):
    """A join would show a value before it was known."""


def forbid_event_time_join(*_: object) -> None:
    raise LookAheadError("features are joined by the time they became available, not by event time: use feature_asof")


def _merged(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: Column | None, forward: bool) -> DataFrame:
    """Rows meet by key and month. What a month begins (forward: ends) with comes from the key's other months' own last (first) right rows, one for each month, and stands before
    (after) its rows; so a key with many rows is spread over its months."""
    if not keys:
        raise ValueError("an as-of join needs keys; a step function without any goes through step_lookup")
    in_time = lambda df, ts: _month(ts) if df.schema[ts].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.lit(0)
    a = left.select(*keys, in_time(left, left_ts).alias("_m"), F.col(left_ts).alias("_ts"), F.lit(1 - 2 * forward).alias("_side"), F.lit(None).alias("_tie"), F.struct(*left.columns).alias("_row"))
    held = right.select(*keys, in_time(right, right_ts).alias("_m"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), (F.lit(None) if tie is None else tie).alias("_tie"), F.struct(*values).alias("_found"))
    both = a.unionByName(held, allowMissingColumns=True)
    order = F.when(F.col("_found").isNotNull(), F.struct("_ts", "_tie"))
    months = both.select(*keys, "_m", "_ts", "_tie", "_found").groupBy(*keys, "_m").agg((F.min_by if forward else F.max_by)("_found", order).alias("_found"))
    line = Window.partitionBy(*keys).orderBy("_m")  # a row for each month
    frame = line.rowsBetween(1, Window.unboundedFollowing) if forward else line.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.first if forward else F.last
    carried = months.select(*keys, "_m", pick("_found", ignorenulls=True).over(frame).alias("_found")).where("_found is not null").withColumn("_edge", F.lit(1 if forward else -1))
    both = both.withColumn("_edge", F.lit(0)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_m").orderBy("_edge", "_ts", "_side", "_tie")
    w = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_found", pick("_found", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: Column | None = None) -> DataFrame:
    """The last right row with right_ts <= left_ts. Keys are needed: without them, `step_lookup` is the way."""
    return _merged(left, right, keys, left_ts, right_ts, values, tie, False)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: Column | None = None) -> DataFrame:
    """The first right row with right_ts >= left_ts."""
    return _merged(left, right, keys, left_ts, right_ts, values, tie, True)


def feature_asof(requests: DataFrame, feature: DataFrame, lag_days: int, keys: list[str]) -> DataFrame:
    """requests (keys, ts) with the feature's (keys, event_ts, value) that was available: event_ts + lag <= ts."""
    available = feature.withColumn("avail_ts", F.date_add("event_ts", lag_days))
    return asof_backward(requests, available, keys, "ts", "avail_ts", ["event_ts", "value"], F.col("event_ts"))


def _month(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.year(c) * 12 + F.month(c)


def _carried(times: DataFrame, steps: DataFrame, strictly: bool) -> DataFrame:
    """(ts, _found, _first) of times (ts): the last of steps (ts, _value) at or before (strictly: before) each, as a struct of one, and the first of all.

    Steps and times meet month by month; what a month begins with and the first step of all come from the months' own last and first steps, one row for each month of the
    calendar, so that no task sees more than a month's times.
    """
    held = steps.select(_month("ts").alias("_m"), "ts", F.struct("_value").alias("_step"))
    months = held.groupBy("_m").agg(F.max_by("_step", "ts").alias("_last"), F.min_by("_step", "ts").alias("_begin"))
    asked = times.select(_month("ts").alias("_m")).distinct().join(months, "_m", "full")
    line = Window.partitionBy(F.lit(0)).orderBy("_m")  # a row for each month
    before = F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_begin", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    asked = asked.select("_m", before.alias("_before"), first.alias("_first"))
    both = held.select("_m", "ts", "_step", F.lit(1 if strictly else 0).alias("_side"), F.lit(False).alias("_asked"))
    both = both.unionByName(times.select(_month("ts").alias("_m"), "ts", F.lit(None).cast(held.schema["_step"].dataType).alias("_step"), F.lit(0 if strictly else 1).alias("_side"), F.lit(True).alias("_asked")))
    w = Window.partitionBy("_m").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_found", F.last("_step", ignorenulls=True).over(w)).where("_asked")
    return filled.join(asked, "_m").select("ts", F.coalesce("_found", "_before").alias("_found"), "_first")


def step_lookup(df: DataFrame, ts: str, steps: DataFrame, step_ts: str, value: str, before_first: str = "null") -> DataFrame:
    """df with the value of a step function at its time.

    before_first: `null`, `first` (the first known value) or `zero`, for times before the first step; consumers differ in this, so it is a parameter. The
    value is found once for each distinct time and joined back by it, so that df itself is never sorted or joined by a range.
    """
    times = df.where(F.col(ts).isNotNull()).select(F.col(ts).alias("ts")).distinct()
    found = _carried(times, steps.select(F.col(step_ts).alias("ts"), F.col(value).alias("_value")), False)
    known = F.col("_found._value")
    # where a step was found its value counts, even if it is null
    if before_first == "zero":
        filled: Column = F.coalesce(known, F.lit(0.0))
    elif before_first == "first":
        filled = F.coalesce(known, F.col("_first._value"))
    else:
        filled = known
    found = found.select(F.col("ts").alias("_at"), filled.alias("_value"))
    out = df.join(found, F.col(ts) == F.col("_at"), "left")
    unknown = F.lit(0.0) if before_first == "zero" else F.lit(None)
    return out.select(*[df[c] for c in df.columns], (F.coalesce("_value", unknown) if before_first == "zero" else F.col("_value")).alias(value))


def step_before(steps: DataFrame, ts: str, value: str) -> DataFrame:
    """(ts, before): the value of the step before each time of a step function, null at the first."""
    found = _carried(steps.select(F.col(ts).alias("ts")).distinct(), steps.select(F.col(ts).alias("ts"), F.col(value).alias("_value")), True)
    return found.select(F.col("ts").alias(ts), F.col("_found._value").alias("before"))


def members_asof(df: DataFrame, ts: str, snapshots: DataFrame) -> DataFrame:
    """Rows of df (secid, ts) that were members at that time: snapshots are (snapshot_date, secid). Names that begin with `_` are service
    series and always seen; before the first snapshot nothing else is."""
    dates = snapshots.select("snapshot_date").distinct().withColumn("snap", F.col("snapshot_date"))
    dated = step_lookup(df, ts, dates, "snapshot_date", "snap")
    member = snapshots.select(F.col("snapshot_date").alias("snap"), "secid").distinct()
    service = dated.where(F.col("secid").startswith("_"))
    return dated.where(~F.col("secid").startswith("_")).join(member, ["snap", "secid"], "left_semi").unionByName(service).drop("snap")


def ex_dates(dividends: DataFrame, calendar: DataFrame, next_day_from: str = "2023-07-31") -> DataFrame:
    """Ex-dates of dividends (secid, record_date, amount, last_day_with_rights) on a trading calendar (date).

    With an explicit last day of rights, the first trading day after it; else, counted back from the record date's trading day, the settlement lag (1 from
    next_day_from on, else 2) less one. Dates outside the calendar or on its first day are dropped; equal (secid, ex_date, amount) once.
    """
    days = calendar.select("date").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # trading days
    asked = F.coalesce("last_day_with_rights", "record_date")
    lag = F.when(F.col("record_date") >= F.to_date(F.lit(next_day_from)), 1).otherwise(2)
    placed = step_lookup(dividends.withColumn("_asked", asked), "_asked", days, "date", "pos")
    last = F.coalesce("pos", F.lit(-1))
    at = F.when(F.col("last_day_with_rights").isNotNull(), last + 1).otherwise(last - lag + 1)
    out = placed.select("secid", "amount", "record_date", at.alias("pos")).where("pos > 0").join(days, "pos")
    w = Window.partitionBy("secid", "date", "amount").orderBy("record_date")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("secid", F.col("date").alias("ex_date"), "amount", "record_date")


def within_span(events: DataFrame, candles: DataFrame, date: str = "record_date", with_first: bool = False) -> DataFrame:
    """events (secid, date) inside their security's own traded span: after its first day, or on it if with_first, up to its last."""
    span = candles.groupBy("secid").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    begun = F.col(date) >= F.col("_lo") if with_first else F.col(date) > F.col("_lo")
    return events.join(span, "secid").where(begun & (F.col(date) <= F.col("_hi"))).select(*events.columns)


def plausible_dividends(ex: DataFrame, candles: DataFrame, low: float = 0.0005, high: float = 0.35) -> DataFrame:
    """ex with ratio (amount to the close before the ex-date) and kept: the ratio is within limits, or it is above them and the open fell by at
    least half the amount. Without an earlier close a dividend is not kept."""
    before = asof_backward(ex.withColumn("_prev", F.date_sub("ex_date", 1)), candles.select("secid", "date", F.col("close").alias("prev_close")), ["secid"], "_prev", "date", ["prev_close"])
    both = asof_forward(before.drop("_prev"), candles.select("secid", "date", F.col("open").alias("next_open")), ["secid"], "ex_date", "date", ["next_open"])
    ratio = F.col("amount") / F.col("prev_close")
    fell = (F.col("prev_close") - F.col("next_open")) >= 0.5 * F.col("amount")
    kept = ratio.between(low, high) | ((ratio > high) & F.coalesce(fell, F.lit(False)))
    return both.select("secid", "ex_date", "amount", ratio.alias("ratio"), F.coalesce(kept, F.lit(False)).alias("kept"))
