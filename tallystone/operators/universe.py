"""Index membership: a schedule of snapshots from daily compositions, and the universe of a date with its limitation said aloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schedule(compositions: DataFrame, start: str, end: str, probe_days: int = 7) -> DataFrame:
    """(snapshot_date, secid): for each month the composition (date, secid) of its first day that has one, within so many days of the month's start."""
    named = compositions.where("secid is not null").select("date", F.upper("secid").alias("secid")).distinct()
    inside = named.where(F.col("date").between(F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), probe_days)) & (F.dayofmonth("date") <= probe_days))
    first = inside.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date"))
    return inside.join(first, "date").where(F.col("month").between(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"))).select(F.col("date").alias("snapshot_date"), "secid")


def on_date(compositions: DataFrame, date: str, whitelist: DataFrame) -> DataFrame:
    """(secid, from_index, limitation): the white list within the index at the date; all of it, with the limitation, where no composition is known."""
    known = compositions.where(F.col("date") == F.lit(date).cast("date")).select(F.upper("secid").alias("secid")).distinct()
    some = not known.isEmpty()
    listed = whitelist.select(F.upper("secid").alias("secid")).distinct()
    kept = listed.join(known, "secid", "left_semi") if some else listed
    limitation = None if some else "no composition is known for the date: the whole list is used"
    return kept.select("secid", F.lit(some).alias("from_index"), F.lit(limitation).cast("string").alias("limitation"))


def membership_stats(snapshots: DataFrame) -> DataFrame:
    """(n_snapshots, least, most, n_ever) of a schedule."""
    sizes = snapshots.groupBy("snapshot_date").agg(F.count("*").alias("n"))
    ever = snapshots.groupBy("secid").agg(F.count("*").alias("m"))
    both = sizes.select("n", F.lit(None).cast("long").alias("m")).unionByName(ever.select(F.lit(None).cast("long").alias("n"), "m"))
    return both.agg(F.count("n").alias("n_snapshots"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("m").alias("n_ever"))
