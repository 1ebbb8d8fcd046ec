"""The append-only ledger of runs, and text, JSON and CSV sinks.

A run's hash covers configuration, data version and hypothesis, so the same run again is the same row: all rows are kept, the newest of a hash counts.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "run_hash string, created_at timestamp, source string, hypothesis string, config_hash string, data_hash string, params string, metrics string"
SOURCES = ("human", "grid", "model")


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, runs: list[dict]) -> list[str]:
        """Appends runs (hypothesis, source, params, data_hash, metrics) and gives their hashes."""
        rows = []
        for r in runs:
            if not r["hypothesis"].strip():
                raise ValueError("a run needs a hypothesis")
            if r["source"] not in SOURCES:
                raise ValueError(f"no such source: {r['source']}")
            config = digest(r["params"])
            rows.append(
                (digest([config, r["data_hash"], r["hypothesis"]]), datetime.now(UTC).replace(tzinfo=None), r["source"], r["hypothesis"], config, r["data_hash"],
                 json.dumps(r["params"], sort_keys=True, default=str), json.dumps(r["metrics"], sort_keys=True, default=str))
            )
        self.spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(self.path)
        return [r[0] for r in rows]

    def all_rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def runs(self) -> DataFrame:
        return newest(self.all_rows())

    def get(self, run_hash: str) -> DataFrame:
        return self.runs().where(F.col("run_hash") == run_hash)


def newest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_hash").orderBy(F.desc("created_at"), "params")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summary(runs: DataFrame, metric: str = "annual_return", many: int = 10) -> DataFrame:
    """(n_runs, best, median, too_many): the best never stands without the median; above `many` runs it is likely luck."""
    value = F.get_json_object("metrics", f"$.{metric}").cast("double")
    known = runs.select(value.alias("v"))
    return known.agg(F.count("*").alias("n_runs"), F.max("v").alias("best"), F.percentile("v", 0.5).alias("median"), (F.count("*") > many).alias("too_many"))


def write_lines(df: DataFrame, path: str, columns: list[str]) -> None:
    """A text line for each row, its columns parted by two spaces."""
    df.select(F.concat_ws("  ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("append").text(path)


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a table that is as short as its months."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
