"""Remote tables as a Spark data source: pages of {table: {columns, data}} JSON are read by executors, one partition for each page where the total is known.

    spark.dataSource.register(PagedTable)
    spark.read.format("paged_table").schema("SECID string, LOTSIZE int").options(url=..., table="securities").load()

The transport is a function path(url, params) -> text, named `module:function`, so that tests and mirrors need no network.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class RemoteError(Exception):
    pass


def http_get(url: str, params: dict) -> str:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=40) as r:
        return r.read().decode()


class Patient:
    """Calls a transport with a pause before each call, and again after server errors, ever later."""

    def __init__(self, transport: Callable[[str, dict], str], pause: float = 0.0, tries: int = 4, first_wait: float = 1.0, also: tuple[int, ...] = (), sleep=time.sleep):
        self.transport, self.pause, self.tries, self.wait, self.also, self.sleep = transport, pause, tries, first_wait, also, sleep

    def __call__(self, url: str, params: dict) -> str:
        for turn in range(self.tries):
            if self.pause:
                self.sleep(self.pause)
            try:
                return self.transport(url, params)
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code not in self.also:
                    raise RemoteError(f"{url}: status {e.code}") from e
                last: Exception = e
            except OSError as e:
                last = e
            if turn + 1 < self.tries:
                self.sleep(self.wait * 2**turn)
        raise RemoteError(f"{url}: no answer after {self.tries} tries") from last


def rows_of(text: str, table: str) -> tuple[list[dict], dict | None]:
    """The table's rows, and its cursor (INDEX, TOTAL, PAGESIZE) if the answer has one."""
    body = json.loads(text)
    if table not in body:
        raise RemoteError(f"the answer has no table {table!r}")
    rows = [dict(zip(body[table]["columns"], r, strict=True)) for r in body[table]["data"]]
    cursor = body.get(f"{table}.cursor")
    return rows, dict(zip(cursor["columns"], cursor["data"][0], strict=True)) if cursor and cursor["data"] else None


class Page(InputPartition):
    def __init__(self, start: int, follow: bool):
        super().__init__(start)
        self.start, self.follow = start, follow


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.url, self.table = options["url"], options["table"]
        self.params = json.loads(options.get("params", "{}"))
        self.pause, self.tries = float(options.get("pause", 0)), int(options.get("tries", 4))
        self.transport = options.get("transport", f"{__name__}:http_get")

    def _get(self, start: int) -> tuple[list[dict], dict | None]:
        module, _, name = self.transport.partition(":")
        return rows_of(Patient(getattr(importlib.import_module(module), name), self.pause, self.tries, first_wait=0.5)(self.url, {**self.params, "start": start}), self.table)

    def partitions(self) -> list[InputPartition]:
        """A partition for each page if the first answer's cursor has the total; else one that follows the pages, as a rate limit wants."""
        _, cursor = self._get(0)
        if cursor and self.pause == 0:
            return [Page(s, False) for s in range(0, max(int(cursor["TOTAL"]), 1), int(cursor["PAGESIZE"]))]
        return [Page(0, True)]

    def read(self, partition: Page) -> Iterator[tuple]:
        start = partition.start
        while True:
            rows, cursor = self._get(start)
            yield from (tuple(r.get(n) for n in self.names) for r in rows)
            if not partition.follow or not rows or cursor and start + len(rows) >= int(cursor["TOTAL"]):
                return
            start += len(rows)


class PagedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def schema(self) -> str:
        raise RemoteError("give a schema: only its columns are kept")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


#: Where an exchange's tables are, by the kind of series (fixed values of the source's interface).
PATHS = {
    "share": "/engines/stock/markets/shares/boards/{board}/securities/{name}/candles.json",
    "index": "/engines/stock/markets/index/boards/{board}/securities/{name}/candles.json",
    "currency": "/engines/currency/markets/selt/boards/{board}/securities/{name}/candles.json",
    "trades": "/history/engines/stock/markets/shares/boards/{board}/securities/{name}.json",
    "composition": "/statistics/engines/stock/markets/index/analytics/{name}.json",
}
#: The boards that are asked where none is named (fixed values of the source's interface).
BOARDS = {"share": "TQBR", "index": "SNDX", "currency": "CETS", "trades": "TQBR", "composition": ""}
CANDLE_COLUMNS = "begin string, open double, high double, low double, close double, value double, volume double"


class Exchange:
    """Tables of one exchange. The days that are wanted go to the source with each request, and only the columns of the schema are kept, so nothing else is sent or
    read; pages are read by executors."""

    def __init__(self, spark: SparkSession, base: str, **options: str):
        spark.dataSource.register(PagedTable)
        self.spark, self.base, self.options = spark, base.rstrip("/"), options

    def table(self, kind: str, name: str, table: str, schema: str, params: dict, board: str | None = None) -> DataFrame:
        url = self.base + PATHS[kind].format(board=board or BOARDS[kind], name=name)
        return self.spark.read.format("paged_table").schema(schema).options(url=url, table=table, params=json.dumps(params), **self.options).load()

    def candles(self, kind: str, name: str, first: str, last: str, board: str | None = None) -> DataFrame:
        """Daily candles of a share, an index or a currency from the first day to the last."""
        raw = self.table(kind, name, "candles", CANDLE_COLUMNS, {"from": first, "till": last, "interval": 24}, board)
        return exchange_candles(raw.withColumn("SECID", F.lit(name)))

    def trades(self, name: str, first: str, last: str, schema: str, board: str | None = None) -> DataFrame:
        return self.table("trades", name, "history", schema, {"from": first, "till": last}, board)

    def composition(self, index: str, day: str) -> DataFrame:
        """(snapshot_date, secid) of an index on a day."""
        raw = self.table("composition", index, "analytics", "ticker string", {"date": day, "limit": 100})
        return raw.select(F.lit(day).cast("date").alias("snapshot_date"), F.upper("ticker").alias("secid")).where("secid is not null").distinct()


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order given; keep-first and keep-last sources differ in that."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lot_sizes(securities: DataFrame) -> DataFrame:
    """(secid, lot) of a securities table; one without a lot size column is an error."""
    if "LOTSIZE" not in securities.columns:
        raise RemoteError("the securities table has no LOTSIZE column")
    return securities.select(F.col("SECID").alias("secid"), F.col("LOTSIZE").cast("int").alias("lot")).where("lot is not null")


def exchange_candles(raw: DataFrame) -> DataFrame:
    """Candles of an exchange's table (SECID, begin, open, ...), dates normalised, only the columns of the candle schema."""
    return raw.select(F.col("SECID").alias("secid"), F.to_date("begin").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "value", "volume")])


def index_history(raw: DataFrame) -> DataFrame:
    """(date, close) of an index table (TRADEDATE, CLOSE, seq): positive closes, of equal dates the last row."""
    known = raw.select(F.to_date("TRADEDATE").alias("date"), F.col("CLOSE").cast("double").alias("close"), "seq").where("date is not null and close > 0")
    return latest_by(known, ["date"], [F.desc("seq")]).drop("seq")


def array_candles(raw: DataFrame, column: str = "body") -> DataFrame:
    """Candles of JSON arrays [[ms, open, close, high, low, volume], ...] (mind the order); value is volume times close; of equal dates the first."""
    rows = raw.select("secid", F.posexplode(F.from_json(column, "array<array<double>>")).alias("pos", "r"))
    at = lambda i: F.col("r")[i]
    named = rows.select(
        "secid", "pos", F.timestamp_millis(at(0).cast("long")).cast("date").alias("date"), at(1).alias("open"), at(3).alias("high"), at(4).alias("low"), at(2).alias("close"), (at(5) * at(2)).alias("value"), at(5).alias("volume")
    )
    return latest_by(named, ["secid", "date"], [F.asc("pos")]).drop("pos")
