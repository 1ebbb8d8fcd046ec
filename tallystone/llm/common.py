"""Helpers that the operators of this subpackage share: document views and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a Python worker holds as Python strings at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else; a null text is the empty one. Other columns of the caller can't clash with an operator's."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that no slice of several rows has more than SLICE_BYTES in the column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > SLICE_BYTES and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def with_id(df: DataFrame, schema: str, id_col: str = "doc_id") -> StructType:
    """The schema of an operator's rows: the id column of df, of whatever type, then those of `schema`. No DDL text is made of the caller's names."""
    return StructType([df.schema[id_col], *StructType.fromDDL(schema).fields])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def hand_back() -> None:
    """What a task has freed goes back to the system. Workers outlive tasks, and the allocators of C and Arrow would keep it for each of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library is glibc
    if trim:
        trim(0)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], schema: str, keep_text: bool = False) -> DataFrame:
    """(doc_id, text) to doc_id, the text itself if keep_text, and the columns of `schema`.

    make() runs once in each task and gives a function from a list of texts to the arrays of those columns.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for part in slices(batches):
            work = work or make()
            passed = [part.column(x) for x in held]
            yield pa.RecordBatch.from_arrays([*passed, *work(part.column("text").to_pylist())], [*held, *names])
        work = part = passed = None
        hand_back()

    held = ["doc_id", "text"] if keep_text else ["doc_id"]
    return df.select("doc_id", "text").mapInArrow(run, with_id(df, ("text string, " if keep_text else "") + schema))


class Memo(dict):
    """A bounded memo: a missing key is computed by `make`. When it holds `limit` keys they become the old generation, from which keys that are asked for again come
    back, and the one before is dropped; so frequent keys stay. Workers outlive tasks, and so do memos of models that they keep: some 200 bytes for each of 2 * limit keys.
    A process keeps one memo: where another meets a new key, as a worker has gone on to the next operator, the last one is emptied."""

    latest: Memo | None = None

    def __init__(self, make: Callable, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if Memo.latest is not self:
            if Memo.latest is not None:
                Memo.latest.clear()
                Memo.latest.old = {}
            Memo.latest = self
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
