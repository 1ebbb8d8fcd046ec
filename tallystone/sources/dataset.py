"""Named Parquet datasets under a root that Spark can reach, with atomic replacement, listing and version digests."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = re.compile(r"[A-Za-z0-9_.\-]+(/[A-Za-z0-9_.\-]+)*")


class Datasets:
    """A dataset is a folder of Parquet files; it exists once its _SUCCESS marker does. Paths go through Hadoop's file systems only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        if not _NAME.fullmatch(key) or ".." in key.split("/"):
            raise ValueError(f"not a dataset name: {key!r}")
        return f"{self.root}/{key}.parquet"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def has(self, key: str) -> bool:
        fs, where = self._fs(f"{self.path(key)}/_SUCCESS")
        return fs.exists(where)

    def keys(self) -> list[str]:
        fs, where = self._fs(self.root)
        if not fs.exists(where):
            return []
        found, base = [], fs.makeQualified(where).toString().rstrip("/")
        files = fs.listFiles(where, True)
        while files.hasNext():
            p = files.next().getPath().toString()
            if p.endswith(".parquet/_SUCCESS") and "/.staged-" not in p and "/.old-" not in p:
                found.append(p[len(base) + 1 : -len(".parquet/_SUCCESS")])
        return sorted(found)

    def load(self, key: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(key))

    def save(self, key: str, df: DataFrame) -> None:
        """Write beside the target, move the old dataset aside, rename, delete the old one. A write that breaks off leaves the old dataset as it was; one that
        breaks off between the two renames leaves it beside, and the next `save` or `restore` of the key brings it back."""
        staged = f"{self.root}/.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        self.restore(key)
        fs, target = self._fs(self.path(key))
        _, source = self._fs(staged)
        _, aside = self._fs(self._aside(key))
        fs.mkdirs(target.getParent())
        if fs.exists(target) and not fs.rename(target, aside):
            raise OSError(f"{self.path(key)} can't be moved aside")
        if not fs.rename(source, target):
            if fs.exists(aside):
                fs.rename(aside, target)
            raise OSError(f"{staged} can't be renamed to {self.path(key)}")
        if fs.exists(aside):
            fs.delete(aside, True)

    def _aside(self, key: str) -> str:
        return f"{self.root}/.old-{key.replace('/', '+')}"

    def restore(self, key: str) -> None:
        """Brings a dataset back that a broken save left aside, or deletes what is left of an old one."""
        fs, target = self._fs(self.path(key))
        _, aside = self._fs(self._aside(key))
        if fs.exists(aside):
            if fs.exists(target):
                fs.delete(aside, True)
            else:
                fs.rename(aside, target)

    def cached(self, key: str, fetch: Callable[[], DataFrame]) -> DataFrame:
        """The dataset, fetched and saved first if it isn't there; empty results are saved too."""
        if not self.has(key):
            self.save(key, fetch())
        return self.load(key)

    def version(self) -> str:
        """16 hex digits over all files' names and contents, read in ranges; only digests are combined."""
        files = file_digests(self.spark, self.root)
        name = F.regexp_replace("path", r"^.*?([^/]+\.parquet)/[^/]*$", "$1")
        return files.agg(_sum_of_digests(F.sha2(F.concat_ws("/", name, F.col("size").cast("string"), "digest"), 256))).first()[0]


#: Prime and base of the digest of a file: the sum of its parts' hashes times falling powers of the base.
PRIME, BASE = (1 << 127) - 1, 0x6A09E667F3BCC908B2FB1366EA957D3E


def file_digests(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, size, digest) of the files below a folder, or of one file, of any size.

    A file is read in ranges (spark.sql.files.maxPartitionBytes) as parts that end with byte 10. A range gives the number of its parts and a polynomial of their hashes;
    those of two neighbours make that of both, so the digest doesn't depend on where ranges begin. A task holds one part.
    """
    lines = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = lines.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.col("value").cast("binary").alias("part"))

    def of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, h = None, 0, 0
        out: list[tuple] = []
        for batch in batches:
            for *place, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now:
                    if now is not None:
                        out.append((*now, n, h.to_bytes(16, "big")))
                    now, n, h = place, 0, 0
                n, h = n + 1, (h * BASE + int.from_bytes(hashlib.blake2b(part, digest_size=15).digest(), "big") + 1) % PRIME
        if now is not None:
            out.append((*now, n, h.to_bytes(16, "big")))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for ranges in batch.column("ranges").to_pylist():
                h = 0
                for r in ranges:
                    h = (h * pow(BASE, r["n"], PRIME) + int.from_bytes(r["h"], "big")) % PRIME
                digests.append(f"{h:032x}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(digests, pa.string())], ["path", "size", "digest"])

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("h", pa.binary())])
    ranges = parts.mapInArrow(of_ranges, "path string, size long, start long, n long, h binary")
    # a row for each range of a file
    files = ranges.groupBy("path", "size").agg(F.sort_array(F.collect_list(F.struct("start", "n", "h"))).alias("ranges"))
    return files.mapInArrow(of_files, "path string, size long, digest string")


def _sum_of_digests(digest: Column) -> Column:
    """16 hex digits of a set of digests in any order: of the sums of their four quarters, so that no task gathers them."""
    quarters = [F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
    return F.substring(F.sha2(F.concat_ws("/", *quarters), 256), 1, 16)


def logical_version(df: DataFrame) -> DataFrame:
    """(n_rows, digest) of a frame's rows whatever their order and files. A null is told from every text, and a value from the same one in another column."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return df.agg(F.count("*").alias("n_rows"), _sum_of_digests(row).alias("digest"))
