"""Operator 1: embedding near-duplicates by collision-counting projections.

1. Vectors of one label that are equal are one class.
2. Two unit vectors of the least cosine are at most a known distance apart, so their projections on a random direction differ by a normal variable of known
   spread. A window of half-width REACH spreads around a query's projection holds such a partner with known probability, and of PROJECTIONS
   projections at least `needed` collide with the wanted recall (a binomial tail).
3. Classes meet in cells. A cell is what several directions put between the same marks, CELL spreads apart; there are as many tables of cells, each of other
   directions, as a pair of the least cosine needs to share one with the wanted recall. The more classes a label has, the more directions a table takes,
   so that the pairs compared grow with a power of about 1.25 of a label's classes (for vectors that point anywhere), not with their square; a label
   of few has one cell. A large cell is dealt as pairs of blocks.
4. In a block every projection is sorted; ranks of a query's window are searched, collisions counted for each pair, and pairs that reach `needed` are verified
   by cosine in double precision. A pair counts in the first table whose cell it shares.

Counts and a spanning forest are all that leaves a block.

Rows: one for each input row, repeated rows and null ids included. Vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing; vectors of other lengths never link with each other. Components of any finite size are scaled before they are
squared. At ties of cosine with the limit a pair is linked. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.blocks import in_blocks, verified, with_components
from tallystone.llm.common import with_id
from tallystone.llm.components import drop_tables, shared_table, spread_join

PROJECTIONS, REACH, CELL = 32, 1.96, 4.0
#: Classes and components of vectors that one side of a block holds at most, about, and rows of a block whose pairs are counted at once.
SIDE, NUMBERS, STRIP = 2048, 1 << 21, 128
#: Most tables of cells that a label may need.
MOST_TABLES = 1024


@lru_cache(8)
def directions(width: int) -> np.ndarray:
    """Orthogonal in runs of `width`, each as long as a Gaussian one is on average, so that counts of far pairs vary less."""
    rng = np.random.default_rng(width)
    runs = [np.linalg.qr(rng.standard_normal((width, width)))[0] * math.sqrt(width) for _ in range(-(-PROJECTIONS // width))]
    return np.concatenate(runs, 1)[:, :PROJECTIONS]


@lru_cache(8)
def table_directions(width: int, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (width, tables * depth), where their marks begin, and odd factors that make one number of a cell's marks."""
    rng = np.random.default_rng([width, depth])
    n = tables * depth
    return rng.standard_normal((width, n)), rng.random(n), rng.integers(1, 1 << 62, n, dtype="u8") * np.uint64(2) + np.uint64(1)


def spread(cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors' projections at that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def needed_collisions(recall: float, reach: float = REACH, projections: int = PROJECTIONS) -> int:
    """The greatest count that a pair at the least cosine reaches with that probability."""
    p = 2 * NormalDist().cdf(reach) - 1
    tail = 0.0
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def meeting(spreads: float) -> float:
    """Probability that a normal difference leaves two points between the same marks, which are that many of its spreads apart."""
    return 2 * NormalDist().cdf(spreads) - 1 - math.sqrt(2 / math.pi) / spreads * (1 - math.exp(-spreads * spreads / 2))


def tables_for(classes: int, cosine: float, recall: float, side: int = SIDE) -> tuple[int, int]:
    """(depth, tables) by which the fewest pairs are compared: each class meets a cell, or a block's side, in every table."""
    near, far = meeting(CELL), meeting(max(CELL * spread(cosine) / math.sqrt(2), 1e-9))
    best = (classes, 0, 1)
    for depth in range(1, 64):
        tables = math.ceil(math.log1p(-recall) / math.log1p(-(near**depth)))
        if tables > MOST_TABLES:
            break
        best = min(best, (tables * max(classes * far**depth, side), depth, tables))
    return best[1:]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; the largest component goes first, so that no square is too large or too small."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classified(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, cluster (label and width), key, data; all but vec_id null where the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for vector, label in zip(batch.column("vector"), batch.column("label").to_pylist(), strict=True):
                found = (None, None, None)
                if label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False).astype("f8")
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                        found = f"{len(x)}/{label}", hashlib.blake2b(f"{label}/".encode() + raw, digest_size=16).digest(), raw
                for column, value in zip(columns, found, strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *arrays], ["vec_id", "cluster", "key", "data"])

    rows = df.select(df[id_col].alias("vec_id"), df[vector_col].cast("array<double>").alias("vector"), df[label_col].cast("string").alias("label"))
    return rows.mapInArrow(run, with_id(rows, "cluster string, key binary, data binary", "vec_id"))


def celled(classes: DataFrame, cosine: float) -> DataFrame:
    """classes (cluster, key, copies, data, depth, tables) to key, copies and cells: a number for each table."""
    width = CELL * spread(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [[0]] * batch.num_rows
            alike: dict[tuple, list[int]] = {}
            data = batch.column("data").to_pylist()
            for i, (raw, depth, tables) in enumerate(zip(data, batch.column("depth").to_pylist(), batch.column("tables").to_pylist(), strict=True)):
                if depth:
                    alike.setdefault((len(raw) // 8, depth, tables), []).append(i)
            for (length, depth, tables), at in alike.items():
                along, begin, factors = table_directions(length, depth, tables)
                x = scaled(np.stack([np.frombuffer(data[i], "f8") for i in at]))
                marks = np.floor(x @ along / width + begin).astype("i8").view("u8")
                with np.errstate(over="ignore"):
                    numbers = ((marks + np.uint64(1 << 20)) * factors).reshape(len(at), tables, depth).sum(2, dtype="u8").view("i8")
                for i, found in zip(at, numbers, strict=True):
                    cells[i] = found
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("key"), batch.column("copies"), pa.array(cells, pa.list_(pa.int64()))], ["cluster", "key", "copies", "cells"])

    return classes.select("cluster", "key", "copies", "data", "depth", "tables").mapInArrow(run, "cluster string, key binary, copies long, cells array<long>")


def window_counts(one: np.ndarray, other: np.ndarray, half: float) -> Iterator[tuple[int, np.ndarray]]:
    """For strips of rows of `one`: where the strip begins, and how many projections' windows each of its rows collides in with each row of `other`."""
    order = np.argsort(other, axis=0, kind="stable")
    rank = np.empty(other.shape, "u2")
    np.put_along_axis(rank, order, np.arange(len(other), dtype="u2")[:, None], 0)
    rank = np.ascontiguousarray(rank.T)
    low, size = np.empty(one.shape, "u2"), np.empty(one.shape, "u2")
    for p in range(one.shape[1]):
        line = other[order[:, p], p]
        low[:, p] = begin = np.searchsorted(line, one[:, p] - half, "left")
        size[:, p] = np.searchsorted(line, one[:, p] + half, "right") - begin
    for at in range(0, len(one), STRIP):
        n = min(STRIP, len(one) - at)
        counts, place, inside = np.zeros((n, len(other)), "u1"), np.empty((n, len(other)), "u2"), np.empty((n, len(other)), bool)
        for p in range(one.shape[1]):
            np.subtract(rank[p][None, :], low[at : at + n, p, None], out=place)  # ranks below the window wrap round to large ones
            np.less(place, size[at : at + n, p, None], out=inside)
            np.add(counts, inside.view("u1"), out=counts)
        yield at, counts


def linker(cosine: float, recall: float):
    half, needed = REACH * spread(cosine) + 1e-9, needed_collisions(recall)

    def linked(_: str, data: list[dict], sides: np.ndarray) -> np.ndarray:
        x = scaled(np.stack([np.frombuffer(d["data"], "f8") for d in data]))
        projected = x @ directions(x.shape[1])
        out = np.zeros((len(x), len(x)), bool)
        table = data[0]["table"]
        cells = np.array([d["cells"][:table] for d in data], "i8")
        first, second = np.nonzero(sides == sides[0])[0], np.nonzero(sides != sides[0])[0]
        second = second if len(second) else first
        for begin, counts in window_counts(projected[first], projected[second], half):
            a, b = np.nonzero(counts >= needed)
            a, b = first[a + begin], second[b]
            for at in range(0, len(a), 1 << 14):
                i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                good = (np.einsum("ij,ij->i", x[i], x[j]) >= cosine) & (i != j)
                i, j = i[good], j[good]
                if table:
                    new = ~(cells[i] == cells[j]).any(1)  # others counted in an earlier table
                    i, j = i[new], j[new]
                out[i, j] = out[j, i] = True
        return out

    return linked


def vector_links(
    df: DataFrame, cosine: float = 0.93, recall: float = 0.9999, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", side: int = SIDE
) -> DataFrame:
    """vec_id, n_links long (other vectors linked directly), component_id (least id reachable), kept boolean."""
    rows = shared_table(classified(df, id_col, vector_col, label_col))
    known = rows.where("key is not null").groupBy("cluster", "key")
    classes = shared_table(known.agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("data").alias("data")))
    plans = [tables_for(1 << i, cosine, recall, side) for i in range(41)]  # by the number of a label's classes, in powers of two
    planned = lambda at, k: F.element_at(F.array(*[F.lit(p[k]) for p in plans]), F.floor(F.log2(at)).cast("int") + 1)
    labels = classes.groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.octet_length("data") / 8).alias("width"))
    labels = shared_table(labels.select("cluster", "n", "width", planned(F.col("n"), 0).alias("depth"), planned(F.col("n"), 1).alias("tables")))
    placed = shared_table(celled(spread_join(classes.select("cluster", "key", "copies", "data"), labels, "cluster", "n"), cosine))
    dealt = placed.select("cluster", "key", "copies", "cells", F.posexplode("cells").alias("table", "number"))
    dealt = dealt.select("key", "copies", "cells", "table", F.concat_ws("/", "cluster", "table", "number").alias("cell"), F.regexp_extract("cluster", "^[0-9]+", 0).cast("long").alias("width"))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("members"), F.max("width").alias("width")).where("members > 1")
    parts = F.greatest(F.ceil(F.col("members") / side), F.ceil(F.col("members") * F.col("width") / NUMBERS)).cast("int").alias("parts")
    sizes = shared_table(sizes.select("cell", "members", parts))
    members = in_blocks(spread_join(dealt.drop("width"), sizes, "cell", "members")).join(classes.select("key", "data"), "key")
    data = F.struct("data", "table", "cells").alias("data")
    found = verified(members.select("cell", "i", "j", "side", "key", "copies", data), linker(cosine, recall))
    out = with_components(rows, classes, found, "vec_id", "component_id")
    drop_tables(classes, labels, placed, sizes)
    return out
