"""Verified links inside blocks, and what documents get from them: numbers of links, components and their least ids.

A block is the rows of one (cell, i, j): the members of sides i and j of a cell, or of one side if they are the same. Only a count and a tie to a
member of its component leave a block for each of its members, however many links there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import hand_back
from tallystone.llm.components import connected_components, drop_tables, folded, shared_table, spread_join

#: Result rows that a task gathers before it hands them on, and rows of a block's matrix that are turned to numbers at once.
ROWS, STRIP = 10_000, 256


def asked(sides: np.ndarray) -> np.ndarray:
    """The pairs that a block asks for: all of one side, or those between two."""
    return sides[:, None] != sides[None, :] if (sides != sides[0]).any() else ~np.eye(len(sides), dtype=bool)


def least_reachable(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least index reachable from it."""
    n = len(linked)
    root = np.arange(n)
    while True:
        new = root.copy()
        for at in range(0, n, STRIP):
            s = slice(at, at + STRIP)
            new[s] = np.minimum(root[s], np.where(linked[s], root[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def in_blocks(members: DataFrame) -> DataFrame:
    """members (cell, parts, key, ...) once for each block that they are in: a cell of several parts is dealt by key into as many sides, and every
    two of them, or one with itself, are a block."""
    side = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    dealt = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "parts")


def verified(members: DataFrame, linked: Callable[[Any, list, np.ndarray], np.ndarray]) -> DataFrame:
    """members (cell, i, j, side, key, copies, data) to key, links and root of each member of each block that has a link.

    linked(cell, data, sides) gives the symmetric matrix of the block's links, of pairs that are `asked` for alone.
    """

    def of_block(rows: list[tuple]) -> tuple[list, list, list]:
        rows.sort(key=lambda r: r[4])
        if rows[0][1] != rows[0][2] and len({r[3] for r in rows}) < 2:  # the other side has no members
            return [], [], []
        links = linked(rows[0][0], [r[6] for r in rows], np.array([r[3] for r in rows]))
        having = np.nonzero(links.any(1))[0].tolist()
        copies, roots = np.array([r[5] for r in rows], "i8"), least_reachable(links)
        counts = np.concatenate([links[at : at + STRIP] @ copies for at in range(0, len(rows), STRIP)])
        return [rows[i][4] for i in having], counts[having].tolist(), [rows[roots[i]][4] for i in having]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        held: list[tuple] = []

        def settle() -> None:
            for column, new in zip(out, of_block(held), strict=True):
                column += new

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["key", "links", "root"])
            for column in out:
                column.clear()
            return done

        for part in batches:
            for row in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                if held and row[:3] != held[0][:3]:
                    settle()
                    held = []
                    if len(out[0]) >= ROWS:
                        yield batch()
                held.append(row)
        if held:
            settle()
        yield batch()
        held, part = [], None
        hand_back()

    columns = members.select("cell", "i", "j", "side", "key", "copies", "data")
    sorted_ = columns.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return sorted_.mapInArrow(run, "key binary, links long, root binary")


def with_components(rows: DataFrame, classes: DataFrame, found: DataFrame, id_col: str, component: str) -> DataFrame:
    """rows (id_col, key) with n_links, the component's least id and `kept`; classes (key, least id, copies); found: what `verified` gave.
    A row without a key links with nothing. When this returns, only `rows` and the table that it wrote are still read."""
    found = shared_table(found)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ties = shared_table(folded(found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()))
    joined = connected_components(ties)
    known = classes.select("key", "least", "copies").join(links, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    known = shared_table(known.select("key", "least", "copies", n_links, F.coalesce("component", "key").alias("component")))
    least = shared_table(known.groupBy("component").agg(F.min("least").alias("least_id"), F.count("*").alias("nodes")))
    done = shared_table(spread_join(known, least, "component", "nodes").select("key", "copies", "n_links", "least_id"))
    drop_tables(found, ties, joined, known, least)
    linked = spread_join(rows.where("key is not null").select(id_col, "key"), done, "key", "copies").select(id_col, "n_links", "least_id")
    alone = rows.where("key is null").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("least_id"))
    out = linked.unionByName(alone)
    return out.select(id_col, "n_links", F.col("least_id").alias(component), F.coalesce(F.col(id_col) == F.col("least_id"), F.lit(True)).alias("kept"))
