"""Operator 13: interaction audit of five document filters, in every order.

Spark gives each row the set of filters that it fails, as a mask, and counts rows by part and mask: 32 cells a part, whatever the input. A walk then visits
all orders of the filters by swaps of two neighbours; a swap changes the rows removed at its two steps alone, which are taken from the cells anew. Shapley
sums gather along the walk: of every step that it leaves or makes, the rows removed are counted for its filter.

Filters fail a text (words: runs without white space, case-sensitive) when: A: it has under 50 words; B: under 65 of 100 words are distinct; C: over 5 of 100
code points are A-Z; D: it holds one of #$%&*|; E: a row of lesser id has the same text, in the whole table, removed or not.

Copies are counted before they meet: by text, id and part first, then by text, part and labels, so a text or part with a third of all rows is a few rows of
the later steps. Two texts are equal if their SHA-256 is.

Rows: for each part 120 orders x 5 steps, zeros included; an empty table has no part. A null part is the empty string, a null text the empty one. A row
without an id is neither less nor greater than another, so it doesn't fail E, and has no label; rows of one id and text are not lesser than each other.
Repeated rows count each. A document labelled twice counts as good or toxic if one of its labels is 1. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts whose rows are made at once, 600 each.
PARTS = 128


def failing(text: Column) -> Column:
    """The mask of filters A to D that a text fails."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    found = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    short = lambda w: (w["n"] < 50).cast("int") + F.when(100 * w["distinct"].cast("long") < 65 * w["n"].cast("long"), 2).otherwise(0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    shape = F.when(100 * capitals > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return (F.transform(F.array(found), short)[0] + shape).cast("int")


def label_flags(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null").groupBy("doc_id")
    return known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))


def mask_cells(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and set of filters that they fail."""
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    rows = documents.select(
        documents[id_col].alias("doc_id"), F.coalesce(documents[part_col].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), failing(text).alias("mask")
    )
    rows = rows.groupBy("key", "mask", "doc_id", "part").agg(F.count("*").alias("n"))
    flagged = rows.where("doc_id is not null").join(label_flags(labels), "doc_id", "left")
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    rows = flagged.unionByName(nameless).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")  # an id is there once
    groups = rows.groupBy("key", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), first)
    least = F.min("first.doc_id").over(Window.partitionBy("key"))  # a row for each part and pair of labels
    groups = groups.withColumn("copies", F.col("named") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    cells = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))
    split = groups.select("part", "good", "toxic", F.explode(cells).alias("c")).where("c.n > 0").select("part", "good", "toxic", "c.*")
    counted = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counted)


def swaps(n: int) -> Iterator[int]:
    """Places i whose neighbours i and i + 1 are swapped in turn, so that all orders of n things are seen once: the largest thing that can move on moves."""
    order, ahead = list(range(n)), [-1] * n
    while True:
        moving = None
        for i, x in enumerate(order):
            j = i + ahead[x]
            if 0 <= j < n and order[j] < x and (moving is None or x > order[moving]):
                moving = i
        if moving is None:
            return
        x, j = order[moving], moving + ahead[order[moving]]
        order[moving], order[j] = order[j], order[moving]
        for y in range(x + 1, n):
            ahead[y] = -ahead[y]
        yield min(moving, j)


class Walk:
    """Cells (parts x masks x counts) and, of the order that the walk is at, the counts of each step."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.order = cells, list(range(len(FILTERS)))
        parts, steps = len(cells), len(FILTERS)
        self.kept, self.redundant = np.zeros((parts, steps), "i8"), np.zeros((parts, steps), "i8")
        self.removed = np.zeros((parts, steps, len(COUNTS)), "i8")
        self.shapley = np.zeros((parts, steps), "i8")  # by filter
        masks = np.arange(1 << steps)
        self.unique = np.stack([cells[:, 1 << f, 0] for f in range(steps)], 1)
        self.of = lambda held: cells[:, held].sum(1)
        self.masks = masks
        for step in range(steps):
            self.settle(step)
        self.count()

    def settle(self, step: int) -> None:
        """A step's counts, from the cells."""
        before = sum(1 << f for f in self.order[:step])
        own = 1 << self.order[step]
        fails, gone = self.masks & own != 0, self.masks & before != 0
        self.removed[:, step] = self.of(fails & ~gone)
        self.redundant[:, step] = self.of(fails & gone)[:, 0]
        self.kept[:, step] = self.of(~fails & ~gone)[:, 0]

    def count(self) -> None:
        self.shapley[:, self.order] += self.removed[:, :, 0]

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self.settle(i)
        self.settle(i + 1)
        self.count()


def walked(parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
    """The rows of some parts: all orders of the walk, all steps."""
    walk, steps = Walk(cells), len(FILTERS)
    seen: list[tuple] = []

    def see() -> None:
        order = walk.order
        seen.append(("".join(FILTERS[f] for f in order), order.copy(), walk.kept.copy(), walk.removed.copy(), walk.redundant.copy(), walk.unique[:, order]))

    see()
    for i in swaps(steps):
        walk.swap(i)
        see()
    n = len(seen) * steps
    numbers = lambda at: np.stack([s[at] for s in seen], 1).reshape(len(parts) * n)
    removed = np.stack([s[3] for s in seen], 1).reshape(len(parts) * n, len(COUNTS))
    shapley = np.stack([walk.shapley[:, s[1]] for s in seen], 1).reshape(len(parts) * n)
    columns = [
        pa.array(np.repeat(np.array(parts, object), n), pa.string()), pa.array([s[0] for s in seen for _ in range(steps)] * len(parts), pa.string()), pa.array(np.tile(np.arange(1, steps + 1, dtype="i4"), len(parts) * len(seen))),
        *map(pa.array, (numbers(2), removed[:, 0], numbers(4), numbers(5), removed[:, 1], removed[:, 2], shapley)),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def filter_audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The columns of SCHEMA."""
    cells = mask_cells(documents, labels, id_col, text_col, part_col)
    lines = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, found = batch.column("part").to_pylist(), batch.column("cells").to_pylist()
            for low, high in pairwise([*range(0, len(parts), PARTS), len(parts)]):
                held = np.zeros((high - low, 1 << len(FILTERS), len(COUNTS)), "i8")
                for i, line in enumerate(found[low:high]):
                    for c in line:
                        held[i, c["mask"]] = [c[k] for k in COUNTS]
                yield walked(parts[low:high], held)

    return lines.mapInArrow(run, SCHEMA)
