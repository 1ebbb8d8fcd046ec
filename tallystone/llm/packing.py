"""Operator 4: best-fit packing by a grouping genetic algorithm.

Texts become pieces of at most `limit` ids. Pieces are dealt into blocks of about BLOCK pieces. In each block ISLANDS islands breed packings:
crossover injects whole well-filled sequences of one parent into another, removes what they hold from its other sequences, dissolves the
sequences that this touches, and best-fits the displaced pieces, longest first. After each epoch the best packing of an island migrates to the
next. The best packing of a block stays, but its sequences that are not well filled, emptiest first and at most as many as hold half of its pieces, are
dissolved, dealt anew into fewer blocks and bred again, until one block is left. Nothing but a block is ever in one task.

Rows: one for each piece of each input row, repeated rows and null ids included. A null or empty text is a piece of the end id alone. Other
columns are not read; an empty table gives an empty result. Only texts of more than `limit` ids are cut. Ties between sequences with the same room go to the
older one, between pieces of one length to the one that stands first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallystone.llm.common import documents, hand_back, slices, with_id
from tallystone.llm.components import shared_checkpoint
from tallystone.llm.word_ids import word_ids

BLOCK, ISLANDS, EPOCHS = 2048, 2, 2
POPULATION, GENERATIONS = 4, 4
#: A sequence that is filled to this share is whole enough to be injected and to be kept.
WELL_FILLED = 0.995

Packing = list[list[int]]


def best_fit(items: list[int], lengths: list[int], bins: Packing, limit: int) -> Packing:
    """Adds the items, longest first, each to the fullest sequence that has room, or to a new one."""
    room = sorted((limit - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -lengths[i]):
        size = lengths[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = limit, len(bins)
            bins.append([i])
        if left > size:
            insort(room, (left - size, k))
    return bins


def fills(bins: Packing, lengths: list[int]) -> list[int]:
    return [sum(lengths[i] for i in b) for b in bins]


def fitness(bins: Packing, lengths: list[int], limit: int) -> tuple[int, float]:
    """Fewer sequences first, then the more unevenly they are filled the better."""
    return -len(bins), sum((f / limit) ** 2 for f in fills(bins, lengths))


def crossover(one: Packing, other: Packing, lengths: list[int], limit: int, rng: np.random.Generator) -> Packing:
    """A child of `one` with some whole, well-filled sequences of `other`; what is displaced is best-fitted."""
    whole = [b for b, f in zip(other, fills(other, lengths), strict=True) if f >= WELL_FILLED * limit]
    injected = [whole[k] for k in rng.permutation(len(whole))[: max(1, len(whole) // 2)]] if whole else []
    held = {i for b in injected for i in b}
    bins, loose = [list(b) for b in injected], []
    for b, f in zip(one, fills(one, lengths), strict=True):
        if not held.isdisjoint(b) or f < WELL_FILLED * limit and rng.random() < 0.5:
            loose += [i for i in b if i not in held]
        else:
            bins.append(list(b))
    return best_fit(loose, lengths, bins, limit)


def seeded(lengths: list[int], limit: int, rng: np.random.Generator) -> Packing:
    """A packing to begin with: part of the pieces in a random order, then the rest longest first."""
    order = rng.permutation(len(lengths)).tolist()
    bins: Packing = []
    for i in order[: len(order) // 4]:
        best_fit([i], lengths, bins, limit) if len(bins) < 8 else bins.append([i])
    return best_fit(order[len(order) // 4 :], lengths, bins, limit)


def evolve(lengths: list[int], limit: int, elites: list[Packing], seed: int) -> Packing:
    """The best packing after GENERATIONS of a population of the elites and seeded packings."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // limit)
    population = [*elites, best_fit(list(range(len(lengths))), lengths, [], limit)] if not elites else list(elites)
    while len(population) < POPULATION:
        population.append(seeded(lengths, limit, rng))
    rated = sorted(((fitness(p, lengths, limit), k, p) for k, p in enumerate(population)), reverse=True)
    count = len(rated)
    for _ in range(GENERATIONS):
        if len(rated[0][2]) <= least:
            break
        for _ in range(POPULATION // 2):
            a, b = rng.choice(len(rated), 2, replace=False)
            a, b = min(a, b), max(a, b)
            child = crossover(rated[a][2], rated[b][2], lengths, limit, rng) if rng.random() < 0.5 else crossover(rated[b][2], rated[a][2], lengths, limit, rng)
            count += 1
            rated.append((fitness(child, lengths, limit), count, child))
        rated = sorted(rated, reverse=True)[:POPULATION]
    return rated[0][2]


def tokenised(df: DataFrame, tokenizer_path: str, limit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    docs = documents(df, id_col, text_col)
    names = ["piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        for part in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for at, text in enumerate(part.column("text").to_pylist()):
                ids = encode(text) + end
                for k, begin in enumerate(range(0, len(ids), 4 * limit)):
                    cut = ids[begin : begin + 4 * limit]
                    for column, x in zip(rows, (at, k, begin // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        column.append(x)
            arrays = [pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows[0], pa.int64())), *arrays], ["doc_id", *names])
        part = rows = arrays = None
        hand_back()

    return docs.mapInArrow(run, with_id(docs, "piece int, start long, length long, ids_crc32 long"))


def _read_packings(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[int], list[Packing]]:
    """The pieces of a group, their lengths, and the packings that came with them (a bin number for each, by source)."""
    pieces = pdf.drop_duplicates("row").sort_values("row", kind="stable").reset_index(drop=True)
    place = dict(zip(pieces["row"].tolist(), range(len(pieces)), strict=True))
    packings = []
    for _, own in sorted(pdf[pdf["bin"] >= 0].groupby("source"), key=lambda x: x[0]):
        bins: dict[int, list[int]] = {}
        for row, k in zip(own["row"].tolist(), own["bin"].tolist(), strict=True):
            bins.setdefault(k, []).append(place[row])
        packings.append(list(bins.values()))
    return pieces, pieces["length"].tolist(), packings


def _breed(limit: int):
    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, lengths, elites = _read_packings(pdf)
        bins = evolve(lengths, limit, elites, int(pdf["block"].iloc[0]) * 1000 + int(pdf["island"].iloc[0]) * 10 + len(elites))
        number = np.zeros(len(pieces), "i8")
        for k, b in enumerate(bins):
            number[b] = k
        return pieces.assign(bin=number, source=pieces["island"])

    return island


def _settle(limit: int, last: bool):
    """The best packing of a block: offsets, and whether a sequence stays. Of sequences that aren't well filled the emptiest go, while they hold at most half
    of the block's pieces; where the block is the last, all stay."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, lengths, packings = _read_packings(pdf)
        best = max(packings, key=lambda p: fitness(p, lengths, limit))
        number, offset, stays = np.zeros(len(pieces), "i8"), np.zeros(len(pieces), "i8"), np.ones(len(pieces), bool)
        for k, b in enumerate(best):
            at = 0
            for i in b:
                number[i], offset[i] = k, at
                at += lengths[i]
        gone = 0
        for f, k in sorted((f, k) for k, f in enumerate(fills(best, lengths))):
            gone += len(best[k])
            if last or f >= WELL_FILLED * limit or gone > max(1, len(pieces) // 2):
                break
            stays[best[k]] = False
        return pieces.assign(bin=number, offset=offset, stays=stays)[[*_KEPT, "block", "bin", "offset", "stays"]]

    return block


_KEPT = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]


def packed(pieces: DataFrame, limit: int) -> DataFrame:
    """The columns of `pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    base = StructType([StructField("row", LongType()), *pieces.schema.fields])
    flow = StructType([*base.fields, *StructType.fromDDL("block long, island int, bin long, source int").fields])
    settled_in = StructType([*base.fields, *StructType.fromDDL("block long, bin long, offset long, stays boolean").fields])
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())  # over checkpointed rows
    whole = pieces.where(F.col("length") >= limit)
    done = [whole.withColumns({"level": F.lit(0), "block": F.col("row"), "bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})]
    loose, level = pieces.where(F.col("length") < limit), 0
    n = loose.count()
    while True:
        level += 1
        blocks = max(1, round(n / BLOCK))
        dealt = loose.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        bred = dealt.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS))))).withColumns({"bin": F.lit(-1).cast("long"), "source": F.lit(-1)})
        for _ in range(EPOCHS):
            elite = bred.groupBy("block", "island").applyInPandas(_breed(limit), flow)
            # an island's best is kept, and goes to the next island
            bred = elite.withColumn("island", F.explode(F.array("source", F.pmod(F.col("source") + 1, F.lit(ISLANDS)))))
        settled = shared_checkpoint(elite.groupBy("block").applyInPandas(_settle(limit, blocks == 1), settled_in).withColumn("level", F.lit(level)))
        done.append(settled.where("stays").drop("stays"))
        if blocks == 1:
            break
        again = settled.where("not stays")
        n, loose = again.count(), again.drop("stays", "block", "bin", "offset", "level")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    # a number for each sequence: 8 bits of level (few, as each is a fraction of the last), 12 bits of bin, the block above them
    sequence = F.when(F.col("level") == 0, F.col("block") * 2).otherwise(((F.col("block") * 4096 + F.col("bin")) * 256 + F.col("level")) * 2 + 1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def pack_texts(df: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    return packed(shared_checkpoint(tokenised(df, tokenizer_path, limit, end_id, id_col, text_col)), limit)
