"""Operator 3 [native]: balanced label propagation into shards.

Documents of one group (equal texts) are linked. They begin in shards by hash. In each round every unit, a group or a part of one that a
shard can't hold, sees how many of its group each shard has and wants to go to the shard that has most and has room; the flows between shards, a
matrix of shards x shards, say which share of those moves the quotas allow, and that share is made. Rounds end when no unit wants to move, or when
PATIENCE rounds have cut no fewer links than the best one before. They are joins of a table that is aggregated by group, part and shard first, so a group that holds a third of all rows is
at most SALTS x shards rows there, however many it has. At last documents beyond a quota and documents
without links fill what room is left, so that the counts of shards are at most one apart (law `rows`).

Ranks within shards come from counts of hashed buckets, never from one task for a shard.

Rows: one for each input row, repeated rows and null ids included; a null text has size 1, the CRC-32 of the empty text, and is linked with empty texts. Other
columns are not read; an empty table gives an empty result. Ties between shards and ranks are settled by hashes, then by the row's place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.components import drop_tables, shared_checkpoint, shared_table

#: Parts that a large group's rows are dealt into, rounds without progress after which propagation ends, and the share of a shard that a unit may fill.
SALTS, PATIENCE, UNIT_SHARE = 64, 3, 0.25


def ranked(df: DataFrame, key: Column, name: str, rows: int, together: tuple[str, ...] = ("row",)) -> DataFrame:
    """df (with a unique `row`) and its rank from 0 among the rows of equal key, by hashed bucket, then what stays together, then row. There are as many
    buckets as the square root of all rows, so that neither a bucket's rows nor the buckets' counts are many."""
    buckets = max(1, math.isqrt(rows))
    df = df.withColumns({"_k": key, "_b": F.pmod(F.xxhash64(*together), F.lit(buckets))})
    counts = df.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_n")
    counts = counts.select("_k", "_b", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_k", "_b").orderBy(*dict.fromkeys([*together, "row"]))) - 1
    return df.withColumn("_i", inner).join(counts, ["_k", "_b"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_k", "_b", "_i", "_before")


def _at(values: list, index: Column, kind: str = "long") -> Column:
    """The value of a short list at an index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1).cast(kind)


def admitted_shares(wanted: list[list[int]], room: list[int]) -> list[float]:
    """For each shard the share of the moves into it that can be made: the greatest shares such that what comes in fits in the room and in what goes out."""
    n = len(room)
    inflow = [sum(wanted[a][b] for a in range(n) if a != b) for b in range(n)]
    share = [1.0] * n
    for _ in range(200):
        new = [
            min(share[b], max(0.0, room[b] + sum(wanted[b][c] * share[c] for c in range(n) if c != b)) / inflow[b]) if inflow[b] else 1.0 for b in range(n)
        ]
        if max(abs(x - y) for x, y in zip(new, share, strict=True)) < 1e-6:
            break
        share = new
    return share


def cut_links(state: DataFrame) -> int:
    """Links, as pairs of documents of one group, whose ends are in different shards: one number."""
    shards = state.groupBy("group", "shard").agg(F.sum("c").cast("decimal(38,0)").alias("c"))
    groups = shards.groupBy("group").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("inside"))
    return int(groups.agg(F.sum(F.col("k") * F.col("k") - F.col("inside")).alias("cut")).first()["cut"] or 0) // 2


def propagate(state: DataFrame, quotas: list[int]) -> DataFrame:
    """state (group, salt, unit, first, shard, c: rows of that group, salt and first shard) with the shards that label propagation ends at."""
    n, turn, best_cut, since, best = len(quotas), -1, None, 0, state
    while True:
        turn += 1
        cut = cut_links(state)
        since = 0 if best_cut is None or cut < best_cut else since + 1
        if since == 0:
            best_cut, best = cut, state
        if cut == 0 or since >= PATIENCE:
            return best
        held = [0] * n
        for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect():  # a row for each shard
            held[r["shard"]] = r["c"]
        room = [q - h for q, h in zip(quotas, held, strict=True)]
        votes = state.groupBy("group", "shard").agg(F.sum("c").alias("votes"))
        own = state.groupBy("group", "unit", "shard").agg(F.sum("c").alias("own"))
        units = state.groupBy("group", "unit").agg(F.sum("c").alias("size"))
        choices = units.join(votes, "group").join(own, ["group", "unit", "shard"], "left")
        rest = F.col("size") - F.coalesce("own", F.lit(0))
        # a shard is chosen for its votes if it has room for the rest of the unit, else for what it has of the unit already
        fits = _at(room, F.col("shard")) >= rest
        rank = F.struct((fits | (rest == 0)).alias("fits"), F.when(fits | (rest == 0), F.col("votes")).otherwise(F.coalesce("own", F.lit(0))).alias("v"), F.xxhash64("group", "shard").alias("tie"), F.col("shard").alias("shard"))
        wish = choices.groupBy("group", "unit", "size").agg(F.max(rank).alias("best"))
        # where none of its shards has room for the rest of a unit, all of it goes to one that has, chosen by hash
        spare = [b for b in range(n) if room[b] > 0]
        if spare:
            other = _at(spare, F.pmod(F.xxhash64("group", "unit", F.lit(-1 - turn)), F.lit(len(spare))), "int")
            wish = wish.select("group", "unit", F.when(~F.col("best.fits") & (_at(room, other) >= F.col("size")), other).otherwise(F.col("best.shard")).alias("to"))
        else:
            wish = wish.select("group", "unit", F.col("best.shard").alias("to"))
        moves = shared_table(state.join(wish, ["group", "unit"]))
        wanted = [[0] * n for _ in range(n)]
        for r in moves.where("shard != to").groupBy("shard", "to").agg(F.sum("c").alias("c")).collect():  # shards x shards rows
            wanted[r["shard"]][r["to"]] = r["c"]
        if not any(map(any, wanted)):
            return best
        shares = admitted_shares(wanted, room)
        draw = F.pmod(F.xxhash64("group", "unit", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        state = shared_table(moves.withColumn("shard", F.when(draw < _at(shares, F.col("to"), "double"), F.col("to")).otherwise(F.col("shard"))).drop("to"))
        drop_tables(moves)


def balanced_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null: the law is not `key`)."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    # two hashes, the length and the CRC-32 stand for the text
    light = df.select(
        df[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.hash(text).alias("h2")
    )
    light = shared_checkpoint(light.select("doc_id", "size", "text_crc32", F.xxhash64("h", "h2", "size", "text_crc32").alias("group")))
    light = light.withColumn("row", F.monotonically_increasing_id())  # over checkpointed rows
    light = light.withColumns({"first": F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"), "salt": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(SALTS)).cast("int")})
    total = light.count()
    quotas = [total // shards + (b < total % shards) for b in range(shards)]
    whole = Window.partitionBy("group")  # SALTS x shards rows at most
    parts = light.groupBy("group", "salt", "first").agg(F.count("*").alias("c")).withColumn("k", F.sum("c").over(whole)).where("k > 1")
    most = max(1, int(UNIT_SHARE * (total // shards)))
    unit = F.when(F.col("k") > most, F.pmod(F.col("salt"), F.ceil(F.col("k") / most))).otherwise(F.lit(0)).cast("int")
    state = shared_checkpoint(parts.select("group", "salt", "first", unit.alias("unit"), F.col("first").alias("shard"), "c", (F.col("k") > most).alias("large")))
    large = state.where("large").select("group").distinct()
    placed = propagate(state.drop("large"), quotas).select("group", "salt", "first", "shard")
    placed = placed.join(large.withColumn("large", F.lit(True)), "group", "left")
    # what an overfull shard gives up is whole groups, or parts of large ones
    part = F.when(F.col("large"), F.col("salt")).otherwise(0).alias("part")
    linked = shared_checkpoint(light.join(placed, ["group", "salt", "first"], "left").select("row", "doc_id", "size", "text_crc32", "group", part, "shard"))
    inside = ranked(linked.where("shard is not null"), F.col("shard"), "at", total, ("group", "part"))
    kept = inside.where(F.col("at") < _at(quotas, F.col("shard"))).drop("at")
    pool = linked.where("shard is null").unionByName(inside.where(F.col("at") >= _at(quotas, F.col("shard"))).drop("at"))
    held = [0] * shards
    for r in kept.groupBy("shard").agg(F.count("*").alias("c")).collect():  # a row for each shard
        held[r["shard"]] = r["c"]
    ends, at = [], 0
    for b in range(shards):
        at += quotas[b] - held[b]
        ends.append(at)
    order = ranked(pool.drop("shard"), F.lit(0), "at", total, ("group", "part"))
    free = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("at"))).cast("int")
    everyone = kept.unionByName(order.withColumn("shard", free).drop("at"))
    out = ranked(shared_checkpoint(everyone), F.col("shard"), "slot", total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
