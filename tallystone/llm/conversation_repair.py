"""Operator 11: cheapest repair of conversation structure by a dynamic program over a trie of signatures.

A conversation's rows, by turn (nulls first), then role and text, give a signature of one byte each: must go (blank, or role and text seen earlier), or the initial
of its role (s, u, a, other), in capitals if its text is truncated. Sorted signatures are the walk of their prefix trie: a task holds the layers along the
path to where it is, computes those below the prefix shared with the last signature, and answers at the end of one. A layer has the least cost of each state
(nothing yet, after system, user, assistant) and is one of few up to a constant, so a step is a look-up. Of the cheapest edits the ASCII-least come from the marks of
states on a cheapest path.

Cost: keep 0, another role (user, assistant) 3, delete 4, insert an empty user or assistant row 3; a truncated row that stays adds 3. Roles that stay read
(s?(ua)+)? by their initials.

Equal rows of a turn are counted before they are shuffled; signatures are dealt by range of their beginnings and a hash of the id, so that one that most
conversations have is spread. Rows are read as streams, sorted by Spark: a task holds no conversation's texts, only its signature and audit, a byte a row each (the
result holds as much). One conversation is one task's stream twice, since the hash of its repaired text is sequential.

Rows: one for each id of the table, null among them; a role or text that is null is one space, as are a null id and turn in the key of damage. Without rows: zeros, an
empty audit and the empty string's hash. Repeated rows are duplicates of each other. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import slices, with_id
from tallystone.llm.components import drop_tables, shared_table

#: Costs of edits.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system, user and assistant row; the states that may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: The state that a user or assistant row leads to, from each state, and its role.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
GONE = ord("x")
UNKNOWN = 1 << 40
#: Bytes of a signature by which conversations are dealt.
DEALT = 64


def with_damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows) of conversations (conv_id, turn, role, text), damaged by the CRC-32 of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    damaged = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return counted(damaged)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n) with blank, seen (the role and text stand at an earlier turn) and truncated."""
    line = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    blank = ~F.col("text").rlike("[^ \\t-\\r]")
    return rows.withColumns({"blank": blank, "seen": F.row_number().over(line) > 1, "truncated": ~F.col("text").rlike("[.!?][ \\t-\\r]*\\z")})


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
_LEGAL = {"su", "ua", "au"}


class Line:
    """What a pass over a conversation's rows in order gathers."""

    def __init__(self):
        self.signature, self.last, self.turns, self.first_turn, self.turn = bytearray(), None, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, blank: bool, seen: bool, truncated: bool, n: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in _LEGAL)
        self.last = initial
        gone = blank or seen
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - (not seen)
        self.truncated += truncated and not gone
        kind = initial if initial in ("s", "u", "a") else "o"
        self.signature += bytes([GONE if gone else ord(kind.upper() if truncated else kind)]) + bytes([GONE]) * (n - 1)

    def row(self) -> tuple:
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, bytes(self.signature)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, the columns of COUNTS, signature of rows with faults."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, conv, out = None, None, []

        def batch() -> pa.RecordBatch:
            ids = pa.array([r[0] for r in out], id_type)
            kinds = [*[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in out], k) for i, k in enumerate(kinds))], ["conv_id", *names, "signature"])

        for part in batches:
            id_type = part.column("conv_id").type
            for found, *row in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "seen", "truncated", "n")), strict=True):
                if line is None or found != conv:
                    if line is not None:
                        out.append((conv, *line.row()))
                    line, conv = Line(), found
                line.add(*row)
            if len(out) > 1000:
                yield batch()
                out.clear()
        if line is not None:
            out.append((conv, *line.row()))
            yield batch()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "turn", "role", "blank", "seen", "truncated", "n").mapInArrow(run, with_id(rows, f"{COUNTS}, signature binary", "conv_id"))


class Trie:
    """The path of the trie that the last signature took: the layer after each of its bytes, as a number, and the cost to add to it."""

    def __init__(self):
        first = [0, UNKNOWN, UNKNOWN, UNKNOWN]
        self.layers: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        number, base = self.number(closed(first))
        self.path, self.bases, self.signature, self.computed = array("i", [number]), array("q", [base]), b"", 0

    def number(self, costs: list[int]) -> tuple[int, int]:
        base = min(costs)
        layer = tuple(min(c - base, UNKNOWN) for c in costs)
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer], base

    def go(self, signature: bytes) -> None:
        """To the node of a signature; layers of what it shares with the last one stay."""
        shared = common_prefix(self.signature, signature)
        del self.path[shared + 1 :], self.bases[shared + 1 :]
        for byte in memoryview(signature)[shared:]:
            at = self.path[-1]
            step = self.steps.get((at, byte))
            if step is None:
                step = self.steps[at, byte] = self.number(closed(moved(self.layers[at], byte)))
            self.path.append(step[0])
            self.bases.append(self.bases[-1] + step[1])
        self.computed += len(signature) - shared
        self.signature = signature

    def costs(self, i: int) -> list[int]:
        base = self.bases[i]
        return [c + base if c < UNKNOWN else UNKNOWN for c in self.layers[self.path[i]]]

    def answer(self) -> tuple[int, str]:
        """The least cost at the node and its ASCII-least audit."""
        n = len(self.signature)
        last = self.costs(n)
        cost = min(last[s] for s in ENDS)
        marks = bytearray(n + 1)  # states on a cheapest path, a bit each
        marks[n] = sum(1 << s for s in ENDS if last[s] == cost)
        here = last
        for i in range(n, -1, -1):
            for state in (ASSISTANT, USER, ASSISTANT):  # a row before it may have been put in
                if marks[i] >> state & 1:
                    for s in range(4):
                        if AFTER[s] == state and here[s] + INSERT == here[state]:
                            marks[i] |= 1 << s
            if i:
                before = self.costs(i - 1)
                for s in range(4):
                    if any(marks[i] >> t & 1 and before[s] + c == here[t] for _, c, t in edits(s, self.signature[i - 1])):
                        marks[i - 1] |= 1 << s
                here = before
        audit, i, s, here = bytearray(), 0, NOTHING, self.costs(0)
        while i < n or not (s in ENDS and here[s] == cost):
            following = self.costs(i + 1) if i < n else None
            choices = [(letter, i + 1, t) for letter, c, t in edits(s, self.signature[i]) if marks[i + 1] >> t & 1 and here[s] + c == following[t]] if i < n else []
            if marks[i] >> AFTER[s] & 1 and here[s] + INSERT == here[AFTER[s]]:
                choices.append((ord("I"), i, AFTER[s]))
            letter, at, s = min(choices)
            audit.append(letter)
            if at > i:
                i, here = at, following
        return cost, audit.decode()


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def edits(state: int, byte: int) -> list[tuple[int, int, int]]:
    """(initial, cost, next state) of what can be done with a row in a state."""
    found = [(ord("D"), DELETE, state)]
    if byte != GONE:
        kind, more = chr(byte).lower(), TRUNCATED if chr(byte).isupper() else 0
        role = "a" if AFTER[state] == ASSISTANT else "u"
        if kind == role:
            found.append((ord("K"), more, AFTER[state]))
        elif kind == "s" and state == NOTHING:
            found.append((ord("K"), more, SYSTEM))
        found.append((ord("R"), RENAME + more, AFTER[state]))
    return found


def moved(layer: tuple[int, ...], byte: int) -> list[int]:
    out = [UNKNOWN] * 4
    for state, cost in enumerate(layer):
        for _, more, to in edits(state, byte):
            out[to] = min(out[to], cost + more)
    return out


def closed(costs: list[int]) -> list[int]:
    """Costs after rows put in: a user row, then an assistant one; more never pay. States that no cheapest path has go, so that there are few layers: after an
    assistant row all is open that is after a system one, and what is open at the beginning costs at most a deletion (of a system row) more."""
    costs = costs.copy()
    costs[USER] = min(costs[USER], *(costs[s] + INSERT for s in (NOTHING, SYSTEM, ASSISTANT)))
    costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
    for state, more in ((SYSTEM, 0), (NOTHING, DELETE)):
        costs[state] = UNKNOWN if costs[state] > costs[ASSISTANT] + more else costs[state]
    return costs


def audits(signed: DataFrame) -> DataFrame:
    """signed (with signature) with cost and audit in place of it."""
    kept = [c for c in signed.columns if c != "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, answer = Trie(), None
        for part in slices(batches, "signature"):
            found = []
            for signature in part.column("signature").to_pylist():
                if answer is None or signature != trie.signature:
                    trie.go(signature)
                    answer = trie.answer()
                found.append(answer)
            arrays = [part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], [*kept, "cost", "audit"])

    dealt = signed.repartitionByRange(F.substring("signature", 1, DEALT), F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.mapInArrow(run, with_id(signed, f"{COUNTS}, cost long, audit string", "conv_id"))


class Repair:
    """The hash of a conversation's repaired text, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, NOTHING, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = AFTER[self.state]
            self.put(ROLE[self.state], "")
            self.at += 1

    def add(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "D":
                continue
            system = letter == "K" and self.state == NOTHING and role.startswith("s")
            self.state = SYSTEM if system else AFTER[self.state]
            self.put(role if letter == "K" else ROLE[self.state], text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repaired(ids: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `found` (conv_id, COUNTS, cost, audit) with the hash of the text that their audits make of rows; ids without any get zeros."""
    numbers = [*[x.split()[0] for x in COUNTS.split(", ")], "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, held, repair = [], None, None, None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], id_type), *(pa.array([r[1][i] for r in out], pa.int64()) for i in range(6))]
            columns += [pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *numbers, "audit", "repaired_sha256"])

        for part in slices(batches):
            id_type = part.column("conv_id").type
            for found, kind, *row in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", *numbers, "audit", "role", "text", "n")), strict=True):
                if kind == 0:  # a conversation begins
                    if repair is not None:
                        out.append((conv, held, repair.audit, repair.digest()))
                    conv, held, repair = found, [0] * 6, Repair("")
                elif kind == 1:
                    held, repair = row[:6], Repair(row[6])
                else:
                    repair.add(*row[7:])
            if len(out) > 1000:
                yield batch()
                out.clear()
        if repair is not None:
            out.append((conv, held, repair.audit, repair.digest()))
            yield batch()

    begun = ids.select("conv_id", F.lit(0).alias("kind"))
    lines = begun.unionByName(found.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    lines = lines.unionByName(rows.select("conv_id", "turn", "role", "text", "n", F.lit(2).alias("kind")), allowMissingColumns=True)
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(run, with_id(ids, f"{COUNTS}, cost long, audit string, repaired_sha256 string", "conv_id"))


def repair_rows(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """ids (conv_id, each once) and rows (conv_id, turn, role, text, n) to conv_id, the columns of COUNTS, cost, audit, repaired_sha256."""
    rows = shared_table(with_faults(rows))
    signed = shared_table(signatures(rows))  # ranges are sampled from it
    found = shared_table(audits(signed))
    drop_tables(signed)
    return repaired(ids, found, rows.drop("blank", "seen", "truncated"))


def repair_conversations(df: DataFrame, damage=with_damage) -> DataFrame:
    """damage: what makes rows (conv_id, turn, role, text, n) of the table; `undamaged` leaves them as they are."""
    return repair_rows(df.groupBy("conv_id").agg(F.count("*").alias("_rows")).select("conv_id"), damage(df))


def undamaged(df: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return counted(df.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.lit(1).alias("n")))
