"""Conversation repair against an exhaustive search."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallystone.llm import conversation_repair as cr

KIND = "conv_id long, turn long, role string, text string, kind int, n string, cost double"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def search(rows):
    """(cost, audit, repaired lines) of (role, text, fault): the cheapest edits, ASCII-least, by trying all in order of cost and audit."""
    heap, prefix, whole = [(0, "", 0, "", [])], re.compile("s?(ua)*u?"), re.compile("(s?(ua)+)?")
    while True:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and whole.fullmatch(initials):
            return cost, audit, lines
        choices = [("I", 3, 0, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            choices.append(("D", 4, 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                choices.append(("K", more, 1, role[:1] or "-", f"{role}:{text}"))
                choices += [("R", 3 + more, 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, more, step, role, line in choices:
            now = initials + role[:1]
            if prefix.fullmatch(now) and not (letter == "I" and audit.endswith("III")):
                heapq.heappush(heap, (cost + more, audit + letter, i + step, now, lines if line is None else [*lines, line]))


def by_loops(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    left = damaged(rows)
    for conv in {r[0] for r in left}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = search([(role, text, fault) for (_, role, text), fault in zip(own, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs=60):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        for t in range(rng.randrange(0, 8)):
            rows.append((conv, rng.choice([t, t, t, None, t + 2, -t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), rng.choice(["Yes.", "No!", "Cut off", "", " \t", None, "Why? ", "a.b", "Ä. ", "x.\n\x0b"])))
    return rows


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_the_search(spark):
    rows = random_rows(1) + [(None, 0, "user", "Hello."), (None, None, "assistant", "Hi."), (None, 1, "assistant", "Hi."), (77, 5, "user", "Same.")] + [(77, 5, "user", "Same.")] * 4
    rows += [(78, 0, "user", "y" * 100_000), (78, 1, "assistant", "z. " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "n", 0.5) for r in rows], KIND)
    found, wanted = result(cr.repair_conversations(df)), by_loops(rows)
    assert found == wanted
    assert len({w[6] for w in wanted.values()}) > 20


def test_tables_without_rows(spark):
    assert cr.repair_conversations(spark.createDataFrame([], KIND)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = result(cr.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "n", 0.5)], KIND)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_layers_of_shared_prefixes_are_computed_once():
    rng = random.Random(3)
    signatures = sorted({bytes(rng.choice(b"suaoxSUAO") for _ in range(rng.randrange(1, 7))) for _ in range(3000)})
    trie = cr.Trie()
    for s in signatures:
        trie.go(s)
        answer = trie.answer()
        fresh = cr.Trie()
        fresh.go(s)
        assert fresh.answer() == answer
    nodes = {s[:i] for s in signatures for i in range(1, len(s) + 1)}
    assert trie.computed == len(nodes)  # a layer a node of the trie
    assert len(trie.layers) < 100


def test_a_long_conversation_is_a_stream(spark):
    """Linear in its length, a byte a row; audits of 60,000 rows."""
    n = 60_000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Line ', id, '.') as text")
    row = cr.repair_conversations(df, cr.undamaged).first()
    assert (row.cost, row.audit, row.illegal) == (0, "K" * n, 0)
    lines = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Line {i}." for i in range(n))
    assert row.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_copies_of_a_row_meet_as_one(spark):
    df = spark.range(50_000).selectExpr("7L as conv_id", "3L as turn", "'user' as role", "'Same.' as text").unionAll(spark.createDataFrame([(7, 4, "assistant", "Yes.")], "conv_id long, turn long, role string, text string"))
    assert cr.undamaged(df).count() == 2
    row = cr.repair_conversations(df, cr.undamaged).first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (49_999, 49_999, 4 * 49_999, "K" + "D" * 49_999 + "K")


@pytest.mark.parametrize("seed", [2, 3])
def test_more_random_conversations(spark, seed):
    rows = random_rows(seed, 80)
    df = spark.createDataFrame([(*r, 1, "n", 0.5) for r in rows], KIND)
    assert result(cr.repair_conversations(df)) == by_loops(rows)
