"""Filter audits, license scans and conversation repair against brute force."""

import random
import re
from itertools import permutations

from tallystone.llm import license_scan as ls
from tallystone.llm.filter_audit import FILTERS, filter_audit, swaps
from tests.llm.helpers import TEXTS, edge_documents, empty_documents


def by_loops(rows, labels):
    sets, texts = [], [(i, t or "", s or "") for i, t, s in rows]
    for i, t, s in texts:
        plain = t
        for c in "\t\n\x0b\x0c\r":
            plain = plain.replace(c, " ")
        words = [w for w in plain.split(" ") if w]
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else set()
        sets.append((s, fails, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    out = {}
    for part in {s for s, *_ in sets}:
        own, removed_of = [x for x in sets if x[0] == part], dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [x for x in own if f in x[1] and not before & x[1]]
                removed_of[f] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not (before | {f}) & x[1] for x in own), len(removed), sum(f in x[1] and bool(before & x[1]) for x in own), sum(x[1] == {f} for x in own),
                    sum(x[2] for x in removed), sum(x[3] for x in removed),
                ]
        for order in permutations(FILTERS):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_of[f])
    return out


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in df.collect()}


LABELS = [(1, 1, 0), (2, None, 1), (8, 0, 1), (8, 1, None), (None, 1, 1), (9, 1, 1), (9, 1, 1)]


def test_swaps_see_every_order_once():
    for n in (1, 2, 3, 5):
        order = list(range(n))
        seen = {tuple(order)}
        for i in swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_audit_equals_plain_loops(spark):
    more = [(9, "a " * 60 + "$", None), (10, " ".join(f"w{i}" for i in range(60)), ""), (11, " ".join(f"w{i}" for i in range(60)), "s"), (12, "A\x0bB\x1cC", "s"), (12, "A\x0bB\x1cC", "s"), (-3, "A\x0bB\x1cC", "t"), (None, "A\x0bB\x1cC", "t"), (13, "ÄÖ A" * 4, "s")]
    rows = [(i, t, "k" if k % 2 else None) for k, (i, t) in enumerate(TEXTS)] + more
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, mask int")
    labels = spark.createDataFrame([(*r, "y") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    assert audit_rows(filter_audit(docs, labels)) == by_loops(rows, LABELS)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty_documents(spark).withColumnRenamed("key", "source"), none).count() == 0
    assert filter_audit(edge_documents(spark).withColumnRenamed("key", "source"), none).count() == 600


def test_audit_keeps_no_row_of_a_large_group_in_one_task(spark):
    """What is grouped by text alone has a row for each part and pair of labels, however many copies there are."""
    from tallystone.llm.filter_audit import mask_cells

    docs = spark.range(3000).selectExpr("id as doc_id", "'same' as text", "concat('s', id % 3) as source")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {(r.part, r["mask"]): r.n for r in mask_cells(docs, none).collect()}
    assert cells == {("s0", 1): 1, ("s0", 17): 999, ("s1", 17): 1000, ("s2", 17): 1000}


def scan_by_loops(text, templates, threshold, phrases):
    """(n_words, places, labels, score, n_matches) of a text: every block against every template."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words, at, labels, best, n = word.findall(low), [], set(), 0.0, 0
    for phrase, label in phrases.items():
        k = len(phrase.split())
        here = [i for i in range(len(words) - k + 1) if words[i : i + k] == phrase.split()]
        at += here
        labels |= {label} if here else set()
    base = set(labels)
    for piece in re.split("\n|[.!?][\t-\r ]", low):
        found = word.findall(piece)
        for k in range(0, max(1, len(found) - 32), 32):
            for label, template in templates:
                t = {*template.split()}
                share = len(t & {*found[k : k + 64]}) / len(t)
                if share >= threshold:
                    labels.add(label)
                    best, n = max(best, share), n + 1
    return len(words), sorted(at), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else best, n


def test_scan_equals_every_block_against_every_template(spark):
    rng = random.Random(5)
    pool = ["permission", "is", "hereby", "granted", "mit", "the", "license", "cc", "by", "NC", "general", "public", "Ärger", "x1", "zulu", "\n", ". ", "., ", "released", "under", "all", "rights", "reserved"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 20, 200])))) for i in range(60)]
    rows += [(100, "Under THE mit license\treleased; now"), (101, "word " * 30_000 + "released under the MIT License"), (102, "a " * 50 + "released under the mit license" + " b" * 50), (100, None), (None, "cc by cc by"), (None, "cc by cc by"), *TEXTS]
    docs = spark.createDataFrame([(*r, "k", "l", 1.0) for r in rows], "doc_id long, text string, key string, labels string, score double")
    for templates, threshold in ((ls.TEMPLATES, 0.9), ([("a", "the mit license released under"), ("b", "permission is hereby granted x1"), ("c", "zulu"), ("d", "Ärger cc by general")], 0.6)):
        found = sorted(ls.license_scan(docs, threshold, templates).collect(), key=str)
        wanted = []
        for i, t in rows:
            n, at, base, labels, score, matches = scan_by_loops(t, templates, threshold, ls.PHRASES)
            wanted.append((i, n, len(at), at[0] if at else None, at[-1] if at else None, base, labels, score, matches))
        assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
        spans = ls.license_spans(docs, threshold, templates).collect()
        assert len(spans) == sum(w[-1] for w in wanted) and all(s.containment >= threshold for s in spans)


def test_scan_joins_hot_texts_and_large_indexes(spark, monkeypatch):
    """A text that most rows have, and an index too large to broadcast, give the same rows."""
    docs = spark.range(2500).selectExpr("id as doc_id", "if(id % 5 = 0, concat('Released under the MIT License. ', id), 'All rights reserved. Released under the MIT license.') as text")
    first = sorted(map(tuple, ls.license_scan(docs).collect()))
    assert all(r[6] in ("mit", "mit,reserved") for r in first) and len(first) == 2500
    monkeypatch.setattr(ls, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, ls.license_scan(docs).collect())) == first


def test_scan_of_empty_tables(spark):
    assert ls.license_scan(empty_documents(spark)).count() == 0
    assert ls.license_spans(empty_documents(spark)).count() == 0
    assert ls.license_scan(edge_documents(spark)).count() == len(TEXTS)


def test_prefixes_hold_a_word_of_every_match():
    templates, rng = ls.TEMPLATES, random.Random(1)
    index = ls.Index(templates, {w: rng.randrange(9) for _, t in templates for w in t.split()}, 0.9)
    for _, _, ranks, need in index.rows:
        for _ in range(20):
            assert {*rng.sample(ranks, need)} & {*ranks[: len(ranks) - need + 1]}
