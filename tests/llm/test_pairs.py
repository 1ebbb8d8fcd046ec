"""Links of vectors and texts against brute force; shards and packings by their laws."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tallystone.llm import ngram_join, packing, sharding, vector_links
from tallystone.llm.components import connected_components
from tallystone.llm.ngram_join import near_classes
from tallystone.llm.packing import pack_texts
from tallystone.llm.sharding import admitted_shares, balanced_shards
from tallystone.llm.shingles import bands_for, shingles
from tests.llm.helpers import TEXTS, edge_documents, empty_documents

WORDS = P.path("word_bpe_49k.json")


def closure(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (5, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = closure(500, [(a, b) for a, b in edges if b is not None])
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[root[i]] for i in got}
    assert {*got} == {x for a, b in edges if b is not None and a != b for x in (a, b)}


def corpus() -> list[str]:
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 120))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    hot = [f"w{i}" for i in range(200)]
    out += [" ".join([*hot[:k], f"edit{k}", *hot[k + 1 :]]) for k in range(0, 200, 3)]
    return out + [out[0]] * 5 + ["", " ", "one", "one", "ONE"]


@pytest.mark.parametrize("block", [512, 16])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    texts = corpus()
    sets = [{*shingles(t).tolist()} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = closure(len(texts), links)
    degree = np.zeros(len(texts), int)
    for a, b in links:
        degree[[a, b]] += 1
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (degree[i], least[root[i]], least[root[i]] == i) for i in range(len(texts))}


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = bands_for(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999 and bands * rows <= 224


def test_ngram_join_over_edge_rows(spark):
    rows = near_classes(edge_documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r.n_links for r in rows) == [0] * (len(TEXTS) - 2) + [1, 1]
    assert all(r.kept and r.n_links == 1 for r in rows if r.doc_id == 1)
    assert near_classes(empty_documents(spark)).count() == 0


def vectors() -> list[tuple]:
    rng = np.random.default_rng(1)
    out = []
    for label in range(3):
        for _ in range(40):
            c = rng.standard_normal(24)
            for _ in range(rng.integers(1, 5)):
                out.append((len(out), (c + 0.16 * rng.standard_normal(24)).astype("f4").tolist(), label))
    out += [(len(out) + i, out[0][1], 0) for i in range(30)]
    n = len(out)
    bad = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, out[0][1][:12]]
    return out + [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 50, out[0][1], None), (None, [1.0] * 24, 1)]


@pytest.mark.parametrize("side", [2048, 20, 2])
def test_vector_links_equal_brute_force(spark, side):
    rows = vectors()
    assert (vector_links.tables_for(128, 0.93, 0.9999, side)[0] > 0) == (side == 2)  # one cell, a cell in blocks, tables of cells
    fine = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and lab is not None for _, v, lab in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], "f4").astype("f8"), np.array(rows[j][1], "f4").astype("f8")
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links.append((i, j))
    root = closure(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 40), rows[i][0] if rows[i][0] is not None else 1 << 40)
    degree = np.zeros(len(rows), int)
    for a, b in links:
        degree[[a, b]] += 1
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, key string, place string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.vector_links(df, side=side).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {r[0]: (degree[i], least[root[i]], least[root[i]] == r[0]) for i, r in enumerate(rows) if r[0] is not None}
    assert got[None] == (0, None, True)
    assert vector_links.vector_links(df.limit(0)).count() == 0


def test_many_tables_of_cells_lose_no_planted_link(spark):
    """1,000 pairs just above the limit among 2,000 vectors of one label, with so small sides that some thirty tables of deep cells are used instead of one compared in full."""
    rng, rows, wanted = np.random.default_rng(17), [], 0
    depth, tables = vector_links.tables_for(2048, 0.93, 0.9999, 16)
    assert depth > 3 and tables > 10
    for i in range(1000):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.9301 * a + np.sqrt(1 - 0.9301**2) * b).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in vector_links.vector_links(df, side=16).collect()}
    wanted = sum(found[2 * i] >= 1 and found[2 * i + 1] >= 1 for i in range(1000))
    assert wanted >= 999


def test_links_of_very_large_and_very_small_components(spark):
    rows = [(1, [1e200] * 4), (2, [3e200] * 4), (3, [1e-200] * 4), (4, [1e200, -1e200, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0, 0.0]), (6, [1e308, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.vector_links(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_windows_are_searched_in_sorted_ranks():
    rng = np.random.default_rng(3)
    one, other = rng.standard_normal((300, 32)), rng.standard_normal((170, 32))
    other[:50] = other[50:100]  # ties
    brute = (np.abs(one[:, None, :] - other[None, :, :]) <= 0.7).sum(2)
    for at, counts in vector_links.window_counts(one, other, 0.7):
        assert (counts == brute[at : at + len(counts)]).all()


def test_tables_keep_the_pairs_below_the_square():
    cost = []
    for n in (1 << 12, 1 << 17, 1 << 22, 1 << 27):
        depth, tables = vector_links.tables_for(n, 0.93, 0.9999)
        near, far = vector_links.meeting(vector_links.CELL), vector_links.meeting(vector_links.CELL * vector_links.spread(0.93) / 2**0.5)
        assert depth == 0 or 1 - (1 - near**depth) ** tables >= 0.9999
        cost.append(n * tables * max(n * far**depth, vector_links.SIDE))
    assert all(b / a < 32**1.5 for a, b in zip(cost[1:], cost[2:], strict=False))


def test_calibrated_count():
    needed = vector_links.needed_collisions(0.9999)
    assert 16 < needed < 32
    assert vector_links.needed_collisions(0.5) > needed


def _laws(rows, shards: int) -> None:
    counts = [sum(r.shard == b for r in rows) for b in range(shards)]
    assert max(counts) - min(counts) <= 1
    for b in range(shards):
        assert sorted(r.slot for r in rows if r.shard == b) == list(range(counts[b]))


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(3)
    texts = ["hot text"] * 700 + [f"pair {i}" for i in range(200) for _ in range(2)] + [f"group {i}" for i in range(20) for _ in range(11)] + [f"single {i}" for i in range(780)]
    rng.shuffle(texts)
    rows = balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    _laws(rows, 16)
    where: dict[str, set] = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows", None)
    split = sum(len(s) > 1 for t, s in where.items() if t != "hot text")
    assert split <= 6 and len(where["hot text"]) <= 10


def test_shards_where_everything_is_linked(spark):
    texts = [f"pair {i // 2}" for i in range(1000)]
    rows = balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    _laws(rows, 4)
    where: dict[str, set] = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) < 0.5 * 500 * 0.75  # at random three quarters would be cut


def test_cut_links_of_small_tables_against_exhaustive_search(spark):
    from itertools import permutations

    def cut(groups, where) -> int:
        return sum(where[i] != where[j] for i in range(len(groups)) for j in range(i) if groups[i] == groups[j])

    rng = random.Random(12)
    total = best_total = random_total = 0
    for _ in range(4):
        groups = sorted(rng.randrange(4) for _ in range(9))
        even = [0, 0, 0, 1, 1, 1, 2, 2, 2]
        every = {p for p in set(permutations(even))}
        rows = balanced_shards(spark.createDataFrame([(i, f"text {g}") for i, g in enumerate(groups)], "doc_id long, text string"), 3).collect()
        _laws(rows, 3)
        total += cut(groups, [r.shard for r in sorted(rows, key=lambda r: r.doc_id)])
        cuts = [cut(groups, p) for p in every]
        best_total, random_total = best_total + min(cuts), random_total + sum(cuts) / len(cuts)
    assert best_total <= total <= (best_total + random_total) / 2


def test_shards_over_edge_rows(spark):
    rows = balanced_shards(edge_documents(spark), 4).collect()
    assert len(rows) == len(TEXTS)
    _laws(rows, 4)
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert balanced_shards(empty_documents(spark)).count() == 0


def test_shares_respect_room():
    wanted = [[0, 100, 0], [10, 0, 0], [0, 100, 0]]
    share = admitted_shares(wanted, [0, 20, 0])
    assert wanted[0][1] * share[1] + wanted[2][1] * share[1] <= 20 + wanted[1][0] * share[0] + 1e-3
    assert admitted_shares([[0, 5], [5, 0]], [0, 0]) == [1.0, 1.0]


def _packed(rows, limit: int) -> int:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by)


def test_packing_equals_the_library_and_is_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 150)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "quick", "fox", "unusualword", "é"]) for _ in range(rng.choice([1, 5, 30, 60, 250]))) for _ in range(600)]
    rows = pack_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS, 128).collect()
    n = _packed(rows, 128)
    lengths = [r.length for r in rows]
    assert n <= len(packing.best_fit(list(range(len(lengths))), lengths, [], 128)) + 2  # all pieces in one task
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(a, min(128, len(ids) - a)) for a in range(0, len(ids), 128)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[a : a + 128], "<u4").tobytes()) for a in range(0, len(ids), 128)]


def test_sequences_that_fill_badly_in_every_block_meet_until_one_block_is_left(spark, monkeypatch):
    # blocks of 8 pieces: half of them can't be paired where they are, all can together
    monkeypatch.setattr(packing, "BLOCK", 8)
    rng = random.Random(8)
    lengths = [60] * 96 + [40] * 96
    rng.shuffle(lengths)
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.packed(pieces.repartition(3).checkpoint(), 100).collect()
    assert sorted(r.doc_id for r in rows) == [*range(192)]
    assert _packed(rows, 100) <= 100  # 96 is the least


def test_small_packings_equal_the_optimum():
    rng = random.Random(9)

    def least(sizes: tuple[int, ...], limit: int) -> int:
        best = len(sizes)

        def place(at: int, room: list[int]) -> None:
            nonlocal best
            if len(room) >= best:
                return
            if at == len(sizes):
                best = len(room)
                return
            for k in range(len(room)):
                if room[k] >= sizes[at] and room[k] not in room[:k]:
                    place(at + 1, [*room[:k], room[k] - sizes[at], *room[k + 1 :]])
            place(at + 1, [*room, limit - sizes[at]])

        place(0, [])
        return best

    for seed in range(12):
        lengths = [rng.randrange(10, 70) for _ in range(11)]
        bins = packing.evolve(lengths, 100, [], seed)
        assert sorted(i for b in bins for i in b) == list(range(11)) and max(packing.fills(bins, lengths)) <= 100
        assert len(bins) == least(tuple(sorted(lengths, reverse=True)), 100)


def test_pieces_that_fill_no_sequence_end_the_search(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    rows = pack_texts(spark.createDataFrame([(i, "the " * 70) for i in range(100)], "doc_id long, text string"), WORDS, 128).collect()
    assert _packed(rows, 128) == 100


def test_packing_over_edge_rows(spark):
    rows = pack_texts(edge_documents(spark), WORDS).collect()
    _packed(rows, 4096)
    assert len([r for r in rows if r.doc_id == 1]) == 2
    assert {r.length for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 6) == 40_001
    assert pack_texts(empty_documents(spark), WORDS).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 200).tolist()
    one, other = packing.seeded(lengths, 128, rng), packing.best_fit(list(range(200)), lengths, [], 128)
    for _ in range(10):
        child = packing.crossover(one, other, lengths, 128, rng)
        assert sorted(i for b in child for i in b) == list(range(200))
        assert max(packing.fills(child, lengths)) <= 128
        one = child


def test_sharding_module_uses_no_python_workers():
    source = open(sharding.__file__).read()
    assert not any(x in source for x in ("pandas", "mapIn", "applyIn", "udf", ".rdd"))
