"""Classifiers by held-out accuracy; the pipeline against brute force of its near-duplicate stage."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import compression_quality, subword_toxicity
from tallystone.llm.labelled import doc_crc, isotonic, sample, share_of_ones
from tests.llm.helpers import TEXTS, edge_documents, empty_documents

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def _held_out(spark, module, label, mod, rest, threshold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = doc_crc(F.col("doc_id")) % mod == rest
    model = module.fit(docs, labels, ~held)
    tested = docs.join(labels.where(held), "doc_id")
    scored = module.predict(tested, model, threshold).join(labels, "doc_id").select(label, "predicted").collect()
    return np.array([r[0] for r in scored]), np.array([r[1] for r in scored])


@needs_data
def test_toxicity_held_out(spark):
    y, p = _held_out(spark, subword_toxicity, "toxic", 3, 1, 0.7)
    assert p[y == 1].mean() >= 0.9 and p[y == 0].mean() < 0.005  # one in twenty of the label's documents holds no toxic word at all


@needs_data
def test_quality_held_out(spark):
    y, p = _held_out(spark, compression_quality, "quality", 5, 0, 0.3)
    assert p[y == 1].mean() > 0.98 and p[y == 0].mean() < 0.1


def test_misspellings_share_vectors():
    bad = ["idiot", "pathetic", "worthless"]
    rng = np.random.default_rng(2)
    plain = ["table", "window", "garden", "letter", "summer", "river", "paper", "music"]
    rows = [(" ".join(rng.choice(plain, 40)) + (" " + bad[i % 3] + " " + bad[i % 2] if i % 2 else ""), i % 2) for i in range(200)]
    score = one(subword_toxicity.fit_rows(rows))
    clean = " ".join(plain)
    assert score(clean) < 0.5 < score(clean + " idiot pathetic")
    assert score(clean + " pathetick worthles") > score(clean + " gardens summers") + 0.2


def one(model):
    scores = model.scorer()
    return lambda text: scores([text])[0]


def test_subwords_by_plain_loops():
    """As many buckets as n-grams and the word; equal n-grams have equal ones, wherever they stand."""
    st = subword_toxicity
    words = ["a", "abc", "x" * 200, "🙂é中", "abcabc", "<b>"]
    flat, sizes = st.all_subwords(words)
    at = 0
    for w, n in zip(words, sizes, strict=True):
        units = len(w.encode("utf-16-le")) // 2 + 2
        assert n == 1 + sum(max(0, units - k + 1) for k in (3, 4, 5)) and st.subwords(w) == flat[at : at + n].tolist()
        at += n
    assert len({*st.subwords("x" * 200)}) <= 12 and len({*st.subwords("abcdefgh")} & {*st.subwords("xabcdefy")}) >= 6


def plain_score(model, text):
    """By plain loops: every word as often as it stands there."""
    found, total = subword_toxicity.words(text), 0.0
    models = model.heads.shape[1] // 2
    for k in range(models if found else 0):
        above = below = 0.0
        for w in found:
            grams = subword_toxicity.subwords(w)
            weight, margin = (sum(model.heads[g, 2 * k + i] for g in grams) / len(grams) for i in (0, 1))
            above, below = above + np.exp(weight) * margin, below + np.exp(weight)
        total += above / below / models
    return 1 / (1 + np.exp(-model.slope * total - model.constant))


def test_a_score_is_of_the_whole_bag_by_plain_loops():
    rng = np.random.default_rng(4)
    model = subword_toxicity.ToxicityModel(rng.standard_normal((subword_toxicity.BUCKETS, 4)), 2.0, -1.0)
    score = one(model)
    for text in ("", "one", "Some words, of which (some) words repeat some words", "a b c d e f g h i j k l m n a b c " * 40, "x" * 300 + " y"):
        assert abs(score(text) - plain_score(model, text)) < 1e-9


def test_score_has_no_regard_to_length():
    """A text repeated keeps its score, and joined texts lie between theirs (of one model)."""
    rng = np.random.default_rng(5)
    model = subword_toxicity.ToxicityModel(rng.standard_normal((subword_toxicity.BUCKETS, 2)) * 3, 4.0, -1.0)
    score = one(model)
    texts = [" ".join(f"w{rng.integers(500)}" for _ in range(rng.integers(1, 80))) for _ in range(60)]
    assert all(abs(score(t) - score(" ".join([t] * 50))) < 1e-9 for t in texts)
    assert min(map(score, texts)) <= score("\n".join(texts)) <= max(map(score, texts))


@needs_data
def test_joined_clean_documents_stay_clean(spark):
    """Held-out clean documents, each clean alone, joined to 500 KB and more; one with toxic words all along is still caught."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = doc_crc(F.col("doc_id")) % 3 == 1
    score = one(subword_toxicity.fit(docs, labels, ~held))
    rows = docs.join(labels.where(held & F.col("toxic").isin(0, 1)), "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    clean = [r.text for r in rows if r.toxic == 0 and r.text and score(r.text) < 0.7]
    for n in (1, 50, 200, 400, len(clean)):
        assert score("\n".join(clean[:n])) < 0.3
    assert len("\n".join(clean[:400]).encode()) > 500_000
    assert score("\n".join(t + " you worthless pathetic idiot and moron" for t in clean[:300])) > 0.7


def test_training_equals_plain_loops(monkeypatch):
    """Two rounds of the trainer against loops over documents, words and buckets."""
    st = subword_toxicity
    monkeypatch.setattr(st, "BUCKETS", 97)
    monkeypatch.setattr(st, "ROUNDS", 2)
    monkeypatch.setattr(st, "BATCH", 3)
    texts = [("a bad bad word here", 1), ("good words are here", 0), ("bad people", 1), ("nice good people and words", 0), ("the bad the good", 1), ("here", 0), ("", 0), ("good the good", 0)]
    vocabulary = st.Vocabulary()
    docs, labels = [vocabulary(t) for t, _ in texts], np.array([y for _, y in texts])
    flat, sizes = np.frombuffer(vocabulary.flat, "i4"), np.frombuffer(vocabulary.sizes, "i4").astype("i8")
    found = st.train(docs, labels, docs, labels, flat, sizes, 2, 7)

    rng = np.random.default_rng(7)
    grams = [[st.subwords(w) for w in st.words(t)] for t, _ in texts]
    known = [len({i for i, d in enumerate(grams) if any(b in g for g in d)}) >= 2 for b in range(97)]
    e = rng.uniform(-1 / st.WIDTH, 1 / st.WIDTH, (97, st.WIDTH)).astype("f4").astype("f8") * np.array(known)[:, None]
    w, v, bias = rng.uniform(-1, 1, (st.WIDTH, 2)).astype("f4").astype("f8"), np.zeros(st.WIDTH), np.zeros(2)
    e_sq, v_sq, w_sq, b_sq = np.full(97, 1e-6), np.full(st.WIDTH, 1e-6), np.full((st.WIDTH, 2), 1e-6), np.full(2, 1e-6)
    share = [0.5 / (labels == k).sum() * len(labels) for k in (0, 1)]
    order = rng.permutation([i for i, d in enumerate(grams) if d])
    parts, best = [order[k : k + 3] for k in range(0, len(order), 3)], None
    for _ in range(2):
        for at in rng.permutation(len(parts)):
            ge, gv, gw, gb = np.zeros_like(e), np.zeros_like(v), np.zeros_like(w), np.zeros_like(bias)
            for i in parts[at]:
                each = [np.mean([e[b] for b in g], 0) for g in grams[i]]
                a = np.exp([v @ x for x in each])
                a = a / a.sum()
                bag = sum(x * k for x, k in zip(each, a, strict=True))
                p = np.exp(bag @ w + bias)
                p = p / p.sum() - np.eye(2)[labels[i]]
                g = p * share[labels[i]] / len(parts[at])
                gb, gw = gb + g, gw + np.outer(bag, g)
                for x, k, buckets in zip(each, a, grams[i], strict=True):
                    turn = k * ((x - bag) @ (w @ g))
                    gv = gv + turn * x
                    for b in buckets:
                        ge[b] += (k * (w @ g) + turn * v) / len(buckets)
            used = np.unique([b for i in parts[at] for g in grams[i] for b in g])
            ge *= np.array(known)[:, None]
            e_sq[used] += (ge[used] ** 2).mean(1)
            e[used] -= st.RATE * ge[used] / np.sqrt(e_sq[used])[:, None]
            for x, sq, g in ((v, v_sq, gv), (w, w_sq, gw), (bias, b_sq, gb)):
                sq += g * g
                x -= st.SOFTMAX_RATE * g / np.sqrt(sq)
        heads = e @ np.stack([v, w[:, 1] - w[:, 0]], 1)
        loss = st.log_loss(np.array([np.log(0 + 1) if not d else float(np.average([np.mean([heads[b, 1] for b in g]) for g in d], weights=np.exp([np.mean([heads[b, 0] for b in g]) for g in d]))) for d in grams]), labels)
        if best is None or loss < best[0]:
            best = loss, heads
    assert np.abs(found - best[1]).max() < 2e-3 and np.abs(found).max() > 0.1


def test_folds_train_alike_in_tasks(spark):
    rows = [(f"clean words number {i % 17} and more", 0) for i in range(40)] + [(f"a nasty insult {i % 13} here", 1) for i in range(40)]
    here, there = subword_toxicity.fit_rows(rows), subword_toxicity.fit_rows(rows, spark=spark)
    assert (here.heads == there.heads).all() and (here.slope, here.constant) == (there.slope, there.constant)


def test_isotonic_fit_equals_brute_force():
    rng = np.random.default_rng(6)
    x = rng.permutation(9).astype("f8")
    y, weight = rng.integers(0, 2, 9).astype("f8"), rng.random(9) + 0.1
    order = np.argsort(x)
    least = None
    for cuts in range(1 << 8):  # every way to cut the line into level runs
        runs, start = [], 0
        for end in [*[i + 1 for i in range(8) if cuts >> i & 1], 9]:
            runs.append(order[start:end])
            start = end
        level = [np.average(y[r], weights=weight[r]) for r in runs]
        if all(a <= b for a, b in zip(level, level[1:], strict=False)):
            loss = sum((weight[r] * (y[r] - v) ** 2).sum() for r, v in zip(runs, level, strict=True))
            least = min(least or (9e9, []), (loss, level))
    at, value = isotonic(x, y, weight)
    assert sorted({round(v, 9) for v in value}) == sorted({round(v, 9) for v in least[1]})
    assert (np.diff(at) > 0).all()


def test_evidence_is_the_difference_of_plain_compressed_sizes():
    import zstandard

    texts = [f"the good text number {i} speaks of rivers and gardens" for i in range(200)], [f"BUY {i}!!! click here >>> now" for i in range(200)]
    good, bad = map(compression_quality.dictionary, texts)
    evidence = compression_quality.Evidence(good, bad)
    for text in (texts[0][3], texts[1][5], "x" * 2000, "neither one nor the other " * 90):
        n = {}
        for name, data in (("good", good), ("bad", bad)):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=False, write_content_size=False)
            n[name] = sum(len(c.compress(text[i : i + 512].encode())) for i in range(0, len(text), 512))
        assert abs(evidence(text) - (n["bad"] - n["good"]) / len(text)) < 0.02  # parameters that the compressor tunes to a size may differ


def test_sample_is_bounded_and_obeys_the_rule(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * 50) for i in range(300)] + [(None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None), (6, 3)], "doc_id long, toxic int")
    learn = doc_crc(F.col("doc_id")) % 3 != 1
    rows = sample(docs, labels, "toxic", learn, 20, 1 << 20)
    assert len(rows) == 40 and sum(y for _, y in rows) == 20 and all(t.startswith("text") and len(t) >= 300 for t, _ in rows)
    large = docs.unionByName(spark.range(0, 300, 2).selectExpr("id as doc_id", "repeat('long text ', 1000) as text"))  # half of the texts with an even id don't fit
    assert {y: sum(z == y for _, z in sample(large.groupBy("doc_id").agg(F.max_by("text", F.length("text")).alias("text")), labels, "toxic", learn, 300, 5000)) for y in (0, 1)}[1] >= 10
    assert {y: sum(z == y for _, z in sample(docs, labels, "toxic", learn, 20, 1200)) for y in (0, 1)} in ({0: 2, 1: 2}, {0: 3, 1: 3}, {0: 2, 1: 3}, {0: 3, 1: 2})
    repeated = docs.unionByName(spark.createDataFrame([(i, f"other {i}") for i in range(300)], "doc_id long, text string"))
    assert sample(repeated, labels, "toxic", learn, 20, 1 << 20) == sample(repeated.repartition(7), labels, "toxic", learn, 20, 1 << 20)
    assert abs(share_of_ones(labels, "toxic", F.lit(True)) - 0.5) < 0.05
    assert share_of_ones(labels.limit(0), "toxic", F.lit(True)) == 0.5
    assert spark.range(1).select(doc_crc(F.lit(12))).first()[0] == zlib.crc32(b"12")


@pytest.mark.parametrize("module", [compression_quality, subword_toxicity])
def test_classifiers_over_edge_rows(spark, module):
    docs = edge_documents(spark)
    label = "quality" if module is compression_quality else "toxic"
    for rows in ([], [(1, 1), (8, 0), (6, 0)], [(1, 1)], [(None, None)]):
        model = module.fit(docs, spark.createDataFrame(rows, f"doc_id long, {label} int"), F.lit(True))
        scored = module.predict(docs, model, 0.5).collect()
        assert len(scored) == len(TEXTS)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
        assert module.predict(empty_documents(spark), model, 0.5).count() == 0


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    words = ["table", "window", "garden", "letter", "summer", "river", "paper", "music", "stone", "forest"]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words, 60))
        toxic, bad = int(i % 6 == 0), int(i % 5 == 0)
        if toxic:
            text += " idiot pathetic worthless idiot"
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1 - bad, toxic))
    clean = {i for i, q, t in labels if q and not t}
    twice = [r for r in rows if r[0] in clean][:5]
    rows += [(1000 + i, r[1], *r[2:]) for i, r in enumerate(rows[:60])] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    rows += twice + [(None, r[1], *r[2:]) for r in twice] + [(twice[0][0], "another clean text of the same id about a river and a forest", "en", "s", 60)]
    rows = [(*r, "k", 0.5, "x", None) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `my-col` string, _score double, `row` string, key binary")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(clean - kept["toxicity"]) <= 2 and len(toxic & kept["toxicity"]) <= 8
    assert len(clean - kept["quality"]) <= 6
    assert not any(i is not None and 1000 <= i < 1060 and i - 1000 in kept["quality"] for i in kept["near_duplicates"])
    assert kept["near_duplicates"] == kept["packing"]
    left = [r.text for r in spark.read.parquet(f"{tmp_path}/near_duplicates").collect() if r.text]
    assert len(left) == len({t.lower() for t in left})  # one row of each group, whatever its id
    before = [r.text.lower() for r in spark.read.parquet(f"{tmp_path}/quality").collect() if r.text]
    assert {t.lower() for t in left} == {*before}  # texts here are copies or far from each other
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
