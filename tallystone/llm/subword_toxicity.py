"""Operator 6: toxicity by bags of subwords.

A word is the mean of the embeddings of its hashed character n-grams and of itself. A document's bag is the average of all its words, each as often as it stands there, with
weights exp(v . word) that are learnt jointly with embeddings and softmax: a label is of a whole document, and few of its words decide. A linear softmax
over the bag gives the class. The average has no regard to length: the bag of joined texts lies between their bags, so its margin is never above the greatest of theirs, and a
text repeated keeps its score.

Embeddings, weights and softmax are trained in numpy, FOLDS models in as many tasks, each without a share of the documents; their margins are averaged. A model's rounds end
when the loss of its own share no longer falls; the shares calibrate the score, in which either label counts half: labels are few, and a sample by label has not their
share. Unseen misspellings share n-grams, and so vectors, with what was seen.

Learned from at most `per_class` whole documents and `class_bytes` bytes of either label (labelled.sample). Scored: every whole text.

Rows: one for each input row, repeated rows and null ids included. A null or empty text has an empty bag and gets the score of the
constant. Equal texts have equal scores. Other columns are not read; an empty table gives an empty result. If either label is missing among what may be
learned, every score is the share of label 1, kept off 0 and 1 by a hundredth.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import hand_back, map_texts
from tallystone.llm.common import documents as view
from tallystone.llm.labelled import logistic, sample

BUCKETS, WIDTH = 1 << 17, 8
SMALLEST, LARGEST = 3, 5
#: Shares that documents are dealt into, and models whose margins are averaged, each of which leaves another share apart.
SHARES, FOLDS = 4, 2
#: Rounds at most, and those without a lower loss after which training ends.
ROUNDS, PATIENCE = 30, 3
BATCH, RATE, SOFTMAX_RATE = 64, 0.3, 0.1

#: Factor of the n-grams' hash.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of texts whose new words are looked up at once, and words that a task remembers.
TOGETHER, REMEMBERED = 1 << 19, 150_000

_words = re.compile(r"[^\s.,;:!?()\[\]\"«»]+").findall


def words(text: str) -> list[str]:
    return _words(text.lower())


def all_subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words, one word after another, and how many each has: of the n-grams of the word between marks, and of the word itself. A mark is a sign that
    no word has."""
    codes = np.frombuffer("".join([f".{w}." for w in found]).encode("utf-16-le", "surrogatepass"), "<u2").astype("u8")
    marks = np.flatnonzero(codes == ord("."))
    first, sizes = marks[0::2], marks[1::2] - marks[0::2] + 1
    buckets, of_word = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in found], "i4")], [np.arange(len(found), dtype="i4")]
    with np.errstate(over="ignore"):
        for n in range(SMALLEST, LARGEST + 1):
            counts = np.maximum(sizes - n + 1, 0)
            at = segments(first, counts)
            h = np.full(len(at), n, "u8")
            for k in range(n):
                h = (h + codes[at + k]) * ODD
                h ^= h >> np.uint64(29)
            buckets.append(((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype("i4"))
            of_word.append(np.repeat(np.arange(len(found), dtype="i4"), counts))
    owner = np.concatenate(of_word)
    return np.concatenate(buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(found))


def subwords(word: str) -> list[int]:
    return all_subwords([word])[0].tolist()


def bag_margin(counts: np.ndarray, weights: np.ndarray, margins: np.ndarray) -> float:
    """The average of word margins, weighed by counts and the exponentials of weights; 0 without words."""
    if not len(counts):
        return 0.0
    share = counts * np.exp(weights - weights.max())
    return float(share @ margins / share.sum())


@dataclass(frozen=True)
class ToxicityModel:
    """heads: of every bucket the weight and the margin in each of the models, of which a word has the means; slope and constant make a score of the mean margin of a bag."""

    heads: np.ndarray
    slope: float
    constant: float

    def word_rows(self, found: list[str]) -> list[bytes]:
        """Each word's weights and margins, as bytes."""
        flat, sizes = all_subwords(found)
        rows = (np.add.reduceat(self.heads[flat], begins(sizes)) / sizes[:, None]).tobytes()
        width = 8 * self.heads.shape[1]
        return [rows[i : i + width] for i in range(0, len(rows), width)]

    def scorer(self):
        """A function from texts to their scores. It remembers words in two generations: at REMEMBERED words they become the old one, from which those that are met again
        come back, and the one before is dropped."""
        known: dict[str, bytes] = {}
        old: dict[str, bytes] = {}
        models = self.heads.shape[1] // 2

        def of_words(found: list[str]) -> float:
            held = np.frombuffer(b"".join(map(known.__getitem__, found))).reshape(-1, 2 * models)
            ones = np.ones(len(found))
            margin = sum(bag_margin(ones, held[:, 2 * k], held[:, 2 * k + 1]) for k in range(models)) / models
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.constant))))

        def together(texts: list[str]) -> list[float]:
            nonlocal known, old
            if len(known) >= REMEMBERED:
                known, old = {}, known
            found = [words(t) for t in texts]
            new = set().union(*found).difference(known)
            known.update((w, old[w]) for w in new.intersection(old))
            new = list(new.difference(old))
            if new:
                known.update(zip(new, self.word_rows(new), strict=True))
            return [of_words(f) for f in found]

        def scores(texts: list[str]) -> list[float]:
            out: list[float] = []
            at = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= TOGETHER or i + 1 == len(texts):
                    out += together(texts[at : i + 1])
                    at, size = i + 1, 0
            return out

        return scores


class Vocabulary:
    """Words as numbers, and the buckets of all of them in one flat array, one word after another; lists of numbers would take many times as much."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.flat, self.sizes = array("i"), array("i")

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of a text and how often each stands there."""
        counts = Counter(words(text))
        new = [w for w in counts if w not in self.ids]
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            flat, sizes = all_subwords(new)
            self.flat.frombytes(flat.tobytes())
            self.sizes.frombytes(sizes.astype("i4").tobytes())
        return np.fromiter(map(self.ids.__getitem__, counts), "i4", len(counts)), np.fromiter(counts.values(), "f4", len(counts))


def begins(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, one after another."""
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("i8")


def segments(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of a flat array, one run after another."""
    return np.repeat(starts - begins(sizes), sizes) + np.arange(sizes.sum())


def balanced(labels: np.ndarray) -> np.ndarray:
    """Weights by which either label counts half."""
    return np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)


def log_loss(margins: np.ndarray, labels: np.ndarray) -> float:
    """Of balanced classes, after the best slope and constant."""
    weight, scale = balanced(labels), float(margins.std()) or 1.0
    slope, constant = logistic(margins / scale, labels, weight, ridge=0.05)
    z = np.clip(slope * margins / scale + constant, -30, 30)
    return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - labels * z)).mean())


class Batch:
    """Some documents as pairs (document, word of the batch) with counts, and the buckets of its words; both also in the order in which their gradients are added up."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
        lengths = np.array([len(w) for w, _ in docs])
        found, at = np.unique(np.concatenate([w for w, _ in docs]), return_inverse=True)
        self.labels, self.first = labels, begins(lengths)
        self.word, self.count = at.astype("i4"), np.concatenate([c for _, c in docs])
        self.doc = np.repeat(np.arange(len(docs), dtype="i4"), lengths)
        self.by_word = np.argsort(self.word, kind="stable").astype("i4")
        self.word_first = np.searchsorted(self.word[self.by_word], np.arange(len(found)))
        lengths = sizes[found]
        self.sizes = lengths.astype("f4")
        self.gram = flat[segments(starts[found], lengths)]
        self.gram_first = begins(lengths)
        order = np.argsort(self.gram, kind="stable")
        self.used, self.used_first = np.unique(self.gram[order], return_index=True)
        self.gram_word = np.repeat(np.arange(len(found), dtype="i4"), lengths)[order]

    def gradients(self, e: np.ndarray, v: np.ndarray, w: np.ndarray, bias: np.ndarray, share: np.ndarray):
        """Of the weighed mean log loss, by the embeddings of used buckets, v, w and bias."""
        each = np.add.reduceat(e[self.gram], self.gram_first) / self.sizes[:, None]
        weight = (each @ v)[self.word]
        part = self.count * np.exp(weight - np.maximum.reduceat(weight, self.first)[self.doc])
        part /= np.add.reduceat(part, self.first)[self.doc]
        of_pair = each[self.word]
        bag = np.add.reduceat(part[:, None] * of_pair, self.first)
        z = bag @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), self.labels] -= 1
        g = (p * share[self.labels][:, None] / len(p)).astype("f4")
        by_bag = (g @ w.T)[self.doc]
        by_weight = part * ((of_pair - bag[self.doc]) * by_bag).sum(1)
        by_each = np.add.reduceat((part[:, None] * by_bag + by_weight[:, None] * v)[self.by_word], self.word_first) / self.sizes[:, None]
        return np.add.reduceat(by_each[self.gram_word], self.used_first), by_weight @ of_pair, bag.T @ g, g.sum(0)


def train(docs: list, labels: np.ndarray, held: list, held_labels: np.ndarray, flat: np.ndarray, sizes: np.ndarray, least_documents: int, seed: int) -> np.ndarray:
    """The weight and margin of every bucket after joint training of embeddings E, weights v and softmax w by Adagrad: E @ v and E @ (w1 - w0)."""
    rng = np.random.default_rng(seed)
    starts, seen = begins(sizes), np.zeros(BUCKETS, "i4")
    for d, _ in docs:
        seen[np.unique(flat[segments(starts[d], sizes[d])])] += 1
    known = (seen >= least_documents).astype("f4")[:, None]
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype("f4") * known
    w, v, bias = rng.uniform(-1, 1, (WIDTH, 2)).astype("f4"), np.zeros(WIDTH, "f4"), np.zeros(2, "f4")
    e_sq, v_sq, w_sq, b_sq = (np.full(n, 1e-6, "f4") for n in (BUCKETS, v.shape, w.shape, 2))
    share = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)]) * len(labels)
    order = rng.permutation([i for i, d in enumerate(docs) if len(d[0])])
    parts = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
    batches = [Batch([docs[i] for i in part], labels[part], flat, sizes, starts) for part in parts]
    best, best_loss, since = np.zeros((BUCKETS, 2), "f4"), math.inf, 0
    for _ in range(ROUNDS):
        for at in rng.permutation(len(batches)):
            batch = batches[at]
            ge, gv, gw, gb = batch.gradients(e, v, w, bias, share)
            ge *= known[batch.used]
            e_sq[batch.used] += (ge * ge).mean(1)
            e[batch.used] -= RATE * ge / np.sqrt(e_sq[batch.used])[:, None]
            v_sq += gv * gv
            v -= SOFTMAX_RATE * gv / np.sqrt(v_sq)
            w_sq += gw * gw
            w -= SOFTMAX_RATE * gw / np.sqrt(w_sq)
            b_sq += gb * gb
            bias -= SOFTMAX_RATE * gb / np.sqrt(b_sq)
        now = e @ np.stack([v, w[:, 1] - w[:, 0]], 1)
        loss = log_loss(bag_margins(held, now, flat, sizes), held_labels)
        since += 1
        if loss < best_loss:
            best, best_loss, since = now, loss, 0
        elif since >= PATIENCE:
            break
    return best.astype("f8")


def bag_margins(docs: list[tuple[np.ndarray, np.ndarray]], heads: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = begins(sizes)
    per_word = np.stack([np.add.reduceat(heads[:, k][flat], first) / sizes for k in (0, 1)], 1)
    return np.array([bag_margin(c, per_word[d, 0], per_word[d, 1]) for d, c in docs])


def shares_of(labels: np.ndarray) -> np.ndarray:
    """Each label is dealt evenly."""
    turn = np.zeros(len(labels), "i8")
    for y in (0, 1):
        turn[labels == y] = np.arange((labels == y).sum()) % SHARES
    return turn


@dataclass(frozen=True)
class Bags:
    """Documents as numbers: their distinct words and counts one document after another, the buckets of all words one word after another, and labels. Texts and words are left behind."""

    words: np.ndarray
    counts: np.ndarray
    lengths: np.ndarray
    flat: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int]]) -> Bags:
        vocabulary = Vocabulary()
        docs = [vocabulary(t) for t, _ in rows]
        found, counts = (np.concatenate([d[i] for d in docs]) for i in (0, 1))
        flat, sizes = np.array(vocabulary.flat, "i4"), np.array(vocabulary.sizes, "i4")
        return cls(found, counts, np.array([len(d) for d, _ in docs], "i4"), flat, sizes, np.array([y for _, y in rows], "i4"))

    def docs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.cumsum(self.lengths)[:-1]
        return list(zip(np.split(self.words, cuts), np.split(self.counts, cuts), strict=True))


def train_fold(bags: Bags, fold: int, least_documents: int) -> tuple[np.ndarray, list[int], list[float]]:
    """The heads of a model that leaves share `fold` apart, the places of that share, and the margins of its bags. With few documents of a label none is left apart."""
    docs, labels, sizes = bags.docs(), bags.labels, bags.sizes.astype("i8")
    everyone = np.arange(len(docs))
    apart = everyone[shares_of(labels) == fold] if min(labels.sum(), (1 - labels).sum()) >= 2 * SHARES else everyone
    rest = np.setdiff1d(everyone, apart) if len(apart) < len(docs) else apart
    held = [docs[i] for i in apart]
    heads = train([docs[i] for i in rest], labels[rest], held, labels[apart], bags.flat, sizes, least_documents, fold)
    return heads, apart.tolist(), bag_margins(held, heads, bags.flat, sizes).tolist()


def train_in_tasks(spark: SparkSession, bags: Bags, least_documents: int) -> list[tuple[np.ndarray, list[int], list[float]]]:
    """train_fold of every fold, each in a task of its own; the bags, bounded by the sample, are broadcast."""
    held = spark.sparkContext.broadcast(bags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in batch.column("id").to_pylist():
                heads, apart, margins = train_fold(held.value, fold, least_documents)
                hand_back()
                yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([heads.tobytes()]), pa.array([apart]), pa.array([margins])], ["fold", "heads", "apart", "margins"])

    found = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "fold long, heads binary, apart array<long>, margins array<double>").collect()
    held.destroy()
    return [(np.frombuffer(r["heads"]).reshape(BUCKETS, 2), r["apart"], r["margins"]) for r in sorted(found)]


def fit_rows(rows: list[tuple[str, int]], least_documents: int = 4, spark: SparkSession | None = None) -> ToxicityModel:
    """least_documents: a bucket that fewer training documents hold has no embedding, as what one document alone has would be learned by heart. Without a session the
    folds are trained here, one after another."""
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        share = min(max(ones / len(rows), 0.01), 0.99) if rows else 0.01
        return ToxicityModel(np.zeros((BUCKETS, 2)), 0.0, math.log(share / (1 - share)))
    if not any(words(t) for t, _ in rows):
        return ToxicityModel(np.zeros((BUCKETS, 2)), 0.0, math.log(ones / (len(rows) - ones)))
    bags = Bags.of(rows)
    folds = train_in_tasks(spark, bags, least_documents) if spark else [train_fold(bags, k, least_documents) for k in range(FOLDS)]
    labels = bags.labels
    tried, margin = (np.concatenate([f[i] for f in folds]) for i in (1, 2))
    tried = tried.astype("i8")
    scale = float(margin.std()) or 1.0
    slope, constant = logistic(margin / scale, labels[tried], balanced(labels[tried]), ridge=0.05)
    return ToxicityModel(np.concatenate([f[0] for f in folds], 1), float(slope / scale), float(constant))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 2000, class_bytes: int = 24 << 20, least_documents: int = 4) -> ToxicityModel:
    """learn: which labels may be used, over doc_id. least_documents: as in fit_rows."""
    return fit_rows(sample(documents, labels, label, learn, per_class, class_bytes), least_documents, documents.sparkSession)


def score_texts(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, the text (null: empty) if keep_text, score double (0 to 1, higher: label 1 likelier)."""
    held = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: a few numbers for each bucket

    def make():
        scores = held.value.scorer()
        return lambda texts: [pa.array(scores(texts), pa.float64())]

    return map_texts(view(df, id_col, text_col), make, "score double", keep_text)


def predict(df: DataFrame, model: ToxicityModel, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted int (1 if score >= threshold)."""
    return score_texts(df, model, id_col, text_col).withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
