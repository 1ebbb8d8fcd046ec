"""Operator 8: a Jaccard self-join on word n-grams by MinHash banding.

1. Each text gives its set of n-grams, the set's 128-bit digest and the hashes of its bands. Texts with equal sets are one class.
2. Band hashes are shuffled. The least class of those that share one is its hub; each class is a member of the cells of its bands' hubs, so two classes
   that share a band share a cell, and nothing is as long as the pairs. A cell whose members all have one lesser hub in common adds no pair and goes.
3. Sets are shuffled by cell, a large cell as pairs of blocks, and verified in full inside a block. A pair is asked for in the cell of its least common
   hub alone. Only counts and spanning ties leave a block. No cap; all links between different sets count.

n_links: the other documents whose set has a Jaccard similarity of at least `similarity` with this one's, copies included.
class_id: the least id of the documents reachable by links. kept: the document is that one.

Rows: one for each input row, repeated rows and null ids included (a class of null ids has a null class_id). A null or empty text, or one of
white space, has no n-grams and links with nothing; a pair at the limit itself is linked. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.blocks import asked, in_blocks, verified, with_components
from tallystone.llm.common import documents, map_texts
from tallystone.llm.components import drop_tables, shared_table, spread_join
from tallystone.llm.shingles import WORDS, band_hashes, bands_for, shingles

#: Classes and n-grams that one side of a block holds at most, about.
BLOCK_CLASSES, BLOCK_GRAMS = 512, 1 << 20
#: n-grams whose occurrences are held as a dense matrix at once.
DENSE_COLUMNS = 4096


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (digest of the set; null if it is empty), n_grams, bands."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            keys, sizes, hashes = [], [], []
            for text in texts:
                found = shingles(text, words)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sizes.append(len(found))
                hashes.append(band_hashes(found, bands, rows) if len(found) else [])
            return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))]

        return work

    return map_texts(docs, make, "key binary, n_grams int, bands array<long>")


def shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """A matrix of how many elements each two lists have in common; no list repeats one."""
    k = len(lists)
    sizes = np.array([len(s) for s in lists], "i8")
    elements, column = np.unique(np.concatenate(lists), return_inverse=True)
    row = np.repeat(np.arange(k), sizes)
    shared = np.bincount(column, minlength=len(elements)) > 1  # others are in no intersection
    held = shared[column]
    row, column = row[held], (np.cumsum(shared) - 1)[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((k, k), "f4" if sizes.max(initial=0) < 1 << 24 else "f8")
    for at in range(0, int(shared.sum()), DENSE_COLUMNS):
        low, high = np.searchsorted(column, [at, at + DENSE_COLUMNS])
        dense = np.zeros((k, min(DENSE_COLUMNS, int(shared.sum()) - at)), both.dtype)
        dense[row[low:high], column[low:high] - at] = 1
        both += dense @ dense.T
    return both.astype("i8")


def links_between(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """A matrix of which pairs of sets have that Jaccard similarity, compared in whole numbers."""
    sizes = np.array([len(s) for s in sets], "i8")
    common = shared_counts(sets)
    return similarity.denominator * common >= similarity.numerator * (sizes[:, None] + sizes[None, :] - common)


def linker(similarity: Fraction):
    """linked() of `verified`; data: the set's n-grams and the hubs of its class."""

    def linked(hub: int, data: list[dict], sides: np.ndarray) -> np.ndarray:
        pairs = asked(sides)
        lesser = [np.array([h for h in d["hubs"] if h < hub], "i8") for d in data]
        if any(map(len, lesser)):
            pairs &= shared_counts(lesser) == 0  # others are asked for in the cell of a lesser hub
        some = np.nonzero(pairs.any(1))[0]
        out = np.zeros(pairs.shape, bool)
        if len(some):
            out[np.ix_(some, some)] = links_between([np.frombuffer(data[i]["grams"], "u8") for i in some], similarity)
        return out & pairs

    return linked


def _digested(words: int):
    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            found = [shingles(t, words).tobytes() for t in texts]
            keys = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in found]
            return [pa.array(keys, pa.binary()), pa.array(found, pa.binary())]

        return work

    return make


def near_classes(df: DataFrame, similarity: float = 0.8, words: int = WORDS, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_links long, class_id, kept boolean."""
    bands, rows = bands_for(similarity, recall)
    docs = documents(df, id_col, text_col)
    signed = shared_table(signatures(docs, words, bands, rows))
    full = signed.where("key is not null")
    classes = shared_table(full.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands")))
    # classes whose 64 bits here are equal share all cells, and no more: links are verified on the sets
    node = F.xxhash64("key").alias("node")
    banded = classes.select(node, "n_grams", F.explode("bands").alias("band"))
    hubs = shared_table(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("classes")).where("classes > 1"))
    ties = shared_table(spread_join(banded, hubs, "band", "classes").groupBy("node", "hub").agg(F.max("n_grams").alias("n_grams")))
    of_node = ties.groupBy("node").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))  # a hub for each band at most
    ties_of = shared_table(ties.join(of_node, "node"))
    first = F.col("hubs")[0]
    cells = ties_of.groupBy("hub").agg(F.count("*").alias("members"), F.sum("n_grams").alias("grams"), F.min(first).alias("low"), F.max(first).alias("high"))
    parts = F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("parts")
    cells = shared_table(cells.where("low != high or low = hub").select("hub", "members", parts))
    placed = spread_join(ties_of, cells, "hub", "members").select("node", F.col("hub").alias("cell"), "hubs", "parts")
    members = shared_table(placed.join(classes.select(node, "key", "least", "copies"), "node").drop("node"))
    # one document of each class, by its id, brings the set; of repeated ids with other texts, the one whose set it is
    bringing = members.where("least is not null").select("least").distinct()
    texts = docs.where("doc_id is not null").join(bringing, docs.doc_id == bringing.least, "left_semi").unionByName(docs.where("doc_id is null"))
    sets = map_texts(texts, _digested(words), "key binary, grams binary").dropDuplicates(["key"]).drop("doc_id")
    placed = in_blocks(members.drop("least")).join(sets, "key")
    data = F.struct("hubs", "grams").alias("data")
    found = verified(placed.select("cell", "i", "j", "side", "key", "copies", data), linker(Fraction(str(similarity))))
    out = with_components(signed, classes, found, "doc_id", "class_id")
    drop_tables(classes, hubs, ties, ties_of, cells, members)
    return out
