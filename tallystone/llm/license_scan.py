"""Operator 12: license scans by an exact set-similarity join of text blocks with notice templates.

1. Occurrences of the templates' words are counted over all texts. The rarest word comes first in every set.
2. Each text is read once: its words, the places of exact phrases (base), and those of its blocks that hold a prefix word. A block is a sentence of a line
   (a line break, or one of .!? before white space, ends it); one of over SPAN words is covered by runs of SPAN words, every SPAN / 2.
3. Blocks of distinct texts are exploded by word and joined with the index of template prefixes. With n of a template's words needed, two sets that share n share one of
   the template's first size - n + 1 words. Pairs whose block has too few words (length) or too few words left after the shared one on either side
   (position) go; the others are verified by whole intersection. None that meets the threshold is lost.
4. Texts with matches bring their labels to all their rows.

Rows: one for each input row, repeated rows and null ids included; a null text is the empty one, with no words, places or labels and score 0. Only A-Z are
lower-cased. A block at the threshold itself matches. A text's score is its greatest containment, 1 where a phrase stands. Labels are sorted, each once. Other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import documents, map_texts, slices
from tallystone.llm.components import shared_table, spread_join

#: Words of a block at most.
SPAN = 64
#: Rows of the index of prefixes up to which it is broadcast, by count; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000

#: Phrases whose places are counted, with their labels (fixed values of the task).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of public licenses (fixed values, in the words of their texts), with their labels.
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Over UTF-8: bytes from 0x80 on are those of characters from U+0080 on.
_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_pieces = re.compile(rb"\n|[.!?][\t-\r ]").split


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return text.encode().lower()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand one after another."""
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def needed(size: int, threshold: float) -> int:
    """Words of a template of that size that a block must have."""
    return max(1, math.ceil(Fraction(str(threshold)) * size))


class Index:
    """Template sets in the order of their words' frequency, rarest first; ties by the word."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float):
        sets = [{*map(bytes.decode, _words(lowered(t)))} for _, t in templates]
        self.rank = {w: i for i, w in enumerate(sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w)))}
        #: (template, label, its ranks in order, words needed)
        self.rows = [(i, label, sorted(self.rank[w] for w in s), needed(len(s), threshold)) for i, ((label, _), s) in enumerate(zip(templates, sets, strict=True)) if s]
        self.prefixes = {r for _, _, ranks, n in self.rows for r in ranks[: len(ranks) - n + 1]}


def word_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """Occurrences over all texts of the templates' words: as many numbers as they have words."""
    known = frozenset(w for _, t in templates for w in _words(lowered(t)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                counts.update(filter(known.__contains__, _words(lowered(text))))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


BASE = "n_words long, n_base long, first_word long, last_word long, base_labels string"


def read_texts(docs: DataFrame, index: Index, phrases: dict[str, str]) -> DataFrame:
    """doc_id, the columns of BASE, key (digest of a text that has blocks, else null), and its blocks: first words, sizes, and ranks of their known words in order."""
    asked = [(_words(lowered(p)), label) for p, label in phrases.items()]
    rank = {w.encode(): r for w, r in index.rank.items()}
    prefixes = frozenset(w for w, r in rank.items() if r in index.prefixes)

    def blocks_of(low: bytes) -> list[tuple]:
        found, start = [], 0
        for piece in _pieces(low):
            words = _words(piece)
            if not prefixes.isdisjoint(words):
                for at in range(0, max(1, len(words) - SPAN // 2), SPAN // 2):
                    part = words[at : at + SPAN]
                    if not prefixes.isdisjoint(part):
                        found.append((start + at, len(part), sorted({rank[w] for w in part if w in rank})))
            start += len(words)
        return found

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            rows = []
            for text in texts:
                low = lowered(text)
                words = _words(low)
                at = [(label, found) for p, label in asked if (found := places(words, p))]
                every = [x for _, found in at for x in found]
                blocks = [] if prefixes.isdisjoint(words) else blocks_of(low)
                key = hashlib.blake2b(low, digest_size=16).digest() if blocks else None
                labels = ",".join(sorted({label for label, _ in at}))
                rows.append((len(words), len(every), min(every, default=None), max(every, default=None), labels, key, *([b[i] for b in blocks] for i in range(3))))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

        return work

    return map_texts(docs, make, f"{BASE}, key binary, starts array<bigint>, sizes array<int>, ranks array<array<int>>")


def containment_join(blocks: DataFrame, index: Index) -> DataFrame:
    """blocks (key, start, size, ranks: sorted distinct array) with the templates that they hold: template, label, containment. Only true pairs, each once."""
    spark = blocks.sparkSession
    rows = [(r, at, t, label, ranks, n) for t, label, ranks, n in index.rows for at, r in enumerate(ranks[: len(ranks) - n + 1])]
    prefixes = spark.createDataFrame(rows, "rank int, at int, template int, label string, words array<int>, need int")
    probes = blocks.select("key", "start", "size", "ranks", F.posexplode("ranks").alias("place", "rank"))
    met = probes.join(F.broadcast(prefixes) if len(rows) <= MOST_BROADCAST else prefixes, "rank")
    long_enough = F.size("ranks") >= F.col("need")
    left = 1 + F.least(F.size("words") - F.col("at") - 1, F.size("ranks") - F.col("place") - 1)
    common = F.array_intersect("ranks", "words")
    pairs = met.where(long_enough & (left >= F.col("need"))).withColumn("common", common)
    # a pair meets at each prefix word that both have: it counts where it meets first
    true = pairs.where((F.size("common") >= F.col("need")) & (F.col("common")[0] == F.col("rank")))
    return true.select("key", "start", "size", "template", "label", (F.size("common") / F.size("words")).alias("containment"))


def license_scan(df: DataFrame, threshold: float = 0.9, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of BASE, labels string, score double, n_matches long (blocks and templates that match)."""
    docs = documents(df, id_col, text_col)
    read, matches, counts = _matched(docs, threshold, templates, phrases)
    per_text = matches.groupBy("key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"), F.count("*").alias("n"))
    known = shared_table(counts.join(per_text, "key", "left"))
    rows = read.drop("starts", "sizes", "ranks")
    found = spread_join(rows.where("key is not null"), known, "key", "rows").unionByName(rows.where("key is null"), allowMissingColumns=True)
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return found.select("doc_id", *[x.split()[0] for x in BASE.split(", ")], labels.alias("labels"), score.alias("score"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))


def _matched(docs: DataFrame, threshold: float, templates: list[tuple[str, str]], phrases: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows read, the matches of distinct texts, and (key, rows) of those that have blocks."""
    index = Index(templates, word_counts(docs, templates), threshold)
    read = shared_table(read_texts(docs, index, phrases))
    # copies of a text are one; how many rows have it is known for the way back
    texts = read.where("key is not null").groupBy("key").agg(F.first(F.arrays_zip("starts", "sizes", "ranks")).alias("blocks"), F.count("*").alias("rows"))
    texts = shared_table(texts)
    blocks = texts.select("key", F.explode("blocks").alias("b")).select("key", F.col("b.starts").alias("start"), F.col("b.sizes").alias("size"), F.col("b.ranks").alias("ranks"))
    return read, containment_join(blocks, index), texts.select("key", "rows")


def license_spans(df: DataFrame, threshold: float = 0.9, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, size, template, label, containment): every block of every row that holds a template, by its first word and number of words."""
    read, matches, counts = _matched(documents(df, id_col, text_col), threshold, templates, {})
    # a text has few matches against its rows: they travel as one array, and rows of a text that very many share stay where they are
    per_text = matches.groupBy("key").agg(F.collect_list(F.struct("start", "size", "template", "label", "containment")).alias("m"))
    known = shared_table(counts.join(per_text, "key"))
    rows = spread_join(read.where("key is not null").select("doc_id", "key"), known, "key", "rows")
    return rows.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
