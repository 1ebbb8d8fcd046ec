"""The corpus pipeline: toxicity, quality, near duplicates, packing. Each stage is written as Parquet and read again as the next one's documents.

toxicity: documents with a score from TOXIC_FROM on go. quality: documents with a score below GOOD_FROM go. near_duplicates: of rows linked by
a similarity of 0.8 of five-word shingles, one stays, that of the least id, nulls last, then the first; rows without words all stay. packing: what is
kept, as pieces of sequences. Classifiers learn from the labels that their queries may use. A null text counts as empty. Columns of any name pass
through all stages but the last. Tables of the stages before the last stay in the session's shared folder, as run()'s rows are read from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import free_name, table
from tallystone.llm.components import shared_folder
from tallystone.llm.compression_quality import fit as fit_quality
from tallystone.llm.compression_quality import score_texts as quality_scores
from tallystone.llm.labelled import doc_crc
from tallystone.llm.ngram_join import near_classes
from tallystone.llm.packing import pack_texts
from tallystone.llm.queries import GOOD_FROM, TOXIC_FROM, tokenizer
from tallystone.llm.subword_toxicity import fit as fit_toxicity
from tallystone.llm.subword_toxicity import score_texts as toxicity_scores


def _where_score(docs: DataFrame, scores, model, keep) -> DataFrame:
    """docs whose score keep() accepts: the other columns travel through the scorer as the text's id, so no join is needed."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others, F.col("text").isNull().alias(free_name(docs, "_null"))).alias("row"), F.col("text").alias("_text"))
    found = scores(rows, model, id_col="row", text_col="_text", keep_text=True).where(keep(F.col("score")))
    text = F.when(~F.col("doc_id").getField(free_name(docs, "_null")), F.col("text")).alias("text")
    return found.select(*[text if c == "text" else F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), doc_crc(F.col("doc_id")) % 3 != 1)
    return _where_score(docs, toxicity_scores, model, lambda score: score < TOXIC_FROM)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, table(spark, sf_dir, "labels"), doc_crc(F.col("doc_id")) % 5 != 0)
    return _where_score(docs, quality_scores, model, lambda score: score >= GOOD_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "_row")
    # docs are read from files, so a row's place stays the same each time
    rows = docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("place")))
    kept = near_classes(rows, 0.8, 5, id_col=name).where("kept").select(F.col("doc_id").alias(name))
    return rows.join(kept, name, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_texts(docs, tokenizer("word_bpe_49k.json"), 4096, 1)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]
#: Trained classifiers are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' are written in the session's shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
