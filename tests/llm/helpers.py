"""Inputs that every operator must take: nulls in any column, empty and very long texts, repeated rows, and extra columns with clashing names."""

EXTRA = "key string, row string, score string, label string, cluster string, kept string, root string"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away"),
    (1, "the quick brown fox jumps over the lazy dog and runs away"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (None, "a text without an id, which is kept as it is here"),
    (None, None),
    (5, "Ünïcode ▁ and 中文 🙂 bytes \x00 end </s>"),
    (6, "word " * 40_000),
    (7, "x" * 50_000),
    (8, "idiot " * 3),
]


def edge_documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, *["k"] * 7) for i, t in rows], f"doc_id long, text string, {EXTRA}")


def empty_documents(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")
