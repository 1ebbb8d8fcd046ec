"""Tables in the shared folder, joins that part hot keys, and connected components by joins: every node takes the least label among its
neighbours' and then its label's own label, until none changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in HEAVY of a side's rows is joined by broadcast; there are fewer than HEAVY such keys, whatever the input.
HEAVY = 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder (spark.checkpoint.dir). One below the warehouse is set only where there is none and the session runs
    in one process, as in tests; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint; its partitions stay as they are, so row numbers over it do too."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder. Loops need this: a checkpoint keeps the estimated size of its plan, and the estimates of
    joins of joins multiply from round to round until the numbers themselves take all the time; a table has the size it has."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of shared tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, known: tuple[int, int] | None = None) -> DataFrame:
    """The inner join of left with right, which has one row for each key, by keys that are not null; right's column `rows` says how many rows of left have
    the key; known: the greatest of these numbers and their sum, if the caller has them. Rows of heavy keys stay where they are and meet a broadcast of at most
    HEAVY rows; only the others are shuffled by key."""
    most, total = known or right.agg(F.max(rows), F.sum(rows)).first()
    if not total or most * HEAVY <= total:
        return left.join(right, key)
    heavy = right.where(F.col(rows) * HEAVY > total)
    others = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(others.join(right.where(F.col(rows) * HEAVY <= total), key))


def folded(ties: DataFrame) -> DataFrame:
    """Ties (a, b) with the same components and at most one for each node and one for each pair of hubs: a node keeps the tie to the least of its hubs,
    and its other hubs are tied to that one."""
    least = ties.groupBy("a").agg(F.min("b").alias("m"))
    hubs = ties.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return least.withColumnRenamed("m", "b").where("a != b").unionByName(hubs)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), the component being its least node, as a shared table. Loops and repeated links do no harm; nulls are passed over.

    A hub with many neighbours and a label with many nodes are heavy keys of their joins, so neither meets in one task.
    """
    both = edges.where("a is not null and b is not null and a != b").select("a", "b")
    both = shared_table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"), F.count("*").alias("degree"))
    labels = shared_table(first.select("node", F.least("node", "near").alias("component"), "degree"))
    degrees = labels.agg(F.max("degree"), F.sum("degree")).first()
    while True:
        ends = labels.select(F.col("node").alias("b"), "component", "degree")
        near = spread_join(both, ends, "b", "degree", degrees).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("last"), "degree")
        moved = shared_table(moved)
        named = moved.groupBy("next").agg(F.count("*").alias("nodes"))
        further = labels.select(F.col("node").alias("next"), F.col("component").alias("jump")).join(named, "next")
        step = spread_join(moved, further, "next", "nodes").select("node", F.least("next", "jump").alias("component"), "degree", "last")
        step = shared_table(step)
        drop_tables(moved, labels)
        labels = step
        if step.where("component != last").isEmpty():
            drop_tables(both)
            found = step.select("node", "component")
            found._shared_path = step._shared_path
            return found
