"""Helpers shared by the training-data operators."""
from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master or "").startswith("local") or "cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the faster lower()."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, letters, letters.lower()))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that docs does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """A 64-bit key of a text that tells null and empty apart; with doc_id it names a document."""
    return F.xxhash64(text.isNull(), text)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (src, dst); component is its smallest reachable node.

    Each round hooks every node to the neighbour (or itself) of the smallest hash and contracts the edges, so chains
    are short in expectation and the edges shrink geometrically. Neighbour minima are combined map-side and no list of
    neighbours is ever built, so a hub costs no more than its partial minima. Self-links and repeated links are
    allowed, nulls are dropped; no edges give no rows.
    """
    live = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    labels = cut(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()).withColumn("root", F.col("node"))
    live = live.where("src <> dst")
    salt = 0
    while not live.isEmpty():
        def rank(node: str) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), F.col(node)).alias("h"), F.col(node).alias("n"))
        both = live.union(live.select("dst", "src"))
        hook = cut(both.groupBy("src").agg(F.min(rank("dst")).alias("low"))
                   .select(F.col("src").alias("was"), F.least(rank("src"), "low")["n"].alias("now")))
        labels = cut(labels.join(hook, labels["root"] == hook["was"], "left")
                     .select("node", F.coalesce("now", "root").alias("root")))
        left = live.join(hook, live["src"] == hook["was"]).select(F.col("now").alias("src"), "dst")
        live = cut(left.join(hook, left["dst"] == hook["was"]).select("src", F.col("now").alias("dst"))
                   .where("src <> dst").distinct())
        salt += 1
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")
