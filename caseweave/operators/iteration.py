"""Lineage cuts for iterative jobs: reliable checkpoints in the cluster's shared folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only a local session may fall back to a temporary one."""
    root = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CONF} is not set; iterative jobs need a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def cut(df: DataFrame) -> DataFrame:
    """Materialize and forget the plan behind a DataFrame."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def sorted_join(df: DataFrame) -> DataFrame:
    """A side that is joined by sorting, never by broadcast.

    Catalyst rates a table by its file and the widths of its column types, so text that is made from a few short columns
    passes for small and would be gathered whole on the driver.
    """
    return df.hint("merge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root, for streams and written tables."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a DataFrame as a table below the shared root and read it back: computed once, and nothing of its plan stays."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], name: str = "links") -> DataFrame:
    """Like settle, in buckets of the keys: joins by these keys read the table as it lies, so a loop shuffles its links once."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).format("parquet")
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy text work on an input with fewer splits than cores.

    Inputs with enough splits, as any large table has, pass through without a shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
