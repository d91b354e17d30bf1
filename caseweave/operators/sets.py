"""Bag unions, distinct unions and differences."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_edges(*tables: DataFrame) -> DataFrame:
    """Bag union; columns a producer lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_handled(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b),
                  [t.select("doc_id", "unit_index") for t in tables]).distinct()


def retired_ids(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.select(*keys).join(new.select(*keys), keys, "left_anti").distinct()


def distinct_ids(column: str, *tables: DataFrame) -> DataFrame:
    """Distinct non-null ids over several tables (deduplicated before the union shuffle)."""
    parts = [t.select(column).filter(F.col(column).isNotNull()) for t in tables if column in t.columns]
    return reduce(lambda a, b: a.union(b), parts).distinct()


def soft_delete_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows with active=false where the new run no longer holds their key."""
    mark = new.select(*keys).distinct().withColumn("__kept", F.lit(True))
    return (current.join(mark, keys, "left")
            .withColumn("active", F.coalesce("__kept", F.lit(False)) & F.coalesce("active", F.lit(True)))
            .drop("__kept"))


def neighbor_intersection(pairs: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``pairs`` whose keys ``other`` holds too: shared neighbours as an equi-join, each once."""
    return pairs.select(*keys).distinct().join(other.select(*keys), keys, "left_semi")
