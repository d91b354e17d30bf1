"""Distribution checks: profiles of columns as small mergeable tables, and how far two of them differ."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 16


def cut_points(df: DataFrame, columns: list[str], bins: int = BINS, accuracy: int = 10_000) -> DataFrame:
    """(column, cuts): values that part each numeric column into ``bins`` of about equally many rows.

    From a quantile sketch per partition, merged map-side: its size depends on ``accuracy`` and not on the rows.
    """
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(c) for c in columns])
    return reduce(lambda a, b: a.unionByName(b), [found.select(F.lit(c).alias("column"), F.array_distinct(F.coalesce(c, F.array())).alias("cuts"))
                                                  for c in columns])


def profile(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """(column, bin, rows): how many rows of each column fall between which cut points; bin -1 holds nulls.

    Profiles of parts of a table add up to that of the table, so they are kept per run and merged later.  ``cuts`` has a
    row per column, whatever the data.
    """
    columns = [r["column"] for r in cuts.select("column").collect()]
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    place = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    return values.join(F.broadcast(cuts), "column").groupBy("column", place.alias("bin")).agg(F.count("*").alias("rows"))


def drift(before: DataFrame, after: DataFrame, limit: float = 0.2) -> DataFrame:
    """(column, index, drifted) of two profiles over the same cut points: the population stability index, the sum over bins
    of (p - q) ln(p / q), with half a row added to every bin so that an empty one counts and does not divide by zero."""
    both = (before.groupBy("column", "bin").agg(F.sum("rows").alias("p")).join(
        after.groupBy("column", "bin").agg(F.sum("rows").alias("q")), ["column", "bin"], "full").fillna(0, ["p", "q"]))
    totals = both.groupBy("column").agg(F.sum(F.col("p") + 0.5).alias("np"), F.sum(F.col("q") + 0.5).alias("nq"))
    p, q = (F.col("p") + 0.5) / F.col("np"), (F.col("q") + 0.5) / F.col("nq")
    index = both.join(totals, "column").groupBy("column").agg(F.sum((p - q) * F.log(p / q)).alias("index"))
    return index.withColumn("drifted", F.col("index") > limit)
