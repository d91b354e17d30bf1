"""Sequential state expressed so that no key has to fit in one task.

Running values are computed in fixed-width blocks of the order column: inside a
block by a window, across blocks by a window over one summary row per block.  A
single document with a third of all rows is then many small windows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iteration import sorted_join

BLOCK = 65536


def running_max(df: DataFrame, keys: list[str], order: str, outputs: dict[str, Column],
                block: int = BLOCK) -> DataFrame:
    """Add the running maximum (current row included) of each output expression.

    A maximum over ``struct(order, payload)`` carries the last payload forward.
    """
    tmp = df.withColumns({f"__v_{n}": c for n, c in outputs.items()}).withColumn(
        "__block", F.floor(F.col(order) / block))
    inside = (Window.partitionBy(*keys, "__block").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tmp = tmp.withColumns({f"__in_{n}": F.max(f"__v_{n}").over(inside) for n in outputs})
    summary = tmp.groupBy(*keys, "__block").agg(*[F.max(f"__v_{n}").alias(f"__m_{n}") for n in outputs])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "__block",
                             *[F.max(f"__m_{n}").over(before).alias(f"__b_{n}") for n in outputs])
    joined = tmp.join(carried, [*keys, "__block"])
    return joined.select(*[F.col(c) for c in df.columns],
                         *[F.greatest(f"__in_{n}", f"__b_{n}").alias(n) for n in outputs])


def running_sum(df: DataFrame, keys: list[str], order: str, outputs: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add the running sum (all rows of the current ``order`` value included) of each output expression."""
    tmp = df.withColumns({f"__v_{n}": c for n, c in outputs.items()}).withColumn("__block", F.floor(F.col(order) / block))
    inside = (Window.partitionBy(*keys, "__block").orderBy(order)
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tmp = tmp.withColumns({f"__in_{n}": F.sum(f"__v_{n}").over(inside) for n in outputs})
    summary = tmp.groupBy(*keys, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__m_{n}") for n in outputs])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "__block", *[F.sum(f"__m_{n}").over(before).alias(f"__b_{n}") for n in outputs])
    return tmp.join(carried, [*keys, "__block"]).select(
        *[F.col(c) for c in df.columns], *[(F.col(f"__in_{n}") + F.coalesce(f"__b_{n}", F.lit(0))).alias(n) for n in outputs])


def number_rows(df: DataFrame, keys: list[str], order: str, tie: list[str] | None = None,
                name: str = "row_number", block: int = BLOCK) -> DataFrame:
    """1-based row number per key; ``order`` is an integer position column."""
    tmp = df.withColumn("__block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "__block").orderBy(order, *(tie or []))
    tmp = tmp.withColumn("__in", F.row_number().over(inside))
    sizes = tmp.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (tmp.join(offsets, [*keys, "__block"])
            .select(*[F.col(c) for c in df.columns], (F.col("__in") + F.col("__off")).alias(name)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key.  The rank filter is pre-applied before the shuffle."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key, or of the whole table when there are no keys."""
    if not keys and rank is None:
        return df.orderBy(*order).limit(k)
    name = rank or "__rank"
    if not keys:
        head = df.orderBy(*order).limit(k)
        return head.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    ranked = (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
              .filter(F.col(name) <= k))
    return ranked if rank else ranked.drop(name)


def dedupe_mentions(mentions: DataFrame) -> DataFrame:
    """Last mention per (entity, unit, span, method)."""
    keys = ["doc_id", "entity_id", "unit_index", "start", "end", "method"]
    return keep_first(mentions, keys, [F.col("seq").desc()])


def earliest_anchor(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Span of the earliest mention per key, by (start, end)."""
    return (mentions.groupBy(*keys).agg(F.min(F.struct("start", "end")).alias("__a"))
            .select(*keys, F.col("__a.start").alias("start"), F.col("__a.end").alias("end")))


def best_proposal(located: DataFrame, keys: list[str]) -> DataFrame:
    """Shortest span, then earliest start; 'reported' is sticky over the duplicates."""
    rest = [c for c in located.columns if c not in (*keys, "start", "end", "reported")]
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("__len"), "start", "end", *rest))
    return (located.groupBy(*keys).agg(best.alias("__b"), F.bool_or("reported").alias("reported"))
            .select(*keys, "__b.start", "__b.end", *[f"__b.{c}" for c in rest], "reported"))


def reuse_target(docs: DataFrame) -> DataFrame:
    """The stored document a duplicate upload reuses: completed first, then oldest."""
    return keep_first(docs, ["case_id", "sha256"],
                      [(F.col("processing_status") != "completed").asc(), F.col("uploaded_at").asc(),
                       F.col("document_id").asc()])


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Merge touching or overlapping [start, end) ranges per key (gaps and islands).

    ``keys`` identify one text unit, so a window holds one unit's sentences.
    """
    seen = (Window.partitionBy(*keys).orderBy("start", "end")
            .rowsBetween(Window.unboundedPreceding, -1))
    run = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = ranges.withColumn("__new", F.coalesce((F.col("start") > F.max("end").over(seen)).cast("int"),
                                                   F.lit(1)))
    return (marked.withColumn("__island", F.sum("__new").over(run)).groupBy(*keys, "__island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island"))


def expand_neighbors(sentences: DataFrame, mentions: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """Sentences within ``reach`` of a sentence that a mention crosses.

    ``sentences`` has (keys, sentence_index, start, end); ``mentions`` carries
    (keys, first_sentence, last_sentence).
    """
    wanted = mentions.select(*keys, F.explode(F.sequence(
        F.greatest(F.col("first_sentence") - reach, F.lit(0)), F.col("last_sentence") + reach))
        .alias("sentence_index")).distinct()
    return sentences.join(sorted_join(wanted), [*keys, "sentence_index"], "left_semi")


def top_neighbors(pairs: DataFrame, k: int = 4) -> DataFrame:
    """First k distinct neighbours per node in edge order: (case_id, id, neighbor, seq)."""
    first = pairs.groupBy("case_id", "id", "neighbor").agg(F.min("seq").alias("seq"))
    return top_k(first, ["case_id", "id"], [F.col("seq"), F.col("neighbor")], k, rank="rank")
