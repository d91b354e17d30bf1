"""Removal of repeated passages by overlapping windows of three lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import fresh, text_key


def line_windows(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, key, place, a, b): two 64-bit hashes of every run of `lines` consecutive lines.

    Lines are split at \\n and compared as they are. A run of blank lines only is no window; a text of fewer lines has
    none. docs: doc_id, key, text.
    """
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) == "").alias("blank")))
    each = F.transform(F.sequence(F.lit(1), F.size("h") - (lines - 1)), lambda i: F.slice("h", i, lines))
    windows = (docs.select("doc_id", "key", hashed.alias("h")).where(F.size("h") >= lines)
               .select("doc_id", "key", F.posexplode(each).alias("place", "w"))
               .where(F.exists("w", lambda x: ~x["blank"])))
    return windows.select("doc_id", "key", "place", F.xxhash64(F.transform("w", lambda x: x["a"])).alias("a"),
                          F.hash(F.transform("w", lambda x: x["b"])).alias("b"))


def repeated_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, key, places): for every document that repeats a window, the first lines of its later occurrences.

    The first occurrence is that of the smallest (doc_id, key, place). It is found by a map-side combined minimum; the
    join back is a plain one on the window, which splits hot windows. docs: doc_id, key, text.
    """
    windows = line_windows(docs, lines)
    at = F.struct("doc_id", "key", "place")
    first = (windows.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
             .select("a", "b", "first"))
    later = windows.join(first, ["a", "b"]).where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))


def dedupe_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """docs with the repeated lines cut out of text, plus n_lines and n_removed.

    A line goes when a later occurrence of a repeated window covers it; windows that overlap merge. The remaining lines
    keep their order and are joined by \\n again; a text that loses all its lines becomes empty and its row stays. A
    null text stays null, with no lines. Within one text a passage that repeats itself is cut like any other. Rows that
    repeat both doc_id and text are one document and get the same cuts; a null doc_id comes first in order. Extra
    columns come back as they are, but for columns named n_lines and n_removed, which are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key = text_key(F.col("text"))
    cuts = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text"), lines)
    own_id, own_key, places, whole, rest = fresh(docs, "__cut_id", "__cut_key", "__cut_places", "__cut_lines", "__cut_kept")
    cuts = cuts.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("places").alias(places))
    split = F.split("text", "\n", -1)
    covered = F.flatten(F.transform(places, lambda p: F.sequence(p, p + (lines - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), covered)
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(rest, lambda i: F.col(whole)[i]), "\n"))
    joined = (docs.select(*names).join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (key == F.col(own_key)), "left")
              .withColumn(whole, split).withColumn(rest, F.when(F.col(places).isNotNull(), kept)))
    n_lines = F.coalesce(F.size(whole), F.lit(0))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names],
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(places).isNull(), F.lit(0)).otherwise(n_lines - F.size(rest)).cast("long").alias("n_removed"))


def cut_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """docs with the repeated lines cut out of text, with the columns of docs; n_chars, if there, follows the text."""
    found = dedupe_lines(docs, lines)
    length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return found.select(*[length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
