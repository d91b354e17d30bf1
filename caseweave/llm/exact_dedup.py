"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut, lower_ascii


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """Cut a text after the first line end or vowel-blank pair beyond `least` characters, and at `most` at the latest.

    The cuts depend on the content next to them, so an edit moves the chunks around it only. The chunks concatenate to
    the text; an empty text has no chunk.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?(?:\n|[ao] |$)|.{{{most}}}|.+"), F.lit(0))


def chunk_recipes(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """doc_id, text_sha256 and parts: the place, 64-bit id and SHA-256 of every chunk. No text leaves its task."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    part = F.transform(F.col("chunks"), lambda c, i: F.struct(
        i.cast("int").alias("place"), F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), least, most).alias("chunks"))
            .select("doc_id", "text_sha256", part.alias("parts")))


def verified_ids(parts: DataFrame) -> DataFrame:
    """(id, digest, variant) of every distinct chunk: variant tells chunks apart that share a 64-bit id."""
    known = parts.select("id", "digest").distinct()
    clash = known.groupBy("id").agg(F.array_sort(F.collect_set("digest")).alias("digests"))
    return clash.select("id", F.posexplode("digests").alias("variant", "digest"))


def duplicate_groups(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of a group stays. A null text counts as
    empty, and all empty texts are one group. Rows that repeat a doc_id are rows of their group like any other (each
    comes back, and kept is true for each that carries keep_id); a row without doc_id stays only where its whole group has
    none, and then one of them does. A text of any length is chunked within its row. An empty table gives no rows. Other
    columns are not read.

    Chunks get identifiers that are unique for their bytes (64-bit hash, and a variant should two contents share one,
    told apart by SHA-256); a document is the ordered list of its identifiers. Only hashes move. A group's size and
    largest doc_id are combined map-side; the join back splits hot groups, as both sides are plain shuffles.
    """
    rows = cut(chunk_recipes(docs, least, most).withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    named = parts.join(verified_ids(parts), ["id", "digest"])
    lists = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id", "variant"))).alias("recipe"))
    slim = rows.select("row", "doc_id", "text_sha256")
    empty = F.array().cast("array<struct<place:int,id:bigint,variant:int>>")
    listed = cut(slim.join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", empty))
                 .withColumn("key", F.xxhash64("recipe")))
    # written, so that the join below deals both sides by plain shuffles, whose hot partitions Spark can split
    groups = cut(listed.groupBy("key", "recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")))
    kept = F.coalesce(F.col("doc_id") == F.col("top.doc_id"), F.col("top.doc_id").isNull() & (F.col("row") == F.col("top.row")))
    return (listed.join(groups, ["key", "recipe"])
            .select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256"))
