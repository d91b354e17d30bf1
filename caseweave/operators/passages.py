"""Which passages of a document to read for relationships, under a size budget."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import chunk, pack
from .extraction import UNIT, sentence_rows
from .iteration import sorted_join
from .joins import RANGE_BLOCK
from .windows import expand_neighbors, merge_ranges

DOC = ["case_id", "doc_id"]


def _blocks(start: str, end: str):
    return F.explode(F.sequence(F.floor(F.col(start) / RANGE_BLOCK),
                                F.floor((F.col(end) - 1) / RANGE_BLOCK))).alias("__block")


def entity_counts(segments: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct entities mentioned wholly inside the segments of each key."""
    spread = segments.select("*", _blocks("start", "end"))
    inside = mentions.select(*UNIT, "entity_id", F.col("start").alias("__s"), F.col("end").alias("__e"),
                             F.floor(F.col("start") / RANGE_BLOCK).alias("__block"))
    hits = (spread.join(sorted_join(inside), [*UNIT, "__block"])
            .filter((F.col("start") <= F.col("__s")) & (F.col("__e") <= F.col("end"))))
    return hits.select(*keys, "entity_id").distinct().groupBy(*keys).agg(F.count("*").alias("entities"))


def entity_windows(units: DataFrame, mentions: DataFrame, reach: int = 1) -> DataFrame:
    """Sentences that mentions cross, with their neighbours, merged into ranges."""
    sents = sentence_rows(units).select(*UNIT, "sentence_index", F.col("sentence_start").alias("start"),
                                        F.col("sentence_end").alias("end"))
    spread = sents.select("*", _blocks("start", "end"))
    spans = mentions.select(*UNIT, F.col("start").alias("__s"), F.col("end").alias("__e")).distinct().select(
        "*", _blocks("__s", "__e"))
    touched = (spread.join(sorted_join(spans), [*UNIT, "__block"])
               .filter((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")))
               .select(*UNIT, F.col("sentence_index").alias("first_sentence"),
                       F.col("sentence_index").alias("last_sentence")).distinct())
    return merge_ranges(expand_neighbors(sents, touched, UNIT, reach).select(*UNIT, "start", "end"), UNIT)


def _chunked(slices: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunk (UNIT, start, end, text) slices; offsets stay relative to the unit."""
    return (slices.select(*UNIT, "start", F.explode(chunk(F.col("text"), size, overlap)).alias("c"))
            .select(*UNIT, (F.col("start") + F.col("c.start")).alias("start"),
                    (F.col("start") + F.col("c.end")).alias("end"), F.col("c.clipped").alias("clipped")))


def plan_passages(units: DataFrame, mentions: DataFrame, size: int = V.CHUNK_SIZE,
                  overlap: int = V.CHUNK_OVERLAP, compact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(plan, metrics).  The plan has one row per passage: (doc, batch, unit, start, end,
    clipped).  The baseline is every chunk that names at least two entities, one per
    request; the compact plan (entity sentences and their neighbours, packed) replaces
    it per document only when it needs no more requests and characters and no batch
    is left with a single entity."""
    overlap = min(overlap, size - 1)
    texts = units.filter((F.col("kind") != "row") & F.col("text").rlike(r"\S"))
    chunks = _chunked(texts.select(*UNIT, "text", F.lit(0).alias("start")), size, overlap)
    ids = entity_counts(chunks, mentions, [*UNIT, "start", "end", "clipped"])
    originals = ids.filter(F.col("entities") >= 2).select(*UNIT, "start", "end", "clipped")
    baseline = originals.groupBy(*DOC).agg(F.count("*").alias("original_requests"),
                                           F.sum(F.col("end") - F.col("start")).alias("original_chars"))
    full = originals.select(*UNIT, "start", "end", "clipped",
                            F.concat_ws(":", "unit_index", "start").alias("batch"))
    if not compact:
        metrics = baseline.withColumns({
            "planned_requests": F.col("original_requests"), "sent_chars": F.col("original_chars"),
            "passage_count": F.col("original_requests"), "mode": F.lit("full-context")})
        return full, metrics
    marker = min(V.MARKER_CHARS, max(1, size // 10))
    eligible = texts.join(sorted_join(originals.select(*UNIT).distinct()), UNIT, "left_semi")
    windows = entity_windows(eligible, mentions)
    slices = eligible.join(sorted_join(windows), UNIT).select(
        *UNIT, "start", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    passage_size = size - marker
    segments = _chunked(slices, passage_size, min(overlap, passage_size - 1))
    # a document is at most the admission limit (see sources.originals), so its list of
    # passage sizes is bounded; the text itself is not gathered
    ordered = F.array_sort(F.collect_list(F.struct("unit_index", "start", "end", "clipped")))
    packed = (segments.groupBy(*DOC).agg(ordered.alias("p"))
              .withColumn("b", pack(F.transform("p", lambda x: x["end"] - x["start"] + marker), size))
              .select(*DOC, F.explode(F.arrays_zip("p", "b")).alias("z"))
              .select(*DOC, "z.p.*", F.col("z.b").cast("string").alias("batch")))
    per_batch = entity_counts(packed, mentions, [*DOC, "batch"])
    sizes = packed.groupBy(*DOC, "batch").agg(F.sum(F.col("end") - F.col("start")).alias("chars"),
                                              F.count("*").alias("passages"))
    summary = (sizes.join(sorted_join(per_batch), [*DOC, "batch"], "left")
               .withColumn("ok", F.coalesce("entities", F.lit(0)) >= 2).groupBy(*DOC)
               .agg(F.count("*").alias("batches"), F.count_if("ok").alias("good"),
                    F.sum(F.when(F.col("ok"), F.col("chars"))).alias("compact_chars"),
                    F.sum("passages").alias("compact_passages")))
    fits = F.coalesce((F.col("good") > 0) & (F.col("good") == F.col("batches"))
                      & (F.col("good") <= F.col("original_requests"))
                      & (F.col("compact_chars") <= F.col("original_chars")), F.lit(False))
    choice = baseline.join(sorted_join(summary), DOC, "left").withColumn("use_compact", fits)
    pick = lambda a, b: F.when(F.col("use_compact"), F.col(a)).otherwise(F.col(b))
    metrics = choice.select(
        *DOC, "original_requests", "original_chars", pick("good", "original_requests").alias("planned_requests"),
        pick("compact_chars", "original_chars").alias("sent_chars"),
        pick("compact_passages", "original_requests").alias("passage_count"),
        F.when(F.col("use_compact"), F.lit("entity-context")).otherwise(F.lit("full-context")).alias("mode"))
    chosen = choice.select(*DOC, "use_compact")
    plan = (packed.join(sorted_join(chosen.filter("use_compact")), DOC, "left_semi")
            .unionByName(full.join(sorted_join(chosen.filter("not use_compact")), DOC, "left_semi")))
    return plan, metrics


def plan_metrics(metrics: DataFrame) -> DataFrame:
    """Totals over documents per mode."""
    return metrics.groupBy("mode").agg(*[F.sum(c).alias(c) for c in (
        "original_requests", "original_chars", "planned_requests", "sent_chars", "passage_count")])
