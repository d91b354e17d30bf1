"""Joins between entities, edges, documents, mentions and text."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iteration import settle, sorted_join

# Small sides are broadcast by Catalyst under spark.sql.autoBroadcastJoinThreshold;
# no join here forces a broadcast of anything that grows with the data.
RANGE_BLOCK = 4096


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source and target are both nodes (of the same case)."""
    keys = [c for c in ("case_id",) if c in nodes.columns and c in edges.columns]
    ids = nodes.select(*keys, "id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), [*keys, end], "left_semi")
    return edges


def rewrite_endpoints(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Move edges onto canonical ids, keeping the original endpoints.

    ``alias`` is (case_id, id, canonical_id) and need only hold ids that differ
    from their canonical one.
    """
    out = edges.withColumns({"original_source": F.col("source"), "original_target": F.col("target")})
    for end in ("source", "target"):
        side = alias.select("case_id", F.col("id").alias(end), F.col("canonical_id").alias("__canon"))
        out = (out.join(side, ["case_id", end], "left")
               .withColumn(end, F.coalesce("__canon", end)).drop("__canon"))
    return out


def settle_edges(edges: DataFrame, alias: DataFrame, nodes: DataFrame) -> DataFrame:
    """``drop_dangling(rewrite_endpoints(edges, alias), nodes)``, written once; canonical ids of ``alias`` are nodes.

    Only the distinct endpoints meet the nodes.  What comes of it, the ids that are no node or move to another one, meets the
    edges, so that edges whose ends all stay are neither shuffled nor written again.
    """
    held = settle(edges.dropna(subset=["case_id", "source", "target"]), "edges")
    ends = held.select("case_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    moved = ends.join(alias.select("case_id", "id", "canonical_id"), ["case_id", "id"])
    lost = (ends.join(nodes.select("case_id", "id"), ["case_id", "id"], "left_anti")
            .join(alias.select("case_id", "id"), ["case_id", "id"], "left_anti")
            .withColumn("canonical_id", F.lit(None).cast("string")))
    changes = settle(moved.unionByName(lost), "changes")
    out = held.withColumns({"original_source": F.col("source"), "original_target": F.col("target")})
    if changes.isEmpty():
        return out
    for end in ("source", "target"):
        side = changes.select("case_id", F.col("id").alias(end), F.col("canonical_id").alias("__canon"), F.lit(True).alias("__met"))
        out = (out.join(side, ["case_id", end], "left").filter("__met is null or __canon is not null")
               .withColumn(end, F.coalesce("__canon", end)).drop("__canon", "__met"))
    return settle(out, "edges")


def documents_with_counts(docs: DataFrame, reports: DataFrame) -> DataFrame:
    counts = reports.select("case_id", "report_id", "entity_count", "mention_count", "relationship_count",
                            F.col("status").alias("report_status"))
    return docs.join(counts, ["case_id", "report_id"], "left")


def document_detail(docs: DataFrame, reports: DataFrame, sightings: DataFrame, mentions: DataFrame,
                    edges: DataFrame) -> DataFrame:
    """Everything found in each document, one row per finding: the document's
    columns, the report's status, and (section, item_id, item_label)."""
    parts = [
        sightings.select("case_id", "report_id", F.lit("entity").alias("section"),
                         F.col("id").alias("item_id"), F.col("label").alias("item_label")),
        mentions.select("case_id", "report_id", F.lit("mention").alias("section"),
                        F.concat_ws(":", "entity_id", "unit_index", "start", "end").alias("item_id"),
                        F.col("label").alias("item_label")),
        edges.select("case_id", "report_id", F.lit("relationship").alias("section"),
                     F.col("id").alias("item_id"), F.col("type").alias("item_label"))]
    items = reduce(lambda a, b: a.unionByName(b), parts)
    head = docs.join(reports.select("case_id", "report_id", F.col("status").alias("report_status")),
                     ["case_id", "report_id"], "left")
    # an inner join can split a report that owns most findings; a left join could not
    found = items.join(head, ["case_id", "report_id"])
    bare = head.join(items.select("case_id", "report_id").distinct(), ["case_id", "report_id"], "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


def entities_of_report(sightings: DataFrame, report_id: str) -> DataFrame:
    """Entities seen in one report; sightings hold one row per (entity, report)."""
    return sightings.filter(F.col("report_id") == report_id)


def prefer_identifiers(mentions: DataFrame) -> DataFrame:
    """Drop other spans that overlap an identifier-rule span of the same unit.

    Both sides are cut into fixed-width text blocks, so the interval test runs
    as an equi-join on (document, unit, block).
    """
    is_identifier = F.col("method") == "identifier-rule"
    exact, other = mentions.filter(is_identifier), mentions.filter(~is_identifier)

    def blocks(df):
        return df.withColumn("__block", F.explode(F.sequence(
            F.floor(F.col("start") / RANGE_BLOCK), F.floor((F.col("end") - 1) / RANGE_BLOCK))))

    spans = blocks(exact).select("doc_id", "unit_index", "__block", F.col("start").alias("__s"),
                                 F.col("end").alias("__e")).distinct()
    hit = (blocks(other).join(sorted_join(spans), ["doc_id", "unit_index", "__block"])
           .filter((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")))
           .select("doc_id", "unit_index", "start", "end").distinct())
    return exact.unionByName(other.join(sorted_join(hit), ["doc_id", "unit_index", "start", "end"], "left_anti"))


def assign_sentences(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentence that contains each mention, by block equi-join plus containment."""
    spread = sentences.withColumn("__block", F.explode(F.sequence(
        F.floor(F.col("sentence_start") / RANGE_BLOCK),
        F.floor((F.col("sentence_end") - 1) / RANGE_BLOCK))))
    local = mentions.withColumn("__block", F.floor(F.col("start") / RANGE_BLOCK))
    return (local.join(sorted_join(spread), ["doc_id", "unit_index", "__block"])
            .filter((F.col("sentence_start") <= F.col("start")) & (F.col("end") <= F.col("sentence_end")))
            .drop("__block"))


def new_documents(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads whose bytes are not yet stored in the same case."""
    return incoming.join(known.select("case_id", "sha256"), ["case_id", "sha256"], "left_anti")


def discover_cases(cases: DataFrame, *tables: DataFrame) -> DataFrame:
    """Stored cases plus a default row for every case id found only in data tables."""
    found = reduce(lambda a, b: a.union(b), [t.select(F.col("case_id").alias("id")) for t in tables]).distinct()
    extra = (found.filter(F.coalesce(F.col("id"), F.lit("")) != "").join(cases.select("id"), "id", "left_anti")
             .select("id", F.when(F.col("id") == "default", F.lit("Case 1")).otherwise(F.col("id")).alias("title"),
                     F.lit("Restricted").alias("classification"), F.lit("Active").alias("status"),
                     F.lit("").alias("summary")))
    return cases.unionByName(extra, allowMissingColumns=True)


def sources_for_entity(docs: DataFrame, edges: DataFrame, sightings: DataFrame, entity_id: str) -> DataFrame:
    """Documents that support an entity: by a touching edge or by a report that saw it."""
    touching = edges.filter((F.col("source") == entity_id) | (F.col("target") == entity_id))
    by_edge = docs.join(touching.select("case_id", "document_id"), ["case_id", "document_id"], "left_semi")
    seen = sightings.filter(F.col("id") == entity_id).select("case_id", "report_id")
    by_report = docs.join(seen, ["case_id", "report_id"], "left_semi")
    return by_edge.unionByName(by_report).dropDuplicates(["case_id", "document_id"])


def stale_mentions(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """Mentions whose span no longer reads as their label (modulo whitespace)."""
    from ..functions.identifiers import squeeze
    from ..functions.text import span_text
    joined = mentions.join(sorted_join(units.select("doc_id", "unit_index", "text")), ["doc_id", "unit_index"], "left")
    sound = ((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
             & (squeeze(F.col("label")) != "")
             & (squeeze(span_text(F.col("text"), F.col("start"), F.col("end"))) == squeeze(F.col("label"))))
    return joined.filter(~F.coalesce(sound, F.lit(False))).drop("text")
