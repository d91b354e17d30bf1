"""Keyed dedupe, alias groups, bundles, counts.

Groups can be very large (one key may own a third of all rows), so results are
counts or long tables; no aggregate gathers an unbounded group into one value.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.identifiers import first_truthy, squeeze


def dedupe_entities(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entity over producers.

    ``priority`` orders producers and ``seq`` rows within one.  Structured and
    form rows: the last one wins; a narrative row only where no other exists,
    and then the first one.  Both are single min/max structs (map-side combined).
    """
    rest = [c for c in df.columns if c not in (*keys, "priority", "seq", "narrative")]
    row = F.struct(*rest)
    order = F.struct("priority", "seq")
    return (df.groupBy(*keys).agg(
        F.max_by(row, F.when(~F.col("narrative"), order)).alias("__last"),
        F.min_by(row, F.when(F.col("narrative"), order)).alias("__first"))
        .select(*keys, F.coalesce("__last", "__first").alias("__r"))
        .select(*keys, "__r.*"))


def alias_key():
    """Grouping value of an entity: its normalized value, else its squeezed label."""
    return first_truthy(F.col("normalized_value"), squeeze(F.lower("label")))


def collapse_aliases(entities: DataFrame, sightings: DataFrame | None = None):
    """Group spellings of one (type, value) within a case.

    Returns (groups, alias, group_reports): one row per group with its canonical
    entity and alias count; (case_id, id, canonical_id) for ids that are not
    their own canonical; distinct (case_id, id, report_id) per group.
    """
    keyed = entities.withColumn("alias_value", alias_key())
    groups = (keyed.groupBy("case_id", "type", "alias_value")
              .agg(F.min(F.struct("seq", "id", "label")).alias("__c"), F.count("*").alias("alias_count"))
              .select("case_id", F.col("__c.id").alias("id"), F.col("__c.label").alias("label"), "type",
                      F.col("alias_value").alias("normalized_value"), "alias_count",
                      F.when(F.col("type") == "Person", F.lit("unverified-name-group"))
                      .otherwise(F.lit("normalized")).alias("identity_status")))
    named = groups.filter(F.col("alias_count") > 1).select(
        "case_id", "type", F.col("normalized_value").alias("alias_value"), F.col("id").alias("canonical_id"))
    alias = (keyed.join(named, ["case_id", "type", "alias_value"])
             .filter(F.col("id") != F.col("canonical_id")).select("case_id", "id", "canonical_id"))
    if sightings is None:
        return groups, alias, None
    reports = (sightings.join(alias, ["case_id", "id"], "left")
               .select("case_id", F.coalesce("canonical_id", "id").alias("id"), "report_id").distinct())
    return groups, alias, reports


def bundle_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed bundles (source, target, type) with their count, and the evidence
    rows keyed to their bundle."""
    kind = F.upper(F.trim(first_truthy(F.col("type"), F.lit("RELATED_TO"))))
    evidence = edges.withColumn("type", kind)
    keys = [c for c in ("case_id", "source", "target", "type") if c in evidence.columns]
    return evidence.groupBy(*keys).agg(F.count("*").alias("occurrence_count")), evidence


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Distinct unordered endpoint pairs (a <= b) per case."""
    return edges.select("case_id", F.least("source", "target").alias("a"),
                        F.greatest("source", "target").alias("b")).distinct()


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree in the simple undirected graph; a self-loop adds 2; isolates keep 0."""
    ends = undirected_pairs(edges).select("case_id", F.explode(F.array("a", "b")).alias("id"))
    degree = ends.groupBy("case_id", "id").agg(F.count("*").alias("connections"))
    return (nodes.join(degree, ["case_id", "id"], "left")
            .withColumn("connections", F.coalesce("connections", F.lit(0))))


def multi_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every parallel edge counts, at both ends."""
    degree = (edges.select("case_id", F.explode(F.array("source", "target")).alias("id"))
              .groupBy("case_id", "id").agg(F.count("*").alias("multi_degree")))
    return (nodes.join(degree, ["case_id", "id"], "left")
            .withColumn("multi_degree", F.coalesce("multi_degree", F.lit(0))))


def overview(nodes: DataFrame, edges: DataFrame, docs: DataFrame, leads: DataFrame) -> DataFrame:
    """Counts per case, one row per case seen in any of the tables."""
    parts = [t.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(name).alias("part"), "n")
             for name, t in (("nodes", nodes), ("edges", edges), ("reports", docs), ("leads", leads))]
    long = reduce(lambda a, b: a.unionByName(b), parts)
    return long.groupBy("case_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p)
        for p in ("nodes", "edges", "reports", "leads")])


def counts_by_type(nodes: DataFrame, kinds: list[str], keys: list[str] | None = None) -> DataFrame:
    return nodes.groupBy(*(keys or [])).agg(
        F.count("*").alias("nodes"), *[F.count_if(F.col("type") == k).alias(k.lower() + "_count") for k in kinds])


def report_counts(sightings: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    parts = [t.groupBy("report_id").agg(F.count("*").alias("n")).select("report_id", F.lit(name).alias("part"), "n")
             for name, t in (("entity_count", sightings), ("mention_count", mentions),
                             ("relationship_count", edges))]
    long = reduce(lambda a, b: a.unionByName(b), parts)
    return long.groupBy("report_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p)
        for p in ("entity_count", "mention_count", "relationship_count")])


def supporting_sources(edges: DataFrame) -> DataFrame:
    """Distinct (case_id, id, source_ref) over the edges touching each entity."""
    known = [F.col(c) for c in ("report_id", "document_id") if c in edges.columns]
    ref = first_truthy(*known, F.lit("Record")).alias("source_ref")
    return edges.select("case_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), ref).distinct()


def neighbor_pairs(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge seen from both ends: (case_id, id, neighbor, extra…)."""
    both = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("neighbor")),
                   F.struct(F.col("target").alias("id"), F.col("source").alias("neighbor")))
    return edges.select("case_id", *extra, F.explode(both).alias("__p")).select("case_id", *extra, "__p.*")


def neighbor_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of distinct types among each node's neighbours."""
    kinds = nodes.select("case_id", F.col("id").alias("neighbor"), F.col("type").alias("neighbor_type"))
    pairs = undirected_pairs(edges).select("case_id", F.col("a").alias("source"), F.col("b").alias("target"))
    typed = neighbor_pairs(pairs).join(kinds, ["case_id", "neighbor"])
    return (typed.select("case_id", "id", "neighbor_type").distinct()
            .groupBy("case_id", "id").agg(F.count("*").alias("kinds")))


def distinct_warnings(df: DataFrame) -> DataFrame:
    """Warnings array without repeats, first occurrence order."""
    return df.withColumn("warnings", F.array_distinct("warnings"))


def accumulate_reports(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set-add of sightings (case_id, id, report_id)."""
    keys = ["case_id", "id", "report_id"]
    return current.select(*keys).union(incoming.select(*keys)).distinct()


def batch_status(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("completed"),
                     F.count_if(F.col("status") == "failed").alias("failed"))


def entity_profile(edges: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Distinct connected entities and relationship rows, per entity."""
    pairs = neighbor_pairs(edges)
    if entity_id is not None:
        pairs = pairs.filter(F.col("id") == entity_id)
    # count per (entity, neighbour) first: a hub's rows are combined before its own key
    partial = pairs.groupBy("case_id", "id", "neighbor").agg(F.count("*").alias("n"))
    return partial.groupBy("case_id", "id").agg(F.count("*").alias("connected_entities"),
                                                F.sum("n").alias("relationship_rows"))


def rejections(quarantine: DataFrame, *keys: str) -> DataFrame:
    return quarantine.groupBy(*keys).agg(F.count("*").alias("rejected"))


def run_complete(parts: DataFrame) -> DataFrame:
    """Status of a run from its narrative parts."""
    return (parts.groupBy("report_id").agg(F.bool_and("processed").alias("__done"))
            .select("report_id", F.when(F.col("__done"), F.lit("complete"))
                    .otherwise(F.lit("relationships_pending")).alias("status")))


def document_warnings(units: DataFrame, handled: DataFrame, edges: DataFrame, mapped: DataFrame) -> DataFrame:
    """Quality warnings per document, from its unit, handled-row and edge counts.

    ``mapped`` holds the documents in which a registry schema produced something.
    """
    loose = units.join(handled.withColumn("__h", F.lit(1)), ["doc_id", "unit_index"], "left").groupBy("doc_id").agg(
        F.count_if((F.col("kind") == "row") & F.col("__h").isNull()).alias("loose_rows"))
    per_doc = edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    schema = mapped.select("doc_id").distinct().withColumn("__s", F.lit(True))
    joined = loose.join(per_doc, "doc_id", "left").join(schema, "doc_id", "left")
    return joined.select("doc_id", F.array_compact(F.array(
        F.when(F.col("__s").isNull(), F.lit(V.NO_SCHEMA)),
        F.when(F.coalesce("n_edges", F.lit(0)) == 0, F.lit(V.NO_RELATIONSHIP)),
        F.when(F.col("loose_rows") > 0, F.lit(V.NEEDS_MAPPING)))).alias("warnings"))


def last_updated(docs: DataFrame) -> DataFrame:
    return docs.groupBy("case_id").agg(F.max("uploaded_at").alias("last_updated"))
