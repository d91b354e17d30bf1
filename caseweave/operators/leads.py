"""Review leads.  A lead row carries counts and wording; its sources and evidence
are long tables keyed by (case_id, entity_id), because a hub may own a third of all edges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import lead_confidence, lead_severity
from .aggregates import neighbor_kinds, neighbor_pairs, supporting_sources
from .graph import common_neighbors
from .iteration import settle
from .windows import top_neighbors

HUB_CONNECTIONS = 3
BRIDGE_BETWEENNESS = 0.12


def source_counts(edges: DataFrame) -> DataFrame:
    return supporting_sources(edges).groupBy("case_id", "id").agg(F.count("*").alias("sources"))


def neighbor_names(nodes: DataFrame, edges: DataFrame, k: int = 4) -> DataFrame:
    """Labels of the first k distinct neighbours, in edge order."""
    labels = nodes.select("case_id", F.col("id").alias("neighbor"), F.col("label").alias("neighbor_label"))
    top = top_neighbors(neighbor_pairs(edges, "seq"), k).join(labels, ["case_id", "neighbor"])
    ranked = F.array_sort(F.collect_list(F.struct("rank", "neighbor_label")))  # at most k rows per node
    return top.groupBy("case_id", "id").agg(
        F.array_join(F.transform(ranked, lambda r: r["neighbor_label"]), ", ").alias("names"))


def leads_cross_domain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with at least three distinct neighbours; a link to itself makes an entity its own neighbour once."""
    linked = (neighbor_pairs(edges).select("case_id", "id", "neighbor").distinct()
              .groupBy("case_id", "id").agg(F.count("*").alias("connections"))
              .filter(F.col("connections") >= HUB_CONNECTIONS))
    hubs = nodes.join(linked, ["case_id", "id"])
    full = (hubs.join(neighbor_kinds(nodes, edges), ["case_id", "id"])
            .join(neighbor_names(nodes, edges), ["case_id", "id"])
            .join(source_counts(edges), ["case_id", "id"]))
    reason = F.format_string("Reported alongside %d linked entities (%s) across %d categories. Sources: %d.",
                             "connections", "names", "kinds", "sources")
    return full.select("case_id", F.col("id").alias("entity_id"), F.lit("high").alias("severity"),
                       F.concat(F.lit("Cross-domain linkage: "), "label").alias("title"),
                       F.col("label").alias("entity"), reason.alias("reason"),
                       F.lit("Entity links across three or more records/categories").alias("rule"),
                       "connections", "kinds", "sources", F.lit(1).alias("generation"), F.lit(1).alias("rule_order"))


def leads_bridge(nodes: DataFrame, edges: DataFrame, betweenness: DataFrame) -> DataFrame:
    high = betweenness.filter(F.col("betweenness") >= BRIDGE_BETWEENNESS)
    full = nodes.join(high, ["case_id", "id"]).join(source_counts(edges), ["case_id", "id"])
    return full.select("case_id", F.col("id").alias("entity_id"), F.lit("medium").alias("severity"),
                       F.concat(F.lit("Potential network bridge: "), "label").alias("title"),
                       F.col("label").alias("entity"),
                       F.lit("Connects otherwise separate parts of the reported network. Review underlying "
                             "source context before any action.").alias("reason"),
                       F.lit("High betweenness centrality").alias("rule"), "sources",
                       F.lit(1).alias("generation"), F.lit(2).alias("rule_order"))


def leads_shared(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Linked pairs that also share a neighbour; the smallest shared id names the lead."""
    pair = lambda x, y: (F.least(x, y).alias("pa"), F.greatest(x, y).alias("pb"))
    refs = settle(edges.select("case_id", *pair("source", "target"), "report_id").filter("pa <> pb").distinct(), "refs")
    pairs = refs.select("case_id", F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    shared = common_neighbors(pairs).groupBy("case_id", "a", "b").agg(F.min("common").alias("common"))
    sides = shared.select("*", F.explode(F.array(
        F.struct(*pair("a", "common")), F.struct(*pair("b", "common")))).alias("p")).select("case_id", "a", "b", "common", "p.*")
    # dealt by lead once, which serves both the distinct reports and their number; a null report counts as one
    out = (sides.join(refs, ["case_id", "pa", "pb"]).select("case_id", "a", "b", "common", "report_id").repartition("case_id", "a", "b")
           .groupBy("case_id", "a", "b", "common").agg(F.count_distinct(F.struct("report_id")).alias("sources")))
    for column in ("a", "b", "common"):
        out = out.join(nodes.select("case_id", F.col("id").alias(column), F.col("label").alias(f"{column}_label")),
                       ["case_id", column])
    pair_label = F.concat("a_label", F.lit(" ↔ "), "b_label")
    return out.select("case_id", F.concat_ws("|", "a", "b").alias("entity_id"), F.lit("medium").alias("severity"),
                      F.concat(F.lit("Shared reported association: "), "a_label", F.lit(" and "), "b_label").alias("title"),
                      pair_label.alias("entity"),
                      F.concat(F.lit("Both are linked to "), "common_label",
                               F.lit(". Validate whether this is a meaningful connection or incidental overlap."))
                      .alias("reason"), F.lit("Common-neighbor pattern").alias("rule"), "sources",
                      F.lit(2).alias("generation"), F.lit(3).alias("rule_order"))


def leads_hub(rankings: DataFrame, edges: DataFrame) -> DataFrame:
    """Case leads: entities with at least three connections, scored by links and sources."""
    hubs = rankings.filter(F.col("connections") >= HUB_CONNECTIONS).select("case_id", "id", "label", "connections")
    full = hubs.join(source_counts(edges), ["case_id", "id"])
    c, s = F.col("connections"), F.col("sources")
    return full.select(
        "case_id", F.col("id").alias("entity_id"), F.col("label").alias("entity"),
        lead_severity(c, s).alias("severity"), lead_confidence(c, s).alias("confidence_score"),
        F.concat(F.lit("Reported connections: "), "label").alias("title"),
        F.format_string("Linked to %d distinct entities across %d source record(s). Review the context and "
                        "alternative explanations.", c, s).alias("reason"),
        F.lit("Multi-source hub / entity connectivity threshold").alias("rule"),
        "connections", "sources")


def lead_sources(leads: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct supporting sources of each lead, one row per source."""
    keys = leads.select("case_id", F.col("entity_id").alias("id"))
    return supporting_sources(edges).join(keys, ["case_id", "id"], "left_semi")


def lead_evidence(leads: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that support each lead, one row per (lead entity, edge)."""
    touched = edges.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("entity_id"))
    return touched.join(leads.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_semi")
