"""Report queries over a workspace: rows instead of prose."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import first_truthy
from ..operators.aggregates import counts_by_type, neighbor_pairs
from ..operators.filters import term_search
from ..operators.iteration import settle
from ..operators.leads import neighbor_names
from ..operators.windows import top_k
from .workspace import Workspace

IDENTIFIER_KINDS = ["Phone", "AccountNumber", "Vehicle", "Location", "Domain", "Email"]


def top_connected(ws: Workspace, k: int) -> DataFrame:
    return top_k(ws.rankings, ["case_id"], [F.desc("connections"), F.col("id")], k, rank="rank")


def report_summary(ws: Workspace, k: int = 5) -> DataFrame:
    """Per case: counts, type breakdown and the top hubs as one line."""
    head = (top_connected(ws, k).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "label", "type", "connections"))).alias("top"))  # at most k rows per case
        .select("case_id", F.array_join(F.transform("top", lambda t: F.concat(
            t["label"], F.lit(" ("), t["type"], F.lit(", "), t["connections"].cast("string"), F.lit(" links)"))), ", ").alias("top_entities")))
    kinds = counts_by_type(ws.nodes, ["Person"], ["case_id"]).drop("nodes")
    orgs = ws.nodes.groupBy("case_id").agg(
        F.count_if(F.col("type").isin("Organization", "Company")).alias("organization_count"),
        F.count_if(F.col("type").isin(*IDENTIFIER_KINDS)).alias("identifier_count"))
    return (ws.overview().join(kinds, "case_id", "left").join(orgs, "case_id", "left").join(head, "case_id", "left"))


def report_connected(ws: Workspace, k: int = 8, neighbors: int = 4) -> DataFrame:
    top = settle(top_connected(ws, k), "top")  # k rows a case: a table so small meets the edges without moving them
    # only edges that touch a listed entity reach the neighbour ranking
    ids = top.select("case_id", "id")
    listed = neighbor_pairs(ws.edges, "seq").join(ids, ["case_id", "id"], "left_semi")
    as_edges = listed.select("case_id", "seq", F.col("id").alias("source"), F.col("neighbor").alias("target"))
    names = neighbor_names(ws.nodes, as_edges, neighbors).join(ids, ["case_id", "id"], "left_semi")
    return top.select("case_id", "rank", "id", "label", "type", "connections").join(names, ["case_id", "id"], "left")


def report_evidence(ws: Workspace, k: int = 8, fallback: int = 6) -> DataFrame:
    """First k evidence-bearing edges per case, else its first few edges."""
    edges = ws.edges
    for column in ("evidence_text", "reason", "document_id"):
        if column not in edges.columns:
            edges = edges.withColumn(column, F.lit(None).cast("string"))
    quote = first_truthy(F.col("evidence_text"), F.col("reason"))
    edges = edges.withColumn("__bare", quote.isNull())
    ranked = top_k(edges, ["case_id"], [F.col("__bare"), F.col("seq"), F.col("id")], k, rank="rank")
    # evidence rows sort first, so rank 1 tells whether the case has any
    only_bare = F.min("__bare").over(Window.partitionBy("case_id"))
    kept = ranked.withColumn("__none", only_bare).filter(
        (~F.col("__bare")) | (F.col("__none") & (F.col("rank") <= fallback)))
    for end in ("source", "target"):
        labels = ws.nodes.select("case_id", F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        kept = kept.join(labels, ["case_id", end], "left").withColumn(
            f"{end}_label", F.coalesce(f"{end}_label", end))
    return kept.select("case_id", "rank", "source_label", F.coalesce("type", F.lit("ASSOCIATED_WITH")).alias("type"),
                       "target_label", F.coalesce(quote, F.lit("Extracted association")).alias("quote"),
                       first_truthy(F.col("report_id"), F.col("document_id"), F.lit("Source Record")).alias("ref"),
                       F.upper(first_truthy(F.col("origin"), F.lit("reported"))).alias("origin"))


def report_search(ws: Workspace, query: str, k: int = 6, per_entity: int = 3) -> DataFrame:
    """First k matching entities per case with up to three of their edges."""
    found = top_k(term_search(ws.nodes, query), ["case_id"], [F.col("id")], k, rank="entity_rank").select(
        "case_id", "entity_rank", "id", "label", "type")
    touching = neighbor_pairs(ws.edges, "seq", "type").withColumnRenamed("type", "relation").join(
        found.select("case_id", "id"), ["case_id", "id"], "left_semi")
    totals = touching.groupBy("case_id", "id").agg(F.count("*").alias("relationships"))
    some = top_k(touching, ["case_id", "id"], [F.col("seq"), F.col("neighbor")], per_entity, rank="edge_rank")
    labels = ws.nodes.select("case_id", F.col("id").alias("neighbor"), F.col("label").alias("other_label"))
    some = some.join(labels, ["case_id", "neighbor"], "left").withColumn(
        "other_label", F.coalesce("other_label", "neighbor")).drop("seq")
    return found.join(totals, ["case_id", "id"], "left").join(some, ["case_id", "id"], "left")
