"""Knowledge graph over the reference collections."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import first_truthy
from ..functions.scoring import mask_account
from ..operators.aggregates import counts_by_type
from ..operators.filters import admit_edges

KINDS = ["Person", "Account", "Organization", "Vehicle", "Location"]


def _c(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def union_reference_graph(collections: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges).  The first row of an id wins, in collection order; edges need
    two different non-empty ends but keep ends that no collection describes."""
    nodes, edges = [], []

    def node(order, df, node_id, label, kind, **meta):
        pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
        nodes.append(df.select(F.lit(order).alias("priority"), node_id.alias("id"), label.alias("label"),
                               F.lit(kind).alias("type"), F.create_map(*pairs).alias("meta"))
                     .filter(F.coalesce("id", F.lit("")) != ""))

    def edge(df, source, target, relation):
        edges.append(df.select(source.alias("source"), target.alias("target"), relation.alias("relation")))

    for name, df in collections.items():
        c = lambda column, df=df: _c(df, column)
        if name == "ref_kyc":
            key = first_truthy(c("person_id"), c("id"))
            node(0, df, key, first_truthy(c("name"), c("full_name"), key), "Person", aadhaar=c("aadhaar"), pan=c("pan"),
                 address=c("address"))
        elif name == "ref_accounts":
            key = first_truthy(c("account_id"), c("id"))
            owner = first_truthy(c("owner_id"), c("person_id"))
            node(1, df, key, mask_account(c("bank"), c("account_number"), key), "Account", bank=c("bank"),
                 type=c("account_type"), upi=c("upi_id"))
            edge(df, owner, key, F.lit("OWNS_ACCOUNT"))
        elif name == "ref_companies":
            key = first_truthy(c("company_id"), c("id"))
            node(2, df, key, first_truthy(c("company_name"), c("name"), key), "Organization", cin=c("cin"),
                 status=c("status"), industry=c("industry"))
        elif name == "ref_directors":
            edge(df, c("person_id"), c("company_id"), first_truthy(c("role"), F.lit("DIRECTOR_OF")))
        elif name == "ref_vehicles":
            key = first_truthy(c("vehicle_id"), c("id"))
            node(4, df, key, first_truthy(c("registration_number"), c("plate"), key), "Vehicle", make=c("make"),
                 model=c("model"), color=c("color"))
            edge(df, first_truthy(c("owner_id"), c("person_id")), key, F.lit("OWNS_VEHICLE"))
        elif name == "ref_locations":
            key = first_truthy(c("location_id"), c("id"))
            node(5, df, key, first_truthy(c("name"), c("address"), key), "Location", lat=c("latitude"),
                 lon=c("longitude"), type=c("location_type"))
    every = reduce(lambda a, b: a.unionByName(b), nodes)
    first = F.min_by(F.struct("label", "type", "meta"), F.struct("priority", "label"))
    merged = every.groupBy("id").agg(first.alias("r")).select("id", "r.*")
    links = admit_edges(reduce(lambda a, b: a.unionByName(b), edges)) if edges else None
    return merged, links


def reference_graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node and edge counts and nodes per type."""
    return counts_by_type(nodes, KINDS).crossJoin(edges.agg(F.count("*").alias("edges")))  # 1 row x 1 row
