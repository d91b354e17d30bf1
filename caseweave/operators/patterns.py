"""Case patterns over transfers, calls, logins and links.

transfers and calls: (case_id, id, source, target, at, …) with ``at`` in whole seconds.  Sequences follow the latest
earlier event only, which a running maximum in blocks finds without listing pairs; shared values are long tables of
members, not pairs of them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import undirected_pairs
from .graph import both_directions, ordered_triangles
from .iteration import dealt, settle
from .windows import running_max


def latest_before(events: DataFrame, earlier: DataFrame, keys: list[str], within: int | None = None) -> DataFrame:
    """events with the latest row of ``earlier`` for the same keys at or before each: columns prior_id and prior_at.

    Both tables: keys, id, at.  Of equal times the earlier table's rows come first and the largest id is the latest.
    Only events that have one, at most ``within`` seconds back, come back.
    """
    rest = [c for c in events.columns if c not in (*keys, "at")]
    tagged = events.select(*keys, "at", F.struct(*rest).alias("__e"), F.lit(None).cast(dict(earlier.dtypes)["id"]).alias("__p"))
    tagged = tagged.unionByName(earlier.select(*keys, "at", F.lit(None).alias("__e"), F.col("id").alias("__p")))
    # earlier rows of the same second sort before the events
    placed = tagged.withColumn("__at", F.col("at") * 2 + F.when(F.col("__p").isNull(), 1).otherwise(0))
    last = running_max(placed, keys, "__at", {"__last": F.when(F.col("__p").isNotNull(), F.struct("at", "__p"))}, block=1 << 21)
    found = last.filter(F.col("__e").isNotNull() & F.col("__last").isNotNull()).select(
        *keys, "at", "__e.*", F.col("__last.__p").alias("prior_id"), F.col("__last.at").alias("prior_at"))
    return found if within is None else found.filter(F.col("at") - F.col("prior_at") <= within)


def pass_through(transfers: DataFrame, within: int = 86_400) -> DataFrame:
    """Transfers out of an account that received money at most ``within`` seconds before: the latest receipt of each."""
    out = transfers.select("case_id", F.col("source").alias("account"), "at", "id", "target")
    into = transfers.select("case_id", F.col("target").alias("account"), "at", "id")
    return latest_before(out, into, ["case_id", "account"], within)


def call_chains(calls: DataFrame, within: int | None = None) -> DataFrame:
    """Calls whose caller was called before, with that latest call: links of chains a to b to c in order of time."""
    return pass_through(calls, within).withColumnRenamed("account", "via")


def login_then_transaction(logins: DataFrame, transactions: DataFrame, within: int = 3_600) -> DataFrame:
    """Transactions (case_id, person, id, at) within ``within`` seconds of the person's latest login."""
    return latest_before(transactions, logins, ["case_id", "person"], within)


def rarity_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ln(N / degree) of every linked node: hubs weigh little.  (case_id, id, degree, weight)."""
    sizes = nodes.groupBy("case_id").agg(F.count("*").alias("n"))
    degree = both_directions(undirected_pairs(edges)).groupBy("case_id", "id").agg(F.count("*").alias("degree"))
    return degree.join(sizes, "case_id").select("case_id", "id", "degree", F.log(F.col("n") / F.col("degree")).alias("weight"))


def distances(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(case_id, id, distance, via): links from the nearest of ``starts`` (case_id, id), and the smallest node before.

    A breadth-first search, one join per step; following ``via`` back gives a shortest path.  A step writes what it
    reaches only: a neighbour of one layer is in it, in the one before or not yet found.
    """
    links = dealt(both_directions(undirected_pairs(edges)).select("case_id", "id", "neighbor"), ["case_id", "id"])
    front = settle(starts.select("case_id", "id").distinct().withColumns(
        {"distance": F.lit(0), "via": F.lit(None).cast(dict(edges.dtypes)["source"])}))
    layers = [front]
    while most is None or len(layers) <= most:
        reached = (layers[-1].select("case_id", "id", "distance").join(links, ["case_id", "id"])
                   .groupBy("case_id", F.col("neighbor").alias("id"))
                   .agg((F.first("distance") + 1).alias("distance"), F.min("id").alias("via")))
        known = reduce(lambda a, b: a.unionByName(b), [layer.select("case_id", "id") for layer in layers[-2:]])
        front = settle(reached.join(known, ["case_id", "id"], "left_anti"))
        if front.isEmpty():
            break
        layers.append(front)
    return reduce(lambda a, b: a.unionByName(b), layers)


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(case_id, id, community) by label propagation: each node takes the most frequent label around it and of itself,
    of equally frequent ones the smallest, for ``rounds`` rounds or until nothing changes."""
    links = dealt(both_directions(undirected_pairs(edges)).select("case_id", "id", "neighbor").unionByName(
        nodes.select("case_id", "id", F.col("id").alias("neighbor")).distinct()), ["case_id", "neighbor"])  # a node has a vote for itself
    labels = settle(nodes.select("case_id", "id").distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        seen = links.join(labels.withColumnRenamed("id", "neighbor"), ["case_id", "neighbor"]).select("case_id", "id", "community")
        votes = seen.groupBy("case_id", "id", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("case_id", "id").agg(F.min(F.struct(-F.col("n"), "community")).alias("b"))
        fresh = settle(best.select("case_id", "id", F.col("b.community").alias("community")))
        same = fresh.join(labels, ["case_id", "id", "community"], "left_anti").isEmpty()
        labels = fresh
        if same:
            break
    return labels


def circular_flows(transfers: DataFrame) -> DataFrame:
    """Directed circles a to b to c to a, a the smallest: (case_id, a, b, c), found among the triangles of the links."""
    sent = transfers.filter("source <> target").select("case_id", F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    circle = ordered_triangles(sent.withColumn("way", F.lit(1)))
    way = circle.select("case_id", "u", F.when(F.col("way") == 1, F.col("v")).otherwise(F.col("w")).alias("x"),
                        F.when(F.col("way") == 1, F.col("w")).otherwise(F.col("v")).alias("y"))
    first = F.least("u", "x", "y")
    turned = lambda p, q, r: F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c"))
    return way.select("case_id", F.when(first == F.col("u"), turned("u", "x", "y")).when(first == F.col("x"), turned("x", "y", "u"))
                      .otherwise(turned("y", "u", "x")).alias("t")).select("case_id", "t.*")


def shared_values(owners: DataFrame, least: int = 2) -> DataFrame:
    """(case_id, value, owner, owners): members of every phone, device, address or IP that at least ``least`` owners have."""
    held = owners.select("case_id", "value", "owner").distinct()
    counts = held.groupBy("case_id", "value").agg(F.count("*").alias("owners")).filter(F.col("owners") >= least)
    return held.join(counts, ["case_id", "value"])


def resolve_references(edges: DataFrame, references: DataFrame, known: DataFrame) -> DataFrame:
    """edges with endpoints that are outside ids replaced by the entity that carries them.

    references: (case_id, id, external_id) of unresolved nodes; known: (case_id, id, external_id) of entities.  Of several
    entities with one outside id the smallest holds; unresolved endpoints stay.
    """
    target = known.filter(F.coalesce("external_id", F.lit("")) != "").groupBy("case_id", "external_id").agg(F.min("id").alias("__to"))
    mapping = references.select("case_id", F.col("id").alias("__from"), "external_id").join(
        target, ["case_id", "external_id"]).select("case_id", "__from", "__to").distinct()
    out = edges
    for end in ("source", "target"):
        out = (out.join(mapping.withColumnRenamed("__from", end), ["case_id", end], "left")
               .withColumn(end, F.coalesce("__to", end)).drop("__to"))
    return out.select(*edges.columns)


def audit(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(check, rows, violations) of named conditions that every row of a table should meet; null counts as a violation."""
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.expr(sql), F.lit(False))).alias("violations"))
        .select(F.lit(name).alias("check"), "rows", "violations") for name, (df, sql) in checks.items()])


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(key, rows): references of child rows that parent does not have; null references are none."""
    return (child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
            .groupBy(key).agg(F.count("*").alias("rows")))


def repeated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
