"""Links that are likely but not there: Adamic-Adar scores of pairs that share neighbours."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import undirected_pairs
from .graph import both_directions
from .iteration import settle
from .skew import join_frequent
from .windows import top_k

#: Classes of weight per unit of weight.
STEPS = 256
#: Numbers of a node's heavy links in one list.
LIST = 4096


def predict_links(edges: DataFrame, k: int = 10, least: float = 0.1) -> DataFrame:
    """(case_id, id, other, score, rank): for each node the k best nodes that it has no link with, by the sum of
    1 / ln(degree) over common neighbours, at least ``least``; equal scores (to 9 digits) in order of ids.

    ``least`` keeps hubs from listing the pairs around them, and no pair that reaches it is lost: the neighbours of a node
    fall into classes of weight, and the lightest classes that together stay under ``least`` cannot carry a pair alone.
    So a pair's heaviest common neighbour is a heavy one of both ends, and only pairs around such are listed.  A hub of
    over exp(1 / least) links is light to every node that has no more to set against ``least``, and lists none of those.

    Nodes are numbered in order of case and id.  The ends of a node's heavy links travel as lists of numbers to each of them,
    where pairs are made, summed and ranked without a shuffle; only sums that light links add to are completed by joins.
    """
    named = settle(both_directions(undirected_pairs(edges)).select("case_id", "id", "neighbor"))
    degree = named.groupBy("case_id", "id").agg(F.count("*").alias("d"))
    nodes = settle(degree.orderBy("case_id", "id").withColumn("x", F.monotonically_increasing_id()), "nodes")
    links = settle(join_frequent(join_frequent(named, nodes.select("case_id", "id", "x"), ["case_id", "id"]), nodes.select(
        "case_id", F.col("id").alias("neighbor"), F.col("x").alias("y"), "d"), ["case_id", "neighbor"]).select("x", "y", "d"), "links")
    weighed = links.filter("d > 1").withColumn("w", 1 / F.log("d")).withColumn("class", F.ceil(F.col("w") * STEPS).cast("int"))
    classes = weighed.groupBy("x", "class").agg(F.sum("w").alias("sum"))
    lighter = Window.partitionBy("x").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    carrying = (classes.withColumn("sum", F.sum("sum").over(lighter)).select("x", "class", (F.col("sum") >= least - 1e-9).alias("heavy")))
    judged = settle(join_frequent(weighed, carrying, ["x", "class"]).select("x", "y", "d", "w", "heavy"), "judged")
    heavy = judged.filter("heavy")
    part = F.pmod("x", F.ceil(F.col("d") / LIST))
    lists = heavy.groupBy("y", part.alias("part")).agg(F.collect_list("x").alias("ends"))  # about LIST numbers each
    met = heavy.select("x", "y", "w").join(lists, "y").select("x", "w", "ends")
    known = links.select("x", F.lit(None).cast("double").alias("w"), F.array("y").alias("ends"))
    listed = (met.unionByName(known).repartition("x").select("x", "w", F.explode("ends").alias("other")).filter("x <> other")
              .groupBy("x", "other").agg(F.sum("w").alias("sum"), F.count_if(F.col("w").isNull()).alias("linked"))
              .filter("linked = 0").select("x", "other", "sum"))
    light = judged.filter("not heavy").select("x", "y", "w")
    if not light.isEmpty():
        listed = settle(listed, "listed")
        far = links.select(F.col("x").alias("other"), "y")
        mine = listed.select("x", "other").join(light, "x").join(far, ["other", "y"], "left_semi")
        theirs = listed.select("x", "other").join(light.withColumnRenamed("x", "other"), "other").join(heavy.select("x", "y"), ["x", "y"], "left_semi")
        more = mine.select("x", "other", "w").unionByName(theirs.select("x", "other", "w")).groupBy("x", "other").agg(F.sum("w").alias("more"))
        listed = listed.join(more, ["x", "other"], "left").select("x", "other", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"))
    scores = listed.select("x", "other", F.round("sum", 9).alias("score")).filter(F.col("score") >= least)
    best = top_k(scores, ["x"], [F.col("score").desc(), F.col("other")], k, rank="rank")  # numbers rise with ids
    return (best.join(nodes.select("case_id", "id", "x"), "x").join(nodes.select(F.col("id").alias("name"), F.col("x").alias("other")), "other")
            .select("case_id", "id", F.col("name").alias("other"), "score", "rank"))
