"""Tables in buckets: the links of a loop are shuffled once."""
from pyspark.sql import functions as F

from caseweave.operators import graph as G
from caseweave.operators import patterns as P
from caseweave.operators.iteration import dealt


def test_a_join_by_the_keys_shuffles_the_other_side_only(spark):
    links = spark.range(1000).select((F.col("id") % 7).alias("case_id"), F.col("id").cast("string").alias("id"), (F.col("id") + 1).cast("string").alias("neighbor"))
    table = dealt(links, ["case_id", "id"])
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, links.collect()))
    ranks = links.select("case_id", "id").withColumn("rank", F.rand()).hint("merge")
    plan = table.join(ranks, ["case_id", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_loops_deal_their_links(spark, monkeypatch):
    """Distances, communities and ranks read links that lie by the key they meet their rows by."""
    seen = []
    for module in (P, G):
        monkeypatch.setattr(module, "dealt", lambda df, keys, *more: seen.append(keys) or dealt(df, keys, *more))
    edges = spark.createDataFrame([("K", "a", "b"), ("K", "b", "c"), ("K", "c", "d"), ("K", "e", "e")], "case_id string, source string, target string")
    nodes = spark.createDataFrame([("K", x) for x in "abcde"], "case_id string, id string")
    found = P.distances(edges, nodes.filter("id = 'a'"))
    assert {r["id"]: (r["distance"], r["via"]) for r in found.collect()} == {"a": (0, None), "b": (1, "a"), "c": (2, "b"), "d": (3, "c")}
    assert {r["id"]: r["community"] for r in P.communities(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    ranks = {r["id"]: r["pagerank"] for r in G.pagerank(*G.build_graph(nodes, edges)).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-4 and ranks["b"] > ranks["a"]
    assert seen == [["case_id", "id"], ["case_id", "neighbor"], ["case_id", "id", "salt"]]
