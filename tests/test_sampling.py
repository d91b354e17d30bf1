"""Betweenness from a growing sample, and searches that write only what they reach, against plain Python."""
from __future__ import annotations

import pytest

from caseweave.operators import graph as G
from caseweave.operators import patterns as P
from caseweave.operators.sampling import most_sources, sampled_betweenness
from tests.test_graph_windows import brute_betweenness


def tables(spark, cases):
    nodes = [(case, n) for case, (ids, _) in cases.items() for n in ids]
    links = [(case, a, b) for case, (_, pairs) in cases.items() for a, b in pairs]
    return (spark.createDataFrame(nodes, "case_id string, id string"),
            spark.createDataFrame(links, "case_id string, a string, b string"))


def test_sources_are_added_until_the_bound_holds(spark):
    """A bridge between two stars, a ring, and a case without links; every estimate lies within its bound."""
    leaves = [f"x{i}" for i in range(40)] + [f"y{i}" for i in range(40)]
    stars = (leaves + ["hub x", "hub y"], [("hub x", v) for v in leaves[:40]] + [("hub y", v) for v in leaves[40:]] + [("hub x", "hub y")])
    ring = ([f"r{i}" for i in range(30)], [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)])
    alone = (["one", "two", "three"], [])
    cases = {"stars": stars, "ring": ring, "alone": alone}
    got = {(r["case_id"], r["id"]): r for r in sampled_betweenness(*tables(spark, cases), error=0.4, first=8).collect()}
    assert len(got) == sum(len(ids) for ids, _ in cases.values())
    for case, (ids, pairs) in cases.items():
        for node, value in brute_betweenness(ids, pairs).items():
            row = got[case, node]
            assert row["bound"] <= 0.4 and abs(row["betweenness"] - value) <= row["bound"] + 1e-9, (case, node)
    assert {r["sources"] for (case, _), r in got.items() if case == "alone"} == {3}
    assert 8 <= got["stars", "hub x"]["sources"] <= 82
    exact = {(r["case_id"], r["id"]): r for r in sampled_betweenness(*tables(spark, cases), error=0.01, first=64).collect()}
    for case, (ids, pairs) in cases.items():
        for node, value in brute_betweenness(ids, pairs).items():
            assert exact[case, node]["bound"] == 0 and exact[case, node]["betweenness"] == pytest.approx(value, abs=1e-9)


def test_odd_inputs(spark):
    none = tables(spark, {"a": ([], [])})
    assert sampled_betweenness(*none).count() == 0
    two = tables(spark, {"a": (["u", "v"], [("u", "v"), ("u", "u")])})
    assert [(r["id"], r["betweenness"], r["bound"]) for r in sampled_betweenness(*two).orderBy("id").collect()] == [("u", 0.0, 0.0), ("v", 0.0, 0.0)]
    with pytest.raises(ValueError):
        sampled_betweenness(*two, error=0)
    assert most_sources(10**9, 0.05, 0.1) < 5000


def test_a_long_path_is_searched_to_its_end(spark):
    edges = spark.createDataFrame([("a", f"n{i}", f"n{i + 1}") for i in range(12)] + [("a", "n12", "n0"), ("b", "q", "q")],
                                  "case_id string, source string, target string")
    starts = spark.createDataFrame([("a", "n3"), ("b", "q")], "case_id string, id string")
    got = {(r["case_id"], r["id"]): r["distance"] for r in P.distances(edges, starts).collect()}
    assert got == {("a", f"n{i}"): min(abs(i - 3), 13 - abs(i - 3)) for i in range(13)} | {("b", "q"): 0}
    near = P.distances(edges, starts, 2)
    assert near.count() == 6 and near.agg({"distance": "max"}).first()[0] == 2
    assert G.build_graph(starts, edges)[1].count() == 1
