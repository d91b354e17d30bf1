"""Betweenness from every node, in tasks wherever a task can hold the part."""
import pytest

import __spark_entry__ as entry
from caseweave.operators import graph as G
from caseweave.operators import sampling as S
from caseweave.plans.bindings import Source
from caseweave.plans.catalogue.graph import trade
from tests.test_graph_windows import brute_betweenness

FOLDER = "/root/testdata/sf0.001"


def refused(*_args, **_options):
    raise AssertionError("taken layer by layer")


def test_rank_centrality_follows_every_node(spark):
    pairs = {}
    for r in trade(Source(spark, FOLDER))[1].collect():
        pairs.setdefault(r["case_id"], []).append((r["a"], r["b"]))
    found = {(r["case_id"], r["id"]): r["betweenness"] for r in entry.queries()["t1_rank_centrality"](spark, FOLDER).collect()}
    for case, links in pairs.items():
        ids = sorted({x for p in links for x in p})
        expected = brute_betweenness(ids, links)
        assert {i: found[case, i] for i in ids} == pytest.approx(expected, abs=0.00051)


def test_a_part_of_many_nodes_is_taken_in_tasks(spark, monkeypatch):
    """A hub with 20 100 leaves: all paths lead through it."""
    monkeypatch.setattr(G, "layered_dependencies", refused)
    nodes = spark.range(20_101).selectExpr("'K' case_id", "cast(id as string) id")
    pairs = spark.range(1, 20_101).selectExpr("'K' case_id", "'0' a", "cast(id as string) b")
    found = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, pairs).filter("betweenness > 0").collect()}
    assert found == pytest.approx({"0": 1.0})


def test_tasks_of_a_part_share_its_sources(spark, monkeypatch):
    path = [(f"{i:02}", f"{i + 1:02}") for i in range(29)] + [("00", "07"), ("03", "19")]
    ids = sorted({x for p in path for x in p})
    nodes = spark.createDataFrame([("K", x) for x in ids], "case_id string, id string")
    links = spark.createDataFrame([("K", *p) for p in path], "case_id string, a string, b string")
    monkeypatch.setattr(G, "TASK_VISITS", 200)
    found = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, links).collect()}
    assert found == pytest.approx(brute_betweenness(ids, path))


def test_broad_layers_agree_with_brute_force():
    """Many links a node: layers are pulled from what is open, or summed over all links."""
    import numpy as np
    import pandas as pd
    n, draw = 60, np.random.default_rng(5)
    pairs = sorted({(min(p), max(p)) for p in draw.integers(0, n, (400, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(n - 1)})
    code = [(a << G.NODE_BITS) + b for a, b in pairs] + [-1 - i for i in range(n)]
    found = G._block_betweenness(pd.DataFrame({"part": 0, "block": 0, "code": code}))
    names = [f"{i:02}" for i in range(n)]
    expected = brute_betweenness(names, [(names[a], names[b]) for a, b in pairs])
    raw = dict.fromkeys(names, 0.0) | {names[p]: r / ((n - 1) * (n - 2)) for p, r in zip(found["place"], found["raw"])}
    assert raw == pytest.approx(expected)


def test_sampled_sources_of_a_small_part_are_followed_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "layered_dependencies", refused)
    path = [(f"{i:02}", f"{i + 1:02}") for i in range(29)]
    ids = sorted({x for p in path for x in p})
    nodes = spark.createDataFrame([("K", x) for x in ids], "case_id string, id string")
    links = spark.createDataFrame([("K", *p) for p in path], "case_id string, a string, b string")
    found = {r["id"]: r["betweenness"] for r in S.sampled_betweenness(nodes, links).collect()}
    assert found == pytest.approx(brute_betweenness(ids, path))
