"""Betweenness of cases that fall into parts."""
import pytest

from caseweave.operators import graph as G
from tests.test_graph_windows import brute_betweenness


def test_a_large_case_of_small_parts_needs_no_rows_per_source_and_node(spark, monkeypatch):
    """3 300 nodes in 1 100 paths of three: only the middle of each lies between two others."""
    def refused(*_args, **_options):
        raise AssertionError("taken layer by layer")
    monkeypatch.setattr(G, "layered_dependencies", refused)
    nodes = spark.range(3300).selectExpr("'K' case_id", "cast(id as string) id")
    pairs = spark.range(3300).filter("id % 3 < 2").selectExpr("'K' case_id", "cast(id as string) x", "cast(id + 1 as string) y")
    pairs = pairs.selectExpr("case_id", "least(x, y) a", "greatest(x, y) b")
    found = {int(r["id"]): r["betweenness"] for r in G.betweenness(nodes, pairs).collect()}
    assert len(found) == 3300
    assert all(v == pytest.approx(2 / (3299 * 3298) if i % 3 == 1 else 0.0) for i, v in found.items())


def test_parts_agree_with_brute_force_whichever_way_they_take(spark, monkeypatch):
    pairs = [(i, (i * 7 + 3) % 20) for i in range(20)] + [(i, i + 1) for i in range(0, 18, 2)] + [(30 + i, 31 + i) for i in range(9)] + [(50, 50)]
    pairs = sorted({(f"n{min(p):02}", f"n{max(p):02}") for p in pairs})
    ids = sorted({x for p in pairs for x in p} | {"n60", "n61"})
    nodes = spark.createDataFrame([("K", x) for x in ids], "case_id string, id string")
    links = spark.createDataFrame([("K", *p) for p in pairs], "case_id string, a string, b string")
    expected = brute_betweenness(ids, pairs)
    monkeypatch.setattr(G, "SPLIT_NODES", 5)
    monkeypatch.setattr(G, "SOURCES_PER_TASK", 4)
    for most in (2_000_000, 15):  # 15: the part of twenty nodes goes layer by layer, the path in tasks
        monkeypatch.setattr(G, "PART_LINKS", most)
        found = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, links).collect()}
        assert found == pytest.approx(expected)


def test_components_are_named_by_their_smallest_node(spark):
    path = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("200", "201"), ("201", "202"), ("200", "202"), ("300", "300")]
    links = spark.createDataFrame([("K", *p) for p in path], "case_id string, a string, b string")
    found = {r["id"]: r["component"] for r in G.components(links).collect()}
    assert found == {f"{i:03}": "000" for i in range(61)} | {x: "200" for x in ("200", "201", "202")}
