import itertools
import random
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import functions as F

from caseweave.operators import graph as G
from caseweave.operators import windows as W
from caseweave.operators.aggregates import connections, neighbor_pairs


def random_graph(seed, n, p, cases=("x", "y")):
    rng = random.Random(seed)
    nodes = {c: [f"v{i}" for i in range(n)] for c in cases}
    pairs = {c: [(a, b) for a, b in itertools.combinations(sorted(nodes[c]), 2) if rng.random() < p] for c in cases}
    return nodes, pairs


def frames(spark, nodes, pairs):
    v = spark.createDataFrame([(c, i) for c in nodes for i in nodes[c]], "case_id string, id string")
    e = spark.createDataFrame([(c, a, b) for c in pairs for a, b in pairs[c]], "case_id string, a string, b string")
    return v, e


def brute_betweenness(nodes, pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b), adj[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for w in adj[u]:
                if w not in dist:
                    dist[w] = dist[u] + 1
                    queue.append(w)
                if dist[w] == dist[u] + 1:
                    paths[w] += paths[u]
        credit = defaultdict(float)
        for w in reversed(order):
            for u in adj[w]:
                if dist.get(u, -1) == dist[w] - 1:
                    credit[u] += paths[u] / paths[w] * (1 + credit[w])
            if w != s:
                score[w] += credit[w]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_routes_agree_with_brute_force(spark):
    nodes, pairs = random_graph(1, 14, 0.2)
    v, e = frames(spark, nodes, pairs)
    for options in ({}, {"dense_nodes": 0}, {"dense_nodes": 0, "source_rounds": 3}):
        got = {(r["case_id"], r["id"]): r["betweenness"] for r in G.betweenness(v, e, **options).collect()}
        for case in nodes:
            for key, value in brute_betweenness(nodes[case], pairs[case]).items():
                assert abs(got[case, key] - value) < 1e-12


def test_pagerank_with_isolates_and_salted_hub(spark, monkeypatch):
    nodes, pairs = random_graph(2, 12, 0.15)
    pairs["x"] += [("v0", f"v{i}") for i in range(1, 12) if ("v0", f"v{i}") not in pairs["x"]]  # a hub
    nodes["y"] += ["lonely1", "lonely2"]
    v, e = frames(spark, nodes, pairs)
    monkeypatch.setattr(G, "EDGES_PER_SALT", 3)  # the hub's links spread over several join keys
    got = {(r["case_id"], r["id"]): r["pagerank"] for r in G.pagerank(v, e, tol=1e-10).collect()}
    for case, names in nodes.items():
        n, index = len(names), {k: i for i, k in enumerate(names)}
        m = np.zeros((n, n))
        for a, b in pairs[case]:
            m[index[a], index[b]] = m[index[b], index[a]] = 1
        out = m.sum(1)
        rank = np.full(n, 1 / n)
        for _ in range(200):
            flow = (rank / np.where(out > 0, out, 1) * (out > 0)) @ m
            rank = 0.85 * (flow + rank[out == 0].sum() / n) + 0.15 / n
        for k in names:
            assert abs(got[case, k] - rank[index[k]]) < 1e-6


def test_common_neighbors_brute_force(spark):
    nodes, pairs = random_graph(3, 15, 0.35)
    _v, e = frames(spark, nodes, pairs)
    want = set()
    for case in pairs:
        linked = set(pairs[case])
        adj = defaultdict(set)
        for a, b in linked:
            adj[a].add(b), adj[b].add(a)
        want |= {(case, a, b, c) for a, b in linked for c in adj[a] & adj[b]}
    got = [tuple(r) for r in G.common_neighbors(e).select("case_id", "a", "b", "common").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_self_loop_counts_twice_and_single_node(spark):
    nodes = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "z")], "case_id string, id string")
    edges = spark.createDataFrame([("c", "a", "a"), ("c", "a", "b"), ("c", "b", "a")], "case_id string, source string, target string")
    got = {r["id"]: r["connections"] for r in connections(nodes, edges).collect()}
    assert got == {"a": 3, "b": 1, "z": 0}
    v, p = G.build_graph(nodes, edges)
    assert {r["id"]: r["degree"] for r in G.degree_centrality(v, p).collect()}["z"] == 1.0


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.choice([None, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at bigint, v double")
    numbered = W.number_rows(df, ["k"], "at", block=7)
    carried = W.running_max(df, ["k"], "at", {"m": F.struct("at", "v"), "top": F.col("v")}, block=7)
    seen, top = defaultdict(int), {}
    n = {(r["k"], r["at"]): r["row_number"] for r in numbered.collect()}
    c = {(r["k"], r["at"]): (r["m"]["at"], r["top"]) for r in carried.collect()}
    for k, at, v in rows:
        seen[k] += 1
        top[k] = v if top.get(k) is None else (top[k] if v is None else max(v, top[k]))
        assert n[k, at] == seen[k] and c[k, at] == (at, top[k])


def test_top_neighbors_ranks_before_the_shuffle(spark):
    edges = spark.createDataFrame([("c", "hub", f"n{i}", i) for i in range(50)], "case_id string, source string, target string, seq int")
    top = W.top_neighbors(neighbor_pairs(edges, "seq"), 4)
    assert [r["neighbor"] for r in top.filter("id = 'hub'").orderBy("rank").collect()] == ["n0", "n1", "n2", "n3"]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_long_path_and_pivots(spark):
    """A path of 700 nodes has known scores; pivots estimate them and all nodes as pivots give them exactly."""
    from caseweave.operators import graph as G
    n = 700
    nodes = spark.createDataFrame([("c", f"{i:04d}") for i in range(n)], "case_id string, id string")
    pairs = spark.createDataFrame([("c", f"{i:04d}", f"{i + 1:04d}") for i in range(n - 1)], "case_id string, a string, b string")
    want = {f"{i:04d}": 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}
    for options in ({}, {"pivots": n}):
        found = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, pairs, **options).collect()}
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)
    some = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, pairs, pivots=200).collect()}
    assert max(abs(some[k] - want[k]) for k in want) < 0.15
