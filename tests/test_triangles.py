"""Triangles are found from links that are written once and dealt few times."""
import itertools
import random

from caseweave.operators import graph as G
from caseweave.operators.leads import leads_shared
from caseweave.operators.patterns import circular_flows

LINKS = "case_id string, source string, target string, report_id string"


def random_links(spark, seed=5, nodes=14):
    rng = random.Random(seed)
    rows = [(c, f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice([None, "r1", "r2"])) for c in "xy" for _ in range(90)]
    return rows, spark.createDataFrame(rows, LINKS)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_common_neighbors_deal_links_few_times(spark):
    _rows, links = random_links(spark)
    assert exchanges(G.common_neighbors(links.selectExpr("case_id", "least(source, target) a", "greatest(source, target) b").distinct())) <= 6


def test_circles_by_brute_force_and_few_exchanges(spark):
    rows, links = random_links(spark)
    arcs = {(c, s, t) for c, s, t, _r in rows if s != t}
    want = {(c, *p) for c in "xy" for p in itertools.permutations({a for x in arcs for a in x[1:]}, 3)
            if p[0] == min(p) and all((c, p[i], p[(i + 1) % 3]) in arcs for i in range(3))}
    found = circular_flows(links)
    assert exchanges(found) <= 6
    got = [tuple(r) for r in found.select("case_id", "a", "b", "c").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_shared_leads_by_brute_force_and_few_exchanges(spark):
    rows, links = random_links(spark)
    near, refs = {}, {}
    for c, s, t, r in rows:
        if s != t:
            near.setdefault((c, s), set()).add(t), near.setdefault((c, t), set()).add(s)
            refs.setdefault((c, *sorted((s, t))), set()).add(r)
    want = {}
    for c, a, b in refs:
        if both := near[c, a] & near[c, b]:
            common = min(both)
            want[c, f"{a}|{b}"] = len(refs[c, *sorted((a, common))] | refs[c, *sorted((b, common))])
    nodes = links.selectExpr("case_id", "explode(array(source, target)) id").distinct().selectExpr("case_id", "id", "id label")
    found = leads_shared(nodes, links)
    assert exchanges(found) <= 16
    got = {(r["case_id"], r["entity_id"]): r["sources"] for r in found.collect()}
    assert got == want
