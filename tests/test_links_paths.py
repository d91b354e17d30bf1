import math
import random
from collections import deque

from caseweave.operators import links as K
from caseweave.operators import paths as H

EDGES = "case_id string, source string, target string"


def random_links(seed, n, m, hubs=0):
    r = random.Random(seed)
    out = [(r.choice("KL"), f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
    return out + [(c, f"hub{h}", f"n{i}") for c in "KL" for h in range(hubs) for i in range(n)]


def around(links):
    out = {}
    for case, a, b in links:
        if a != b:
            out.setdefault((case, a), set()).add(b)
            out.setdefault((case, b), set()).add(a)
    return out


def test_predicted_links_equal_all_pairs_scored(spark):
    links = random_links(1, 60, 150, hubs=3) + [("K", f"leaf{i}", "hub0") for i in range(40)]
    near = around(links)
    expected = set()
    for (case, a), mine in near.items():
        found = []
        for (other_case, b), theirs in near.items():
            if case == other_case and a != b and b not in mine:
                score = round(sum(1 / math.log(len(near[case, z])) for z in mine & theirs), 9)
                if score >= 0.5:
                    found.append((-score, b, score))
        expected |= {(case, a, b, round(score, 6), i + 1) for i, (_, b, score) in enumerate(sorted(found)[:4])}
    got = K.predict_links(spark.createDataFrame(links, EDGES), 4, 0.5).collect()
    assert {(r.case_id, r.id, r.other, round(r.score, 6), r.rank) for r in got} == expected and expected


def distances(near, case, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near.get((case, x), ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def test_paths_equal_breadth_first_search(spark):
    links = random_links(2, 80, 90) + [("K", f"c{i}", f"c{i + 1}") for i in range(15)] + [("K", "c4", "c4")]
    near, r = around(links), random.Random(3)
    ends = [f"n{i}" for i in range(80)] + ["alone"]
    pairs = [(r.choice("KL"), i, r.choice(ends), r.choice(ends)) for i in range(150)] + [("K", 200, "c0", "c15"), ("K", 201, "c3", "c3"), ("K", 202, "c0", None)]
    found, steps = H.shortest_paths(spark.createDataFrame(links, EDGES), spark.createDataFrame(pairs, "case_id string, pair_id long, a string, b string"))
    expected = {(c, p): d for c, p, a, b in pairs if (d := distances(near, c, a).get(b)) is not None}
    assert {(x.case_id, x.pair_id): x.distance for x in found.collect()} == expected and expected["K", 200] == 15
    ways = {}
    for x in steps.collect():
        ways.setdefault((x.case_id, x.pair_id), []).append((x.place, x.id))
    ends_of = {(c, p): (a, b) for c, p, a, b in pairs}
    assert ways.keys() == expected.keys()
    for (case, pair), way in ways.items():
        way = sorted(way)
        assert [place for place, _ in way] == list(range(expected[case, pair] + 1))
        assert (way[0][1], way[-1][1]) == ends_of[case, pair]
        assert all(y in near[case, x] for (_, x), (_, y) in zip(way, way[1:]))


def test_no_rows(spark):
    none = spark.createDataFrame([], EDGES)
    assert K.predict_links(none).count() == 0
    found, steps = H.shortest_paths(none, spark.createDataFrame([], "case_id string, pair_id long, a string, b string"))
    assert found.count() == steps.count() == 0
