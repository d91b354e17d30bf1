import random

from caseweave.operators import flows as W

ROWS = "case_id string, id long, source long, target long, at long, amount long"


def transfers(seed, n, accounts, span):
    r = random.Random(seed)
    hot = lambda: 0 if r.random() < .4 else r.randrange(accounts)
    return [(r.choice("KL"), i, hot(), hot(), r.randrange(span), r.randrange(1, 100)) for i in range(n)]


def test_structuring_equals_every_window_summed(spark):
    rows = transfers(1, 400, 6, 300)
    for side, at in (("source", 2), ("target", 3)):
        expected = set()
        for case, i, *_, t, _ in (r for r in rows if r[5] < 40):
            mine = [r for r in rows if r[0] == case and r[at] == rows[i][at] and r[5] < 40 and t - 20 <= r[4] <= t]
            if len(mine) >= 3 and sum(r[5] for r in mine) >= 60:
                expected.add((case, rows[i][at], i, t, len(mine), sum(r[5] for r in mine)))
        found = W.structuring(spark.createDataFrame(rows, ROWS), 40, 60, 20, 3, side)
        assert {tuple(r) for r in found.collect()} == expected and expected


def test_coordinated_equals_distinct_senders_counted(spark):
    rows = transfers(2, 300, 8, 400)
    expected = set()
    for case, _, _, target, t, _ in rows:
        n = len({r[2] for r in rows if r[0] == case and r[3] == target and t - 30 <= r[4] <= t})
        if n >= 3:
            expected.add((case, target, t, n))
    assert {tuple(r) for r in W.coordinated(spark.createDataFrame(rows, ROWS), 30, 3).collect()} == expected and expected


def test_call_paths_equal_all_chains_tried(spark):
    rows = transfers(3, 120, 9, 500)
    ends = {(r[0], r[1], 1) for r in rows}
    for length in range(2, 5):
        ends |= {(b[0], b[1], length) for a in rows for b in rows if (a[0], a[1], length - 1) in ends and a[0] == b[0]
                 and a[3] == b[2] and 0 < b[4] - a[4] <= 60}
    paths = W.call_paths(spark.createDataFrame(rows, ROWS), 4, 60)
    assert {(r.case_id, r.id, r.length) for r in paths.collect()} == ends
    members = {}
    for r in W.path_members(paths, 3).collect():
        members.setdefault((r.case_id, r.path), []).append((r.place, r.id))
    longest = {}
    for case, i, length in ends:
        longest[case, i] = max(length, longest.get((case, i), 0))
    assert {k: len(v) for k, v in members.items()} == {k: n for k, n in longest.items() if n >= 3}
    for (_, last), chain in members.items():
        calls = [rows[i] for _, i in sorted(chain)]
        assert calls[-1][1] == last
        assert all(a[3] == b[2] and 0 < b[4] - a[4] <= 60 for a, b in zip(calls, calls[1:]))


def test_returning_flows_equal_all_walks_tried(spark):
    rows = transfers(4, 130, 9, 600)
    expected = {}
    for first in (r for r in rows if r[2] != r[3]):
        front = {(first[3], first[4])}
        for length in range(2, 6):
            front = {(r[3], r[4]) for place, at in front for r in rows if r[0] == first[0] and r[2] == place != r[3] and at < r[4] <= first[4] + 90}
            closed = [at for place, at in front if place == first[2]]
            if closed:
                expected[first[0], first[2], first[1]] = (length, min(closed))
                break
    found = W.returning_flows(spark.createDataFrame(rows, ROWS), 5, 90).collect()
    assert {(r.case_id, r.account, r.id): (r.length, r.closed_at) for r in found} == expected and len(found) == len(expected)
    assert {n for n, _ in expected.values()} >= {2, 3, 4}


def test_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert W.structuring(empty, 1, 1, 10).count() == W.coordinated(empty, 10).count() == W.call_paths(empty, 3).count() == 0
    assert W.returning_flows(empty, 4, 10).count() == 0
