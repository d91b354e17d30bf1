from caseweave.operators.joins import drop_dangling, rewrite_endpoints, settle_edges

EDGE = "case_id string, id string, source string, target string, note string"


def tables(spark, edges, alias):
    return (spark.createDataFrame(edges, EDGE), spark.createDataFrame(alias, "case_id string, id string, canonical_id string"),
            spark.createDataFrame([("c", x) for x in "abd"] + [("k", "a")], "case_id string, id string"))


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_settled_edges_are_those_of_rewriting_and_dropping(spark):
    edges = [("c", "1", "a", "b", "x"), ("c", "2", "a", "c", "y"), ("c", "3", "e", "c", None), ("c", "4", "z", "a", "lost"), ("c", "5", "a", "z", "lost"),
             ("c", "6", None, "a", "null"), (None, "7", "a", "b", "null"), ("k", "8", "a", "a", "loop"), ("k", "9", "b", "a", "other case"), ("c", "1", "a", "b", "x"),
             ("c", "10", "c", "c", "both")]
    for alias in ([("c", "c", "d"), ("c", "e", "b"), ("k", "c", "a")], [("c", "c", "d"), ("c", "c", "b")], []):
        e, a, n = tables(spark, edges, alias)
        assert rows(settle_edges(e, a, n)) == rows(drop_dangling(rewrite_endpoints(e, a), n))
    e, a, n = tables(spark, edges[:1], [])
    assert rows(settle_edges(e, a, n)) == rows(drop_dangling(rewrite_endpoints(e, a), n))
    e, a, n = tables(spark, [], [])
    assert rows(settle_edges(e, a, n)) == []


def test_edges_whose_ends_stay_are_not_joined_again(spark):
    e, a, n = tables(spark, [("c", "1", "a", "b", "x")], [])
    plan = settle_edges(e, a, n)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_the_listed_entities_are_ranked_before_their_edges_are_read(spark):
    from caseweave.plans.bindings import Source
    from caseweave.plans.reports import report_connected
    from caseweave.plans.workspace import case_workspace
    s = Source(spark, "/root/testdata/sf0.001")
    found = report_connected(case_workspace(s.entities(), s.edges(), s.documents()))
    assert "connections" not in "".join(l for l in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in l)
