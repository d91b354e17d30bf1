"""What grows with the data is not gathered on the driver."""
from caseweave.operators.passages import plan_passages
from caseweave.operators.proposals import validate_proposals
from test_passages_proposals import corpus

MADE = "select 'c' case_id, cast(id as string) doc_id, 0L unit_index, 'page' kind, repeat('Sam called Tara. ', 50) text from range(10)"


def broadcasts(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_broadcast_by_proposals(spark):
    _u, mentions = corpus(spark, {"0": ["Sam called Tara."]})
    units = spark.sql(MADE)
    proposals = spark.createDataFrame([("p", "c", "0", "0", "sam", "tara", "CALLED", "Sam called Tara.", "asserted")],
                                      "proposal_id string, case_id string, doc_id string, batch string, source string, target string, type string, quote string, origin string")
    passages = units.selectExpr("case_id", "doc_id", "unit_index", "'0' batch", "0 start", "length(text) end")
    edges, rejects = validate_proposals(proposals, units, mentions, passages)
    assert not broadcasts(edges) and not broadcasts(rejects)
    assert edges.count() == 1 and rejects.count() == 0


def test_texts_are_not_broadcast_by_plans(spark):
    _u, mentions = corpus(spark, {"0": ["Sam called Tara."]})
    plan, metrics = plan_passages(spark.sql(MADE), mentions)
    assert not broadcasts(plan) and not broadcasts(metrics)
    assert [tuple(r) for r in metrics.select("doc_id", "original_requests").collect()] == [("0", 1)]
