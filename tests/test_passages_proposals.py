import re

from pyspark.sql import functions as F

from caseweave.operators.passages import plan_passages
from caseweave.operators.proposals import validate_proposals

UNITS = "case_id string, doc_id string, unit_index bigint, kind string, text string"
NAMES = ("Sam", "Tara", "Noor")


def corpus(spark, docs):
    """docs: {doc: [unit texts]} with the three names as entities."""
    units = [("c", d, i, "page", t) for d, texts in docs.items() for i, t in enumerate(texts)]
    mentions = [("c", d, i, n.lower(), n, m.start(), m.end()) for d, texts in docs.items() for i, t in enumerate(texts)
                for n in NAMES for m in re.finditer(n, t)]
    return (spark.createDataFrame(units, UNITS), spark.createDataFrame(
        mentions, "case_id string, doc_id string, unit_index bigint, entity_id string, label string, start int, end int"))


def check(spark, rows, size=10000, overlap=1000):
    """rows: (doc, texts, quote, changes) -> {doc: sorted (type, origin, evidence)}, rejected docs."""
    docs = {}
    for d, texts, _q, _c in rows:
        docs[d] = texts
    units, mentions = corpus(spark, docs)
    plan, _m = plan_passages(units, mentions, size, overlap)
    proposals = []
    for k, (d, _t, quote, changes) in enumerate(rows):
        p = {"source": "sam", "target": "tara", "type": "CALLED", "origin": "asserted", **changes}
        proposals.append((str(k), "c", d, p["source"], p["target"], p["type"], quote, p["origin"]))
    table = spark.createDataFrame(proposals, "proposal_id string, case_id string, doc_id string, source string, target string, type string, quote string, origin string")
    batches = plan.select("doc_id", "batch").distinct()
    edges, rejects = validate_proposals(table.join(batches, "doc_id"), units, mentions, plan)
    found = {}
    for e in edges.collect():
        assert docs[e["doc_id"]][e["unit_index"]][e["start"]:e["end"]] == e["evidence_text"]
        found.setdefault(e["doc_id"], []).append((e["type"], e["origin"], e["evidence_text"], e["sentence_context"]))
    return {d: sorted(v) for d, v in found.items()}, {r["proposal_id"] for r in rejects.collect()}


def test_quotes_are_checked_against_their_source(spark):
    call = "Sam called Tara."
    reject = [
        ("deny1", ["Sam called Tara. Police denied this allegation."], call, {}), ("deny2", ["Police denied this claim. Sam called Tara."], call, {}),
        ("deny3", ["Sam called Tara. This statement remains disputed."], call, {}), ("neg", ["Sam did not call Tara."], "Sam did not call Tara.", {}),
        ("apos", ["Sam didn’t call Tara."], "Sam didn’t call Tara.", {}), ("crop", ["Police denied that Sam called Tara."], call, {}),
        ("if", ["If Sam called Tara, investigate."], "Sam called Tara", {}), ("type", [call], call, {"type": "GUILTY"}),
        ("self", [call], call, {"target": "sam"}), ("ghost", [call], call, {"source": "invented"}), ("origin", [call], call, {"origin": "x"}),
        ("invent", [call], "Sam met Tara.", {}), ("partial", [call], "called Tara.", {}), ("blank", [call], " ", {}),
        ("borrow", ["Sam called Tara. Noor was nearby."], call, {"source": "noor"}),
        ("bridge", [call, "Tara met Noor."], "Sam called Tara. Tara met Noor.", {"target": "noor"})]
    accept = [
        ("plain", ["Statement:\nSam   called\nTara."], call, {}, [("asserted", "Sam   called\nTara.")]),
        ("other", ["Noor did not call anyone. Sam called Tara."], call, {}, [("asserted", call)]),
        ("prefix", ["According to the witness statement. Sam called Tara."], call, {}, [("reported", call)]),
        ("stated", ["Witness stated that Sam called Tara."], call, {}, [("reported", call)]),
        ("sticky", [call], call, {"origin": "reported"}, [("reported", call)]),
        ("twice", ["Sam called Tara. Sam called Tara."], call, {}, [("asserted", call)] * 2),
        ("pages", [call, call], call, {}, [("asserted", call)] * 2),
        ("regex", ["Sam (a.k.a. [S]) called Tara\\E."], "Sam (a.k.a. [S])  called Tara\\E.", {}, [("asserted", "Sam (a.k.a. [S]) called Tara\\E.")])]
    found, rejected = check(spark, reject + [a[:4] for a in accept])
    assert rejected == {str(i) for i in range(len(reject))}
    assert {d: [(o, e) for _t, o, e, _c in v] for d, v in found.items()} == {a[0]: a[4] for a in accept}
    assert found["prefix"][0][3].startswith("According to the witness statement.")


def test_long_quotes_and_shortest_span(spark):
    long = "Sam " + "word " * 3000 + "called Tara."
    found, rejected = check(spark, [("long", [long], long, {}), ("dup", ["Note. Sam called Tara."], "Note. Sam called Tara.", {}),
                                    ("dup", ["Note. Sam called Tara."], "Sam called Tara.", {"origin": "reported"})], 40000, 100)
    assert not rejected and len(found["long"]) == 1
    assert [(o, e) for _t, o, e, _c in found["dup"]] == [("reported", "Sam called Tara.")]


def test_passage_plans(spark):
    filler, detail = "Procedural note. " * 400, " Routine detail. " * 400
    docs = {
        "long": [filler + "Witness said this happened. Sam called Tara at 09:15." + detail],
        "pages": ["Sam called Tara.", "Tara met Noor.", "Sam owns vehicle MH12AB1234 with Noor."],
        "apart": ["Sam made a statement. " + "Irrelevant detail. " * 40 + "Tara also made a statement."],
        "single": ["Noor was present."]}
    units, mentions = corpus(spark, docs)
    plan, metrics = plan_passages(units, mentions)
    m = {r["doc_id"]: r for r in metrics.collect()}
    assert set(m) == {"long", "pages", "apart"} and all(r["mode"] == "entity-context" for r in m.values())
    assert m["long"]["sent_chars"] < m["long"]["original_chars"] // 5
    assert (m["pages"]["original_requests"], m["pages"]["planned_requests"], m["pages"]["passage_count"]) == (3, 1, 3)
    assert (m["apart"]["planned_requests"], m["apart"]["passage_count"]) == (1, 2)
    long, = [r for r in plan.collect() if r["doc_id"] == "long"]
    text = docs["long"][0][long["start"]:long["end"]]
    assert "Witness said this happened." in text and "09:15" in text


def test_plans_never_expand(spark):
    docs = {"dense": ["Sam called Tara. " * 80], "over": ["Sam called Tara" + " lengthy information" * 50],
            "stranded": ["Sam called Tara. " + "Procedural note. " * 30 + "Sam " + "lengthy " * 35 + ".", "Sam called Tara.", "Tara met Noor."]}
    units, mentions = corpus(spark, docs)
    plan, metrics = plan_passages(units, mentions, 200, 20)
    m = {r["doc_id"]: r for r in metrics.collect()}
    assert m["stranded"]["mode"] == "full-context"
    for r in m.values():
        assert r["planned_requests"] <= r["original_requests"] and r["sent_chars"] <= r["original_chars"]
    full, metrics = plan_passages(units, mentions, 200, 20, compact=False)
    for r in metrics.collect():
        assert r["mode"] == "full-context" and r["sent_chars"] == r["original_chars"]
    assert full.filter(F.col("end") - F.col("start") > 200).count() == 0
