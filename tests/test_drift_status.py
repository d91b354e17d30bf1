import math
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import drift as D
from caseweave.operators import flows as W
from caseweave.operators.graph import pagerank
from caseweave.plans.extraction_run import run_extraction
from caseweave.streaming.jobs import pass_through_stream


def test_a_shifted_column_drifts_and_profiles_add_up(spark):
    r = random.Random(1)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1), None if i % 10 == 0 else float(i % 7)) for i in range(4000)]
    before = spark.createDataFrame(rows, "id long, same double, moved double, missing double")
    after = spark.createDataFrame([(i, r.gauss(0, 1), r.gauss(.8, 1), None if i % 2 else float(i % 7)) for i in range(4000)], before.schema)
    cuts = D.cut_points(before, ["same", "moved", "missing"])
    found = {x.column: x for x in D.drift(D.profile(before, cuts), D.profile(after, cuts)).collect()}
    assert found["moved"].drifted and found["missing"].drifted and not found["same"].drifted
    parts = [D.profile(before.filter(f"id % 3 = {k}"), cuts) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    again = {x.column: x["index"] for x in D.drift(merged, D.profile(after, cuts)).collect()}
    assert all(math.isclose(again[c], found[c]["index"], rel_tol=1e-9) for c in found)
    assert D.profile(before.limit(0), cuts).count() == 0


def test_status_follows_the_narrative_parts(spark):
    units = spark.createDataFrame([("K", d, 0, "text", "Phone 9876500001 called phone 9876500002.", None) for d in ("a", "b", "c")],
                                  "case_id string, doc_id string, unit_index bigint, kind string, text string, cells array<string>")
    parts = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", None)], "doc_id string, processed boolean")
    tables = run_extraction(units, F.timestamp_seconds(F.lit(0)), parts=parts)
    assert {r.report_id: r.status for r in tables["reports"].collect()} == {"a": "complete", "b": "relationships_pending", "c": "complete"}


def test_ranks_that_do_not_settle_are_an_error(spark):
    pairs = spark.createDataFrame([("K", f"n{i}", f"n{i + 1}") for i in range(20)], "case_id string, a string, b string")
    nodes = pairs.select("case_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    with pytest.raises(RuntimeError, match="after 3 iterations"):
        pagerank(nodes, pairs, max_iter=3, tol=1e-12)
    assert pagerank(nodes, pairs, max_iter=3, tol=None).count() == 21


def test_stream_finds_the_receipts_of_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("KL"), i, r.randrange(5), r.randrange(5), r.randrange(2000)) for i in range(200)]
    transfers = spark.createDataFrame(rows, "case_id string, id long, source long, target long, at long")
    expected = {(o[0], o[1], i[1]) for o in rows for i in rows if o[0] == i[0] and i[3] == o[2] and 0 <= o[4] - i[4] <= 60}
    assert {(x.case_id, x.id, x.prior_id) for x in W.receipts_before(transfers, 60).collect()} == expected
    timed = transfers.withColumn("ts", F.timestamp_seconds("at"))
    timed.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = pass_through_stream(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), "60 seconds", "1 hour")
    (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    assert {(x.case_id, x.id, x.prior_id) for x in found} == expected and len(found) == len(expected)
