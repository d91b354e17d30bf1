import random

from pyspark.sql import functions as F

from caseweave.operators import mappers as M

UNITS = "case_id string, doc_id string, unit_index long, kind string, cells array<string>, sheet string"
HEADERS = [["Caller", "Callee"], ["x", "Caller", "Callee"], ["From", "To"]]  # the last one has no evidence of calls


def test_headers_in_force_equal_a_walk_over_the_units(spark):
    pick, units = random.Random(5), []
    for doc in ("a", "b", "c"):
        for i in pick.sample(range(200000), 300):
            kind = pick.choices(["row", "header", "text"], [20, 2, 1])[0]
            cells = pick.choice(HEADERS) if kind == "header" else ["1", "2", "3"] if kind == "row" else None
            units.append(("K", doc, i, "text" if kind == "text" else "row", cells, pick.choice(["s", "t"])))
    expected, force = {}, {}
    for _, doc, i, kind, cells, sheet in sorted(units, key=lambda u: (u[1], u[2])):
        if kind == "text":
            force = {k: v for k, v in force.items() if k[0] != doc}
        else:
            if cells in HEADERS:
                force[doc, sheet] = cells
            now = force.get((doc, sheet))
            expected[doc, i] = None if now in (None, HEADERS[2]) else now.index("Caller") + 1
    got = M.call_headers(spark.createDataFrame(units, UNITS)).select("doc_id", "unit_index", F.col("active.pos")[0].alias("at")).collect()
    assert {(r.doc_id, r.unit_index): r["at"] for r in got} == expected and len(got) == len(expected)
    assert len(set(expected.values())) == 3


def test_many_stops_and_groups_make_no_product(spark):
    """2 000 sheets next to 20 000 narrative units in one document: rows come back once, none doubled."""
    rows = spark.range(4000).select(F.lit("K").alias("case_id"), F.lit("d").alias("doc_id"), (F.col("id") * 10).alias("unit_index"), F.lit("row").alias("kind"),
                                    F.when(F.col("id") < 2000, F.array(F.lit("Caller"), F.lit("Callee"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("cells"),
                                    (F.col("id") % 2000).cast("string").alias("sheet"))
    loose = spark.range(20000).select(F.lit("K"), F.lit("d"), F.col("id") + 100000, F.lit("text"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))
    found = M.call_headers(rows.union(loose))
    assert found.count() == 4000 and found.filter("header is null and active is not null").count() == 2000
