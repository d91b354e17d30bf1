"""Cases that once gave wrong or no results."""
import unicodedata

from pyspark.sql import functions as F

from caseweave.functions import identifiers as I
from caseweave.functions import text as X
from caseweave.operators import leads as L
from caseweave.operators import lifecycle as C
from caseweave.operators.extraction import tag_gazetteer
from caseweave.sources import store


def test_upsert_takes_map_columns(spark):
    schema = "case_id string, id string, event map<string,string>, created_at int, updated_at int"
    old = spark.createDataFrame([("c", "e", {"a": "1"}, 1, 1)], schema)
    new = spark.createDataFrame([("c", "e", {"a": "2"}, 5, 5), ("c", "f", {"b": "3"}, 5, 5)], schema)
    rows = {r["id"]: (r["event"], r["created_at"]) for r in C.upsert(old, new, ["case_id", "id"]).collect()}
    assert rows == {"e": ({"a": "2"}, 1), "f": ({"b": "3"}, 5)}


def test_graph_keeps_what_it_stored(spark, tmp_path):
    nodes = lambda *ids: spark.createDataFrame([("c", i, i.upper()) for i in ids], "case_id string, id string, label string")
    edges = lambda *rows: spark.createDataFrame([("c", *r) for r in rows], "case_id string, id string, source string, target string")
    store.write_graph(nodes("a", "b"), edges(("1", "a", "b"), ("1", "b", "a")), str(tmp_path))
    for _ in range(2):
        store.write_graph(nodes("x", "y"), edges(("2", "x", "a"), ("3", "x", "gone")), str(tmp_path))
    read = lambda name: sorted(r["id"] for r in spark.read.parquet(store.table_path(str(tmp_path), name)).collect())
    assert read("nodes") == ["a", "b", "x", "y"] and read("edges") == ["1", "1", "2"]


def test_self_loop_is_one_neighbour(spark):
    nodes = spark.createDataFrame([("c", i, i, "T") for i in "abd"], "case_id string, id string, label string, type string")
    edges = spark.createDataFrame([("c", "a", "a", "r", 1, "K"), ("c", "a", "b", "r", 2, "K")],
                                  "case_id string, source string, target string, report_id string, seq int, type string")
    assert L.leads_cross_domain(nodes, edges).count() == 0
    more = edges.union(spark.createDataFrame([("c", "d", "a", "r", 3, "K")], edges.schema))
    assert [r["connections"] for r in L.leads_cross_domain(nodes, more).collect()] == [3]


def test_reviews_name_the_report(spark):
    edges = spark.createDataFrame([("c", r, "rel:tx-3", "pending") for r in ("r1", "r2")],
                                  "case_id string, report_id string, id string, review_status string")
    reviews = spark.createDataFrame([("c", "r1", "rel:tx-3", "accepted", 1)],
                                    "case_id string, report_id string, id string, review_status string, updated_at int")
    assert {r["report_id"]: r["review_status"] for r in C.apply_reviews(edges, reviews).collect()} == {
        "r1": "accepted", "r2": "pending"}


def test_purge_takes_sightings_and_keeps_the_case(spark):
    row = lambda name, *cols: spark.createDataFrame([("c",) + tuple("x" for _ in cols)], "case_id string" + "".join(f", {c} string" for c in cols))
    tables = {n: row(n, "id") for n in (*C.CASE_TABLES, "sightings")}
    tables["cases"] = spark.createDataFrame([("other",)], "id string")
    remaining, removed = C.purge_case(tables, "c")
    assert remaining["sightings"].count() == 0 and {r["id"] for r in remaining["cases"].collect()} == {"other", "c"}
    assert {r["table_name"]: r["removed"] for r in removed.collect()}["sightings"] == 1
    assert [r["id"] for r in C.purge_case(tables, "c", drop_case=True)[0]["cases"].collect()] == ["other"]


def test_white_space_of_all_kinds(spark):
    one = spark.range(1)
    assert one.select(I.normalize_phone(F.lit("\t9876543210\r"))).first()[0] == "+919876543210"
    assert one.select(I.cell(F.array(F.lit(" x\t")), F.lit(1))).first()[0] == "x"
    for space in (" ", "\u0085", " "):
        spans = one.select(X.sentences(F.lit(f"One ends.{space}Two begins."))).first()[0]
        assert [(s["start"], s["end"]) for s in spans] == [(0, 9), (9, 21)]


def test_long_texts_are_tagged(spark):
    text = "alpha beta, gamma. " * 6000 + "Jane  Doe here"
    units = spark.createDataFrame([("c", "d", 0, text)], "case_id string, doc_id string, unit_index bigint, text string")
    names = spark.createDataFrame([("jane doe", "Person"), ("jane", "Person")], "name string, type string")
    _, mentions = tag_gazetteer(units, names)
    assert [(r["label"], r["start"], r["end"]) for r in mentions.collect()] == [("Jane  Doe", len(text) - 14, len(text) - 5)]


def test_compatibility_form(spark):
    values = ["ﬁle", "①②", "Ａｂ", "é", "plain", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", I.nfkc(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in rows] == [v and unicodedata.normalize("NFKC", v) for v in values]


def test_chunks_end_at_sentences(spark):
    text = "One two three. Four five six.  Seven eight nine ten eleven twelve thirteen\n \nLast words"
    rows = spark.range(1).select(X.chunk(F.lit(text), 40, 15)).first()[0]
    found = [(r["start"], r["end"], r["clipped"]) for r in rows]
    assert found[0] == (0, 31, False) and found[-1][1] == len(text)
    assert all(a[1] > a[0] and b[0] > a[0] and b[0] <= a[1] for a, b in zip(found, found[1:]))
    assert all(clip or end == len(text) or text[:end].rstrip().endswith(".") or "\n" in text[end - 3:end] for _, end, clip in found)
