"""Where quotes occur: blank ones, repeated documents and documents without a case."""
from __future__ import annotations

import os

import __spark_entry__ as entry
from caseweave.operators.proposals import locate_quotes
from compare import compare, duck

GIVEN = "/root/testdata/sf0.001"


def test_blank_quotes_occur_nowhere_and_no_case_is_one(spark):
    quotes = spark.createDataFrame([("c", "d", "0", "blank", "\u00a0 "), ("c", "d", "0", "plain", "b"), (None, "d", "0", "none", "b")],
                                   "case_id string, doc_id string, batch string, proposal_id string, quote string")
    passages = spark.createDataFrame([("c", "d", 0, "0", 5, "a  b b"), (None, "d", 0, "0", 0, " b"), ("c", "d", 1, "0", 0, " ")],
                                     "case_id string, doc_id string, unit_index bigint, batch string, passage_start int, passage string")
    found = {(r["proposal_id"], r["case_id"], r["start"], r["end"]) for r in locate_quotes(quotes, passages).collect()}
    assert found == {("plain", "c", 8, 9), ("plain", "c", 10, 11), ("none", None, 1, 2)}


def test_query_matches_its_sql_on_odd_documents(spark, tmp_path):
    texts = [(1, ""), (2, " \n\t"), (3, "\u00a0"), (4, "\u0085\u2003\u3000"), (5, None), (6, "a\\Eb\\"), (7, "x y x y"), (8, "\x0b"), (9, "\x1c"),
             (10, "\U0001f600  a"), (11, "a"), (11, "a"), (12, "a b\u00a0a"), (12, "a"), (13, "$1 \\1"), (None, "n")]
    rows = [(i, t, "en", None if i in (9, 12) else "s", 0) for i, t in texts]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/x")
    written = next(f for f in os.listdir(f"{tmp_path}/x") if f.endswith(".parquet"))
    for t in os.listdir(GIVEN):
        os.symlink(f"{tmp_path}/x/{written}" if t == "documents.parquet" else f"{GIVEN}/{t}", f"{tmp_path}/{t}")
    name = "j10_locate_quotes"
    verdict = compare(spark, duck(str(tmp_path)), str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok 8 rows"
