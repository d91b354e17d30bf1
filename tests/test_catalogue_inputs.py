"""Registered queries on tables as large copies hold them: several files a table, repeated rows."""
import os
import shutil

import __spark_entry__ as entry
from caseweave.plans.bindings import TABLES
from compare import duck

SMALL = "/root/testdata/sf0.001"


def test_tables_of_several_files_arrive_as_originals(spark, tmp_path):
    for t in TABLES:
        if t == "lineitem":
            spark.read.parquet(f"{SMALL}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            shutil.copy(f"{SMALL}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    assert len([f for f in os.listdir(tmp_path / "lineitem.parquet") if f.endswith(".parquet")]) == 3
    found = entry.queries()["r1_stream_originals"](spark, str(tmp_path)).collect()
    assert sorted((r["filename"], r["digested"]) for r in found) == sorted((f"{t}.parquet", True) for t in TABLES)


def test_the_ranges_of_the_sql_do_not_hang_on_the_order_of_equal_rows():
    sql = entry.oracle_sql()["w9_merge_ranges"]
    found = set()
    for threads in (1, 8):
        con = duck("/root/testdata/sf0.1")
        con.execute(f"set threads = {threads}")
        found.add(tuple(con.execute(f'select count(*), sum(hash(l_orderkey, "start", "end")) from ({sql})').fetchone()))
    assert len(found) == 1


def test_first_leads_follow_the_lines(spark, tmp_path):
    """Without lines there is no trade, so no lead: the page is not made of customers' and suppliers' places alone."""
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        shutil.copy(f"{SMALL}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    os.remove(tmp_path / "lineitem.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert entry.queries()["t3_first_leads"](spark, SMALL).count() == 12
    assert entry.queries()["t3_first_leads"](spark, str(tmp_path)).count() == 0
