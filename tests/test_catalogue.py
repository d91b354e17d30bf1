"""Registered queries next to their SQL on the smallest tables.

The default run takes a sample of every family; CATALOGUE=all takes all of them.
"""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = """f6_visible_graph j2_rewrite_endpoints u6_soft_delete a1_dedupe_entities a4_connections w12_top_neighbors
t4_top_k x13_find_spans x15_sentences k1_workspace m2_reanalyze r3_pair_windows""".split()
NAMES = [n for n in entry.queries() if os.environ.get("CATALOGUE") == "all" or n in SAMPLE]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    verdict = compare(spark, duck(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
