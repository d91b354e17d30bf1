"""Registration of named queries with their SQL counterparts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# named inputs of the SQL counterparts; unused ones are never evaluated
COMMON = f"""
with ev as ({B.oracle(B.EDGES_SQL)}),
cust as ({B.oracle(B.CUSTOMERS_SQL)}),
docs as ({B.oracle(B.DOCUMENTS_SQL)}),
ent as (select case_id, id, label, type, normalized_value, cast(seq as bigint) seq from cust union all
  select p.case_id, concat('supplier:', cast(s_suppkey as varchar)), s_name, 'Organization', lower(s_name),
    cast(s_suppkey as bigint) + 1000000000000
  from (select distinct case_id, s_key from ev) p join supplier on s_key = s_suppkey),
ends as (select case_id, source id, target neighbor, seq, type, report_id, confidence from ev union all
  select case_id, target, source, seq, type, report_id, confidence from ev),
sight as (select distinct case_id, id, report_id from ends),
und as (select distinct case_id, least(source, target) a, greatest(source, target) b from ev),
adj as (select case_id, a id, b neighbor from und union all select case_id, b, a from und),
conn as (select e.*, coalesce(n, 0) connections from ent e left join
  (select case_id, id, count(*) n from adj group by 1, 2) d using (case_id, id)),
srcs as (select case_id, id, count(distinct report_id) sources from ends group by 1, 2),
hub as (select case_id, id entity_id, label entity, connections, sources,
  case when connections >= 5 or sources >= 2 then 'high' else 'medium' end severity,
  cast(least(0.98, round(0.70 + connections * 0.04 + sources * 0.03, 2)) as double) confidence_score
  from conn join srcs using (case_id, id) where connections >= 3),
narr as ({B.oracle(B.NARRATIVES_SQL)}),
texts as (select source case_id, cast(doc_id as varchar) doc_id, text from documents)
"""


def query(name: str, sql: str | None = None):
    """Register ``fn(source) -> DataFrame``; ``sql`` is its oracle over the same tables."""
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(B.Source(spark, folder))
        if sql is not None:
            ORACLES[name] = COMMON + sql
        return fn
    return add
