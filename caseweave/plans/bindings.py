"""Entities, edges, documents and units derived from the star-schema tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iteration import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


class Source:
    """Lazy access to the tables of one folder and to what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        """Spark SQL over {table} placeholders."""
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in query}
        return self.spark.sql(query, **used)

    def edges(self) -> DataFrame:
        """One evidence edge per order line: customer -ORDERED_FROM-> supplier, case = customer's nation."""
        return self.sql(f"select *, true active from ({EDGES_SQL})")

    def entities(self) -> DataFrame:
        """Customers of the case, and the suppliers its edges name."""
        customers = self.sql(CUSTOMERS_SQL)
        partners = self.edges().select("case_id", "s_key").distinct()
        suppliers = self.table("supplier").select(
            F.col("s_suppkey").alias("s_key"), F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("id"),
            F.col("s_name").alias("label"), F.lit("Organization").alias("type"),
            F.lower("s_name").alias("normalized_value"), (F.col("s_suppkey") + 1000000000000).alias("seq"))
        return customers.unionByName(partners.join(suppliers, "s_key").drop("s_key")).withColumn(
            "active", F.lit(True))

    def documents(self) -> DataFrame:
        """One document per order of the case."""
        return self.sql(DOCUMENTS_SQL)

    def sightings(self) -> DataFrame:
        """(case_id, id, report_id): which order report names which entity."""
        edges = self.edges()
        return edges.select("case_id", F.explode(F.array("source", "target")).alias("id"), "report_id").distinct()

    def texts(self) -> DataFrame:
        """The documents table as text units; its source is the case."""
        return spread(self.table("documents")).select(
            F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("doc_id"),
            F.lit(0).cast("bigint").alias("unit_index"), F.lit("text").alias("kind"), "text")

    def narratives(self) -> DataFrame:
        """Orders told as sentences: text units for the extraction operators."""
        return spread(self.sql(NARRATIVES_SQL))


# The same text runs on both engines; {t} names a table in Spark, t in the oracle.
EDGES_SQL = """
select cast(c.c_nationkey as bigint) case_id,
  concat('customer:', cast(c.c_custkey as string)) source, concat('supplier:', cast(l.l_suppkey as string)) target,
  'ORDERED_FROM' type, concat('L', cast(l.l_orderkey as string), '-', cast(l.l_linenumber as string), '-',
    cast(l.l_partkey as string)) id,
  concat('O', cast(o.o_orderkey as string)) report_id, concat('D', cast(o.o_orderkey as string)) document_id,
  substr(cast(l.l_shipdate as string), 1, 10) timestamp, nullif(l.l_discount, 0.0) confidence,
  case when l.l_returnflag = 'R' then 'returned-rows' else 'order-rows' end method,
  l.l_extendedprice amount, l.l_orderkey * 8 + l.l_linenumber seq, l.l_suppkey s_key,
  concat('line ', cast(l.l_linenumber as string)) evidence_text, 'recorded' origin, 'pending' review_status
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {customer} c on o.o_custkey = c.c_custkey
"""
CUSTOMERS_SQL = """
select cast(c_nationkey as bigint) case_id, concat('customer:', cast(c_custkey as string)) id, c_name label,
  'Person' type, lower(c_name) normalized_value, c_custkey seq
from {customer}
"""
DOCUMENTS_SQL = """
select cast(c.c_nationkey as bigint) case_id, concat('D', cast(o.o_orderkey as string)) document_id,
  concat('O', cast(o.o_orderkey as string)) report_id, concat('order-', cast(o.o_orderkey as string), '.txt') filename,
  substr(cast(o.o_orderdate as string), 1, 10) uploaded_at,
  case o.o_orderstatus when 'F' then 'completed' when 'O' then 'processing' else 'failed' end processing_status
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
"""
# seven sentence forms chosen by the order key; forms 0, 1, 2 and 5 state a call
NARRATIVE_PHONES = ("concat('9', lpad(cast(o_custkey as string), 9, '0'))",
                    "concat('8', lpad(cast(o_orderkey as string), 9, '0'))")
NARRATIVES_SQL = f"""
select concat('K', cast(o_custkey % 5 as string)) case_id, cast(o_orderkey as string) doc_id,
  cast(0 as bigint) unit_index, 'text' kind,
  concat(case o_orderkey % 7
    when 0 then concat('Phone ', a, ' called phone ', b, '.')
    when 1 then concat('On 18 September 2026, phone ', a, ' called phone ', b, '.')
    when 2 then concat('The witness stated that phone ', a, ' called phone ', b, '.')
    when 3 then concat('Phone ', a, ' never called phone ', b, '.')
    when 4 then concat('If phone ', a, ' called phone ', b, ', investigate.')
    when 5 then concat('Phone no. ', a, ' called phone no. ', b, '.')
    else concat('Phone ', a, ' and phone ', b, ' appear in this report.') end,
    ' Dr. A. Verma noted it. Account ', lpad(cast(o_custkey as string), 12, '0'), ' transferred INR ',
    cast(o_orderkey % 9 + 1 as string), ',', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.50 to account ',
    lpad(cast(o_orderkey + 1 as string), 13, '0'), '.') text
from (select o_custkey, o_orderkey, {NARRATIVE_PHONES[0]} a, {NARRATIVE_PHONES[1]} b from {{orders}}) t
"""


def oracle(query: str) -> str:
    """Oracle spelling of a shared query: plain table names, VARCHAR casts."""
    for t in TABLES:
        query = query.replace("{" + t + "}", t)
    return query.replace(" as string)", " as varchar)")
