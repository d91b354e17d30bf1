"""Queries for case patterns (p*): sequences, shared values, circles, distances and audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import patterns as P
from .graph import GRAPH_SQL, TRADE_SQL, trade_edges, trade_sides
from .registry import query

# orders as money moving between customers, at the second of their key within their day
MOVES = """select 'K' case_id, o_orderkey id, o_custkey source, cast(o_orderkey * 7 % 97 as bigint) target,
  cast(datediff(o_orderdate, date'1992-01-01') as bigint) * 86400 + o_orderkey % 86400 at from {orders}"""
MOVES_SQL = """, mv as (select 'K' case_id, o_orderkey id, o_custkey source, cast(o_orderkey * 7 % 97 as bigint) target,
  cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) * 86400 + o_orderkey % 86400 as at_ from orders)
"""


def moves(s):
    return s.sql(MOVES)


@query("p1_pass_through", MOVES_SQL + """select o.id, max_by(i.id, (i.at_, i.id)) prior_id from mv o join mv i on i.target = o.source
and i.at_ <= o.at_ and o.at_ - i.at_ <= 864000 group by o.id""")
def _(s):
    return P.pass_through(moves(s), 864000).select("id", "prior_id")


@query("p2_call_chains", MOVES_SQL + """select o.id, max_by(i.id, (i.at_, i.id)) prior_id, o.target from mv o join mv i on i.target = o.source
and i.at_ <= o.at_ group by o.id, o.target""")
def _(s):
    return P.call_chains(moves(s)).select("id", "prior_id", "target")


@query("p3_rarity_weights", """, sz as (select case_id, count(*) n from ent group by 1)
select case_id, id, connections degree, round(ln(n / connections), 9) weight from conn join sz using (case_id) where connections > 0""")
def _(s):
    return P.rarity_weights(s.entities(), s.edges()).select("case_id", "id", "degree", F.round("weight", 9).alias("weight"))


@query("p4_distances", GRAPH_SQL + """, ds as (with recursive w as (select case_id, min(id) id, 0 d from tn group by 1 union
  select w.case_id, nb, d + 1 from w join ta on ta.case_id = w.case_id and ta.id = w.id where d < 30) select * from w)
select case_id, id, min(d) distance from ds group by 1, 2""")
def _(s):
    nodes = s.entities().groupBy("case_id").agg(F.min("id").alias("id"))
    return P.distances(s.edges(), nodes).select("case_id", "id", "distance")


def _votes(k: int) -> str:
    return f"""c{k} as materialized (select case_id, id, c from (select *, row_number() over (partition by case_id, id order by n desc, c) r from (
  select case_id, id, c, count(*) n from (select ta.case_id, ta.id, l.c from ta join c{k - 1} l on l.case_id = ta.case_id and l.id = ta.nb
  union all select * from c{k - 1}) v group by 1, 2, 3) w) where r = 1)"""


@query("p5_communities", TRADE_SQL + ", c0 as (select case_id, id, id c from tn), " + ", ".join(_votes(k) for k in range(1, 11))
       + " select case_id, id, c community from c10")
def _(s):
    return P.communities(*trade_edges(s)).select("case_id", "id", "community")


@query("p7_circular_flows", TRADE_SQL + """, fl as (select distinct case_id, x, y from te where x <> y)
select p.case_id, p.x a, p.y b, q.y c from fl p join fl q on q.case_id = p.case_id and q.x = p.y join fl r on r.case_id = p.case_id
and r.x = q.y and r.y = p.x where p.x < p.y and p.x < q.y""")
def _(s):
    return P.circular_flows(trade_sides(s))


@query("p8_shared_values", """, h as (select distinct o_custkey % 1000 as owner, concat(o_orderdate, '|', o_orderpriority) as v from orders)
select v as "value", owner, count(*) over (partition by v) owners from h qualify count(*) over (partition by v) > 1""")
def _(s):
    owners = s.sql("select 'K' case_id, o_custkey % 1000 owner, concat(o_orderdate, '|', o_orderpriority) value from {orders}")
    return P.shared_values(owners).select("value", "owner", "owners")


@query("p9_login_then_transaction", """, l as (select cast(event_id as bigint) id, user_id, epoch_us(ts) // 1000000 as at_ from events where event_type = 'signup'),
t as (select cast(event_id as bigint) id, user_id, epoch_us(ts) // 1000000 as at_ from events where event_type = 'purchase')
select t.id, max_by(l.id, (l.at_, l.id)) prior_id from t join l on l.user_id = t.user_id and l.at_ <= t.at_ and t.at_ - l.at_ <= 8640000 group by 1""")
def _(s):
    events = s.table("events").select(F.lit("K").alias("case_id"), F.col("user_id").alias("person"), F.col("event_id").cast("bigint").alias("id"),
                                      F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    of = lambda kind: events.filter(F.col("event_type") == kind).drop("event_type")
    return P.login_then_transaction(of("signup"), of("purchase"), 8_640_000).select("id", "prior_id")


@query("p11_audit", """select 'linked' "check", count(*) "rows", count(*) filter (o_custkey not in (select c_custkey from customer)) violations from orders union all
select 'priced', count(*), count(*) filter (not coalesce(l_extendedprice > 0, false)) from lineitem union all
select 'shipped in order', count(*), count(*) filter (not coalesce(l_shipdate >= o_orderdate, false)) from lineitem join orders on l_orderkey = o_orderkey union all
select 'repeated', count(*), (select count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)) from lineitem""")
def _(s):
    orders, lines = s.table("orders"), s.table("lineitem")
    found = P.audit({"priced": (lines, "l_extendedprice > 0"),
                     "shipped in order": (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "l_shipdate >= o_orderdate")})
    lost = P.orphans(orders, s.table("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    rows = orders.agg(F.count("*").alias("rows")).crossJoin(lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")))
    again = lines.agg(F.count("*").alias("rows")).crossJoin(P.repeated_rows(lines, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("violations")))
    return found.unionByName(rows.select(F.lit("linked").alias("check"), "rows", "violations")).unionByName(
        again.select(F.lit("repeated").alias("check"), "rows", "violations"))


@query("p12_resolve_references", """select cast(o_orderkey as varchar) id, case when o_custkey % 3 = 0 then concat('ref:', o_custkey) else concat('person:', o_custkey) end source from orders""")
def _(s):
    edges = s.sql("""select 'K' case_id, cast(o_orderkey as string) id, concat('ref:', cast(o_custkey as string)) source, 'bank' target from {orders}""")
    refs = s.sql("select distinct 'K' case_id, concat('ref:', cast(o_custkey as string)) id, cast(o_custkey as string) external_id from {orders}")
    known = s.sql("select 'K' case_id, concat('person:', cast(c_custkey as string)) id, cast(c_custkey as string) external_id from {customer} where c_custkey % 3 <> 0")
    return P.resolve_references(edges, refs, known).select("id", "source")
