"""Queries for aggregates (a*), windows (w*) and rankings (t*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import chunk, pack, sentences
from ...operators import aggregates as A
from ...operators import ranking as T
from ...operators import windows as W
from ...operators.extraction import UNIT, sentence_rows
from ...operators.leads import leads_hub
from .filters_joins import SEGMENT_ALIAS, segment_groups
from .registry import ORACLES, query

# --- aggregates --------------------------------------------------------------------


@query("a1_dedupe_entities", """select case_id, source id, case when bool_or(not n) then max_by(id, struct_pack(p := p, s := seq, i := id))
  filter (not n) else min_by(id, struct_pack(p := p, s := seq, i := id)) end picked
from (select *, seq % 3 p, case_id % 4 = 0 or method = 'order-rows' n from ev) group by 1, 2""")
def _(s):
    rows = s.edges().select("case_id", F.col("source").alias("entity"), F.col("id").alias("picked"),
                            (F.col("seq") % 3).alias("priority"), F.struct("seq", "id").alias("seq"),
                            ((F.col("case_id") % 4 == 0) | (F.col("method") == "order-rows")).alias("narrative"))
    return A.dedupe_entities(rows, ["case_id", "entity"]).withColumnRenamed("entity", "id")


@query("a2_collapse_aliases", SEGMENT_ALIAS + """select case_id, canonical_id id, count(*) alias_count,
'unverified-name-group' identity_status from al group by 1, 2""")
def _(s):
    groups, _a, _r = segment_groups(s)
    return groups.select("case_id", "id", "alias_count", "identity_status")


@query("a3_edge_bundle", """select case_id, source, target, type, count(*) occurrence_count from ev group by 1, 2, 3, 4""")
def _(s):
    return A.bundle_edges(s.edges())[0]


@query("a4_connections", "select case_id, id, label, connections from conn")
def _(s):
    return A.connections(s.entities(), s.edges()).select("case_id", "id", "label", "connections")


@query("a5_multi_degree", """select e.case_id, e.id, coalesce(n, 0) multi_degree from ent e left join
(select case_id, id, count(*) n from ends group by 1, 2) using (case_id, id)""")
def _(s):
    return A.multi_degree(s.entities(), s.edges()).select("case_id", "id", "multi_degree")


@query("a6_overview", """select case_id, (select count(*) from ent where ent.case_id = c.case_id) nodes,
(select count(*) from ev where ev.case_id = c.case_id) edges, (select count(*) from docs where docs.case_id = c.case_id) reports,
(select count(*) from hub where hub.case_id = c.case_id) leads from (select distinct case_id from docs) c""")
def _(s):
    nodes, edges = s.entities(), s.edges()
    leads = leads_hub(A.connections(nodes, edges), edges)
    docs = s.documents()
    return A.overview(nodes, edges, docs, leads).join(docs.select("case_id").distinct(), "case_id", "left_semi")


@query("a7_counts_by_type", """select case_id, count(*) nodes, count(*) filter (type = 'Person') person_count,
count(*) filter (type = 'Organization') organization_count from ent group by 1""")
def _(s):
    return A.counts_by_type(s.entities(), ["Person", "Organization"], ["case_id"])


@query("a8_report_counts", """select report_id, (select count(*) from sight s where s.report_id = r.report_id) entity_count,
count(*) * 2 mention_count, count(*) relationship_count from ev r group by report_id""")
def _(s):
    edges = s.edges()
    return A.report_counts(s.sightings(), edges.select("report_id", F.explode(F.array("source", "target"))), edges)


@query("a9_supporting_sources", "select case_id, id, report_id source_ref from sight")
def _(s):
    return A.supporting_sources(s.edges())


@query("a10_neighbor_kinds", """select a.case_id, a.id, count(distinct e.type) kinds from adj a
join ent e on e.case_id = a.case_id and e.id = a.neighbor group by 1, 2""")
def _(s):
    return A.neighbor_kinds(s.entities(), s.edges())


@query("a11_distinct_ids", "select report_id from ev union select report_id from docs")
def _(s):
    from ...operators.sets import distinct_ids
    return distinct_ids("report_id", s.edges(), s.documents())


@query("a12_distinct_warnings", """select o_orderkey, case when o_orderpriority = o_orderstatus then o_orderpriority
else concat(o_orderpriority, ';', o_orderstatus) end warnings from orders""")
def _(s):
    w = s.table("orders").select("o_orderkey", F.array(
        "o_orderpriority", "o_orderstatus", "o_orderpriority", "o_orderstatus").alias("warnings"))
    return A.distinct_warnings(w).withColumn("warnings", F.array_join("warnings", ";"))


@query("a13_accumulate_reports", "select case_id, id, report_id from sight")
def _(s):
    edges = s.edges()
    half = lambda end: edges.select("case_id", F.col(end).alias("id"), "report_id")
    return A.accumulate_reports(half("source"), half("target"))


@query("a14_batch_status", """select count(*) total, count(*) filter (o_orderstatus = 'F') completed,
count(*) filter (o_orderstatus = 'P') failed from orders""")
def _(s):
    return A.batch_status(s.sql("""select case o_orderstatus when 'F' then 'complete' when 'P' then 'failed'
        else 'queued' end status from {orders}"""))


@query("a15_entity_profile", """select case_id, id, count(distinct neighbor) connected_entities, count(*) relationship_rows
from ends group by 1, 2""")
def _(s):
    return A.entity_profile(s.edges())


@query("a17_rejections", """select method, count(*) rejected from ev where confidence < 0.03 group by 1""")
def _(s):
    return A.rejections(s.edges().filter("confidence < 0.03"), "method")


@query("a18_run_complete", """select report_id, case when bool_and(l_linestatus = 'F') then 'complete'
else 'relationships_pending' end status from (select concat('O', cast(l_orderkey as varchar)) report_id, l_linestatus from lineitem)
group by 1""")
def _(s):
    return A.run_complete(s.sql("""select concat('O', cast(l_orderkey as string)) report_id, l_linestatus = 'F' processed
        from {lineitem}"""))


@query("a19_document_warnings", """select cast(o_orderkey as varchar) doc_id,
  case when o_orderkey % 6 = 0 then 0 else 1 end + case when exists (select 1 from lineitem where l_orderkey = o_orderkey
    and l_quantity > 30) then 0 else 1 end + case when o_orderkey % 2 = 0 then 1 else 0 end n_warnings from orders""")
def _(s):
    orders = s.table("orders")
    units = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("unit_index"),
                          F.lit("row").alias("kind"), "o_orderkey")
    handled = units.filter("o_orderkey % 2 <> 0").select("doc_id", "unit_index")
    edges = s.table("lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").cast("string").alias("doc_id"))
    mapped = units.filter("o_orderkey % 6 = 0")
    return A.document_warnings(units, handled, edges, mapped).select("doc_id", F.size("warnings").alias("n_warnings"))


@query("a20_last_updated", "select case_id, max(uploaded_at) last_updated from docs group by 1")
def _(s):
    return A.last_updated(s.documents())


# --- windows -----------------------------------------------------------------------


@query("w1_dedupe_mentions", """select l_orderkey, l_suppkey, max(l_partkey) seq from lineitem group by 1, 2""")
def _(s):
    m = s.sql("""select cast(l_orderkey as string) doc_id, cast(l_suppkey as string) entity_id, 0 unit_index, 0 start,
        1 end, 'm' method, l_partkey seq, l_orderkey, l_suppkey from {lineitem}""")
    return W.dedupe_mentions(m).select("l_orderkey", "l_suppkey", "seq")


@query("w5_number_rows", """select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority
order by o_orderkey) row_number from orders""")
def _(s):
    rows = s.table("orders").select("o_orderpriority", "o_orderkey")
    return W.number_rows(rows, ["o_orderpriority"], "o_orderkey", block=1024)


@query("w6_earliest_anchor", """select l_suppkey, min(struct_pack(a := l_partkey, b := l_linenumber)).a "start",
cast(min(struct_pack(a := l_partkey, b := l_linenumber)).b as bigint) "end" from lineitem group by 1""")
def _(s):
    m = s.sql("select l_suppkey, l_partkey start, cast(l_linenumber as bigint) end from {lineitem}")
    return W.earliest_anchor(m, ["l_suppkey"])


@query("w7_best_proposal", """select l_suppkey, min(struct_pack(a := q - p, b := p)).b "start",
min(struct_pack(a := q - p, b := p)).a + min(struct_pack(a := q - p, b := p)).b "end", bool_or(r) reported
from (select l_suppkey, l_partkey p, l_partkey + l_linenumber q, l_returnflag = 'R' and l_linenumber > 6 r from lineitem) group by 1""")
def _(s):
    m = s.sql("""select l_suppkey, l_partkey start, l_partkey + l_linenumber end,
        l_returnflag = 'R' and l_linenumber > 6 reported from {lineitem}""")
    return W.best_proposal(m, ["l_suppkey"])


@query("w8_reuse_target", """select case_id, sha256, document_id from (select source case_id, sha256(text) sha256,
  cast(doc_id as varchar) document_id, row_number() over (partition by source, sha256(text) order by doc_id % 3 <> 0, doc_id) r
  from documents) where r = 1""")
def _(s):
    docs = s.table("documents").select(
        F.col("source").alias("case_id"), F.sha2("text", 256).alias("sha256"),
        F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("uploaded_at"),
        F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("failed").alias("processing_status"))
    return W.reuse_target(docs).select("case_id", "sha256", "document_id")


@query("w9_merge_ranges", """, r as (select distinct l_orderkey k, l_linenumber * 10 s, l_linenumber * 10 + cast(l_quantity as bigint) % 30 e
  from lineitem), m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) p from r),
g as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by k order by s, e
  rows unbounded preceding) i from m)
select k l_orderkey, cast(min(s) as bigint) "start", max(e) "end" from g group by k, i""")
def _(s):
    """Lines of an order play the ranges of one text unit."""
    r = s.sql("""select l_orderkey, cast(l_linenumber * 10 as bigint) start,
        l_linenumber * 10 + cast(l_quantity as bigint) % 30 end from {lineitem}""")
    return W.merge_ranges(r, ["l_orderkey"])


@query("w10_expand_neighbors", """select distinct l_orderkey, n sentence_index from lineitem,
  unnest([l_linenumber - 1, l_linenumber, l_linenumber + 1]) t(n) where l_returnflag = 'R' and n between 0 and 7""")
def _(s):
    """Line numbers play sentences: those of returned lines, with their neighbours."""
    sents = s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(
        F.lit(0), F.lit(7))).alias("sentence_index"))
    crossed = s.table("lineitem").filter("l_returnflag = 'R'").select(
        "l_orderkey", F.col("l_linenumber").alias("first_sentence"), F.col("l_linenumber").alias("last_sentence"))
    return W.expand_neighbors(sents, crossed, ["l_orderkey"])


@query("w12_top_neighbors", """select case_id, id, neighbor, cast(r as integer) rank from (select *, row_number() over (partition by case_id, id
order by q, neighbor) r from (select case_id, id, neighbor, min(seq) q from ends group by 1, 2, 3)) where r <= 4""")
def _(s):
    return W.top_neighbors(A.neighbor_pairs(s.edges(), "seq")).drop("seq")


@query("w13_pack")
def _(s):
    """Batches of sentence-sized passages per document under a 1000 character budget."""
    sized = s.texts().select("doc_id", F.transform(sentences(F.col("text")), lambda x: x["end"] - x["start"] + 80).alias("c"))
    packed = sized.withColumn("b", pack(F.col("c"), 1000)).select("doc_id", F.explode(F.arrays_zip("c", "b")).alias("z"))
    return packed.groupBy("doc_id", F.col("z.b").alias("batch")).agg(F.sum("z.c").alias("cost"), F.count("*").alias("passages"))


PACK_SQL = """with recursive l as (select l_orderkey k, cast(l_quantity as bigint) c, row_number() over (partition by l_orderkey
  order by cast(l_quantity as bigint)) i from lineitem),
p as (select k, i, c, cast(0 as bigint) batch, c used from l where i = 1 union all
  select l.k, l.i, l.c, case when used + l.c > 60 then batch + 1 else batch end, case when used + l.c > 60 then l.c else used + l.c end
  from p join l on l.k = p.k and l.i = p.i + 1)
select k l_orderkey, cast(batch as integer) batch, cast(sum(c) as bigint) cost, count(*) passages from p group by 1, 2"""


@query("w13_pack_lines")
def _(s):
    """Order lines play passages, their quantities the sizes: greedy batches of at most 60."""
    sized = s.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("c"))
    packed = sized.withColumn("b", pack(F.col("c"), 60)).select("l_orderkey", F.explode(F.arrays_zip("c", "b")).alias("z"))
    return packed.groupBy("l_orderkey", F.col("z.b").alias("batch")).agg(F.sum("z.c").alias("cost"), F.count("*").alias("passages"))


ORACLES["w13_pack_lines"] = PACK_SQL  # stands alone: it recurses over the lines

# --- rankings ----------------------------------------------------------------------


@query("t2_rank_connections", "select case_id, id, connections from conn")
def _(s):
    return T.rank_connections(A.connections(s.entities(), s.edges())).select("case_id", "id", "connections")


@query("t4_top_k", """select case_id, id, connections from (select *, row_number() over (partition by case_id
order by connections desc, id) r from conn) where r <= 8""")
def _(s):
    return T.top_k(A.connections(s.entities(), s.edges()), ["case_id"],
                   [F.desc("connections"), F.col("id")], 8).select("case_id", "id", "connections")


@query("t5_timeline", """select report_id, uploaded_at "date" from docs""")
def _(s):
    return T.timeline(s.documents().withColumnRenamed("uploaded_at", "date")).select("report_id", "date")


@query("t6_capped", """select id, (select count(*) >= 1000 from ev) truncated from (select id from ev order by id, seq limit 1000)""")
def _(s):
    """The paged reader: the cap is its feature, and the flag tells that more exists."""
    page, flag = T.capped(s.edges(), 1000, [F.col("id"), F.col("seq")])
    return page.select("id").crossJoin(flag)  # flag is one row


@query("t7_list_cases", """select cast(n_nationkey as varchar) id, case when n_nationkey % 2 = 0 then
cast(count(c_custkey) as varchar) end created_at from nation left join customer on c_nationkey = n_nationkey group by n_nationkey""")
def _(s):
    return T.list_cases(s.sql("""select cast(n_nationkey as string) id, case when n_nationkey % 2 = 0 then
        cast(count(c_custkey) as string) end created_at from {nation} left join {customer} on c_nationkey = n_nationkey
        group by n_nationkey"""))


@query("t8_leads_by_confidence", "select case_id, entity_id, confidence_score from hub")
def _(s):
    nodes, edges = s.entities(), s.edges()
    return T.leads_by_confidence(leads_hub(A.connections(nodes, edges), edges)).select(
        "case_id", "entity_id", "confidence_score")


@query("t9_suggest", """select label, id from (select distinct label, id from ent) where contains(lower(label), 'er#0000000')
order by label, id limit 8""")
def _(s):
    return T.suggest(s.entities().select("label", "id").distinct(), "ER#0000000", 8)


@query("t10_types", "select distinct type from ent")
def _(s):
    return T.types(s.entities())
