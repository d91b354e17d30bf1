"""Queries for filters (f*), joins (j*) and set operations (u*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import identifiers as I
from ...functions.text import span_text
from ...operators import extraction as X
from ...operators import filters as flt
from ...operators import joins as J
from ...operators import sets as U
from ...operators.aggregates import collapse_aliases
from ...operators.relations import clause_columns, compile_rules, match_rules, mention_pairs
from .registry import query

# --- filters ---------------------------------------------------------------------


@query("f1_active_in_case", """select case_id, id, seq % 3 flag from ev where seq % 3 <> 0""")
def _(s):
    flagged = s.edges().withColumn("flag", F.col("seq") % 3).withColumn(
        "active", F.when(F.col("flag") == 0, False).when(F.col("flag") == 1, True))
    return flt.active_in_case(flagged).select("case_id", "id", "flag")


@query("f2_min_confidence", "select case_id, id, confidence from ev where coalesce(nullif(confidence, 0), 1.0) >= 0.05")
def _(s):
    return flt.min_confidence(s.edges(), 0.05).select("case_id", "id", "confidence")


@query("f3_layer", "select case_id, id, method from ev where method = 'returned-rows' or type = 'returned-rows'")
def _(s):
    return flt.layer(s.edges(), "returned-rows").select("case_id", "id", "method")


@query("f4_time_range", """select case_id, id, case when seq % 5 = 0 then null else timestamp end as "timestamp" from ev
where seq % 5 = 0 or (timestamp >= '1996-03-01' and timestamp <= '1998-06-30')""")
def _(s):
    some_missing = s.edges().withColumn("timestamp", F.when(F.col("seq") % 5 != 0, F.col("timestamp")))
    return flt.time_range(some_missing, "1996-03-01", "1998-06-30").select("case_id", "id", "timestamp")


@query("f5_valid_entity", """select name, kind, case
  when kind = 'Person' then length(name) >= 2 and name not in ('the', 'witness') and not regexp_matches(name, '[0-9]')
  when kind = 'Location' then length(name) >= 2 and name not in ('the', 'witness')
    and not regexp_full_match(name, 'v?[0-9]+|[A-Za-z][0-9]{1,3}') and not starts_with(lower(name), 'section ')
  else length(regexp_replace(name, '[^0-9]', '', 'g')) >= 4 or (length(name) >= 4 and regexp_matches(name, '[0-9]')) end ok
from (select case c_custkey % 7 when 0 then c_name when 1 then 'the' when 2 then 'witness' when 3 then 'v' || c_custkey
   when 4 then 'Section ' || c_custkey when 5 then c_mktsegment else cast(c_custkey as varchar) end name,
   case c_custkey % 3 when 0 then 'Person' when 1 then 'Location' else 'Account' end kind from customer) t""")
def _(s):
    named = s.sql("""select case c_custkey % 7 when 0 then c_name when 1 then 'the' when 2 then 'witness'
        when 3 then 'v' || c_custkey when 4 then 'Section ' || c_custkey when 5 then c_mktsegment
        else cast(c_custkey as string) end name,
        case c_custkey % 3 when 0 then 'Person' when 1 then 'Location' else 'Account' end kind from {customer}""")
    return named.withColumn("ok", I.valid_entity(F.col("name"), F.col("kind")))


@query("f6_visible_graph", """, vis as (select * from ent where contains(lower(label), '7') and type = 'Person'
  and exists (select 1 from ends b where b.case_id = ent.case_id and b.id = ent.id))
select 'nodes' part, count(*) n from vis union all
select 'edges', count(*) from ev where exists (select 1 from vis v where v.case_id = ev.case_id and v.id = ev.source)
  and exists (select 1 from vis v where v.case_id = ev.case_id and v.id = ev.target) union all
select 'hidden', (select count(*) from ent) - (select count(*) from vis)""")
def _(s):
    nodes, edges, hidden = flt.visible_graph(s.entities(), s.edges(), True, "7", "Person")
    return (nodes.agg(F.lit("nodes").alias("part"), F.count("*").alias("n"))
            .union(edges.agg(F.lit("edges"), F.count("*"))).union(hidden.select(F.lit("hidden"), "hidden_count")))


@query("f7_visible_graph_any", """, vis as (select * from ent where contains(lower(label), '11') or contains(lower(type), '11'))
select case_id, id, 'node' part from vis union all
select case_id, id, 'edge' from ev where exists (select 1 from vis v where v.case_id = ev.case_id and v.id = ev.source)
  and exists (select 1 from vis v where v.case_id = ev.case_id and v.id = ev.target)""")
def _(s):
    nodes, edges, _h = flt.visible_graph_any(s.entities(), s.edges(), "11")
    return nodes.select("case_id", "id", F.lit("node").alias("part")).union(
        edges.select("case_id", "id", F.lit("edge")))


@query("f8_search_reference", """select case_id, id, label from ent
where (contains(lower(label), 'r:12') or contains(lower(id), 'r:12')) and type = 'Organization'""")
def _(s):
    nodes, _e, _h = flt.search_reference(s.entities(), s.edges(), "R:12", "Organization")
    return nodes.select("case_id", "id", "label")


@query("f9_term_search", """select case_id, id from ent where contains(lower(label), 'supplier') or contains(lower(type), 'supplier')
or contains(lower(label), '00042') or contains(lower(type), '00042')""")
def _(s):
    return flt.term_search(s.entities(), "a supplier or 00042").select("case_id", "id")


@query("f10_admit_edges", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
where l_linenumber <> 1 and l_partkey <> l_suppkey""")
def _(s):
    raw = s.sql("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_suppkey as string) target,
        case when l_linenumber = 1 then '' else cast(l_partkey as string) end source from {lineitem}""")
    return flt.admit_edges(raw).drop("source", "target")


@query("f11_search_cases", """select n_name title, cast(n_nationkey as varchar) id, count(c_custkey) customers
from nation left join customer on c_nationkey = n_nationkey
where contains(lower(concat_ws(' ', n_name, cast(n_nationkey as varchar))), '_1') group by 1, 2""")
def _(s):
    cases = s.sql("""select n_name title, cast(n_nationkey as string) id, count(c_custkey) customers
        from {nation} left join {customer} on c_nationkey = n_nationkey group by 1, 2""")
    return flt.search_cases(cases, "_1")


@query("f13_unhandled", """select cast(o_orderkey as varchar) doc_id, cast(o_orderkey % 4 as bigint) unit_index from orders
where o_orderpriority <> '5-LOW'""")
def _(s):
    units = s.sql("select cast(o_orderkey as string) doc_id, o_orderkey % 4 unit_index, o_orderpriority p from {orders}")
    return flt.unhandled(units, units.filter("p = '5-LOW'").drop("p")).drop("p")


@query("f14_first_truthy", """select c_custkey, coalesce(nullif(case when c_custkey % 3 = 0 then '' else c_name end, ''),
nullif(case when c_custkey % 2 = 0 then null else c_mktsegment end, ''), cast(c_custkey as varchar)) picked from customer""")
def _(s):
    t = s.sql("""select c_custkey, case when c_custkey % 3 = 0 then '' else c_name end a,
        case when c_custkey % 2 = 0 then null else c_mktsegment end b, cast(c_custkey as string) c from {customer}""")
    return t.select("c_custkey", I.first_truthy(F.col("a"), F.col("b"), F.col("c")).alias("picked"))


@query("f15_pending", """select o_orderkey from orders where o_orderkey % 5 <> 0 and o_orderstatus in ('O', 'P')""")
def _(s):
    files = s.sql("""select o_orderkey, case when o_orderkey % 5 = 0 then 'This file is empty.' else '' end validation_error,
        case o_orderstatus when 'O' then 'queued' when 'P' then 'failed' else 'complete' end status from {orders}""")
    return flt.pending(files).select("o_orderkey")


@query("f16_valid_call", """select o_orderkey, o_orderkey % 4 = 0 ok from orders""")
def _(s):
    rows = s.sql("""select o_orderkey, concat('+91 (98765) ', lpad(cast(o_custkey as string), 5, '0')) a,
        case o_orderkey % 4 when 0 then lpad(cast(o_orderkey as string), 10, '7') when 1 then 'missing'
          when 2 then '12-34' else '1.2345678E+9' end b from {orders}""")
    good, bad = flt.split_calls(rows, I.valid_call_number(F.col("a")) & I.valid_call_number(F.col("b")))
    return good.select("o_orderkey", F.lit(True).alias("ok")).union(bad.select("o_orderkey", F.lit(False)))


@query("f17_valid_case_id", """select doc_id, doc_id % 3 = 0 ok from documents""")
def _(s):
    return s.sql("""select doc_id, case doc_id % 3 when 0 then source when 1 then source || '/x' else repeat('a', 101) end c
        from {documents}""").select("doc_id", I.valid_case_id(F.col("c")).alias("ok"))


# --- joins -----------------------------------------------------------------------


@query("j1_drop_dangling", """select case_id, id, source, target from ev
join supplier on s_key = s_suppkey where s_acctbal >= 0""")
def _(s):
    good = s.table("supplier").filter("s_acctbal >= 0").select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("id"))
    nodes = s.entities().filter("type = 'Person'").select("id").union(good)
    return J.drop_dangling(s.edges(), nodes).select("case_id", "id", "source", "target")


SEGMENT_ALIAS = """, m as (select case_id, c_mktsegment seg, min(c_custkey) k from
  (select cast(c_nationkey as bigint) case_id, c_custkey, c_mktsegment from customer) group by 1, 2),
al as (select cast(c_nationkey as bigint) case_id, concat('customer:', cast(c_custkey as varchar)) id,
  concat('customer:', cast(k as varchar)) canonical_id from customer join m on c_nationkey = case_id and seg = c_mktsegment)
"""


def segment_groups(s):
    people = s.entities().filter("type = 'Person'").drop("normalized_value", "label")
    seg = s.table("customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("id"),
                                     F.col("c_mktsegment").alias("label"))
    return collapse_aliases(people.join(seg, "id").withColumn("normalized_value", F.lit("")))


@query("j2_rewrite_endpoints", SEGMENT_ALIAS + """select ev.case_id, ev.id, canonical_id source, source original_source,
target, target original_target from ev join al on al.case_id = ev.case_id and al.id = source""")
def _(s):
    _g, alias, _r = segment_groups(s)
    return J.rewrite_endpoints(s.edges(), alias).select("case_id", "id", "source", "original_source", "target",
                                                        "original_target")


REPORTS = """select report_id, case_id, 'complete' status, count(*) relationship_count, count(distinct s_key) + 1 entity_count,
  count(*) * 2 mention_count from ev group by report_id, case_id"""


def reports(s):
    return s.edges().groupBy("case_id", "report_id").agg(
        F.count("*").alias("relationship_count"), (F.count_distinct("s_key") + 1).alias("entity_count"),
        (F.count("*") * 2).alias("mention_count")).withColumn("status", F.lit("complete"))


@query("j3_documents_with_counts", f""", rep as ({REPORTS}) select docs.case_id, document_id, docs.report_id,
relationship_count, entity_count, mention_count, status report_status from docs left join rep using (case_id, report_id)""")
def _(s):
    return J.documents_with_counts(s.documents(), reports(s)).select(
        "case_id", "document_id", "report_id", "relationship_count", "entity_count", "mention_count", "report_status")


@query("j4_document_detail", """, items as (
  select case_id, report_id, 'entity' section, id item_id from sight union all
  select case_id, report_id, 'mention', concat_ws(':', source, '0', '0', '5') from ev union all
  select case_id, report_id, 'relationship', id from ev)
select docs.case_id, document_id, section, item_id from docs left join items using (case_id, report_id)""")
def _(s):
    edges = s.edges()
    mentions = edges.select("case_id", "report_id", F.col("source").alias("entity_id"), F.lit(0).alias("unit_index"),
                            F.lit(0).alias("start"), F.lit(5).alias("end"), F.col("source").alias("label"))
    seen = s.sightings().withColumn("label", F.col("id"))
    return J.document_detail(s.documents(), reports(s), seen, mentions, edges).select(
        "case_id", "document_id", "section", "item_id")


@query("j5_entities_of_report", "select case_id, id, report_id from sight where report_id = 'O42'")
def _(s):
    return J.entities_of_report(s.sightings(), "O42")


NARR_FORMS = """(select cast(o_orderkey as varchar) doc_id, o_orderkey % 7 form from orders)"""


def narrative_pairs(s, rules):
    units = s.narratives()
    mentions = X.identifier_mentions(units)
    local = J.assign_sentences(mentions.drop("case_id"), X.sentence_rows(units))
    grouped = local.groupBy("case_id", "doc_id", "unit_index", "sentence_start", "sentence_end").agg(
        F.first("sentence").alias("sentence"),
        F.array_sort(F.collect_set(F.struct("start", "end", "entity_id", "type"))).alias("local"))
    return mention_pairs(grouped, rules)


@query("j6_mention_pairs", """select cast(o_orderkey as varchar) doc_id, cast(case when o_orderkey % 7 in (3, 6) then 0 else 1 end as bigint) phone,
cast(1 as bigint) account from orders""")
def _(s):
    pairs = narrative_pairs(s, compile_rules(_rules(s)))
    return pairs.groupBy("doc_id").agg(F.count_if(F.col("source.type") == "Phone").alias("phone"),
                                       F.count_if(F.col("source.type") == "Account").alias("account"))


@query("j7_match_rules", f"""select doc_id, 'transfers' rule_id from {NARR_FORMS} union all
select doc_id, 'calls' from {NARR_FORMS} where form in (0, 1, 2, 5)""")
def _(s):
    rules = compile_rules(_rules(s))
    return match_rules(clause_columns(narrative_pairs(s, rules)), rules).select("doc_id", "rule.rule_id")


def _rules(s):
    from ...sources.rules import load_rules
    return load_rules(s.spark)


@query("j8_prefer_identifiers", """select cast(o_orderkey as varchar) doc_id, 'identifier-rule' method, cast(2 as bigint) n
from orders union all select cast(o_orderkey as varchar), 'gazetteer', 1 from orders where o_orderkey % 3 <> 0""")
def _(s):
    phones = X.identifier_mentions(s.narratives()).filter("type = 'Phone'").select(
        "case_id", "doc_id", "unit_index", "entity_id", "type", "method", "start", "end")
    first = phones.groupBy("case_id", "doc_id", "unit_index").agg(F.min("start").alias("s"))
    # a guess over the first phone in every third document, before it elsewhere
    guess = first.select("case_id", "doc_id", "unit_index", F.lit("guess").alias("entity_id"),
                         F.lit("Organization").alias("type"), F.lit("gazetteer").alias("method"),
                         F.when(F.col("doc_id").cast("bigint") % 3 == 0, F.col("s") - 2).otherwise(F.lit(0)).alias("start"),
                         F.when(F.col("doc_id").cast("bigint") % 3 == 0, F.col("s") + 3).otherwise(F.lit(2)).alias("end"))
    return J.prefer_identifiers(phones.unionByName(guess)).groupBy("doc_id", "method").agg(F.count("*").alias("n"))


@query("j9_assign_sentences", """select cast(o_orderkey as varchar) doc_id, cast(2 as bigint) first_sentence,
cast(2 as bigint) last_sentence from orders""")
def _(s):
    units = s.narratives()
    located = J.assign_sentences(X.identifier_mentions(units).drop("case_id"), X.sentence_rows(units))
    # 'Phone no. …' and 'Dr. A. Verma' do not end a sentence: calls are sentence 0, transfers sentence 2
    return located.groupBy("doc_id").agg(F.count_if(F.col("sentence_index") == 0).alias("first_sentence"),
                                         F.count_if(F.col("sentence_index") == 2).alias("last_sentence"))


@query("j10_locate_quotes", """, f as (select source, doc_id, trim(regexp_replace(text,
  '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) flat from documents)
select cast(q.doc_id as varchar) doc_id, cast(sum((length(p.flat) - length(replace(p.flat, q.flat, ''))) // length(q.flat)) as bigint) hits
from f q join f p on q.doc_id is not distinct from p.doc_id and q.source is not distinct from p.source
where q.flat <> '' and contains(p.flat, q.flat) group by 1""")
def _(s):
    """How often the whole texts of a document's rows occur in its rows: once, unless an id is that of several rows or a text is blank."""
    from ...operators.proposals import locate_quotes
    from ...functions.identifiers import squeeze
    units = s.texts()
    passages = units.select("case_id", "doc_id", "unit_index", F.lit("0").alias("batch"),
                            F.lit(0).alias("passage_start"), F.col("text").alias("passage"))
    whole = units.select("case_id", "doc_id", F.lit("0").alias("batch"), F.col("doc_id").alias("proposal_id"),
                         squeeze(F.col("text")).alias("quote"))
    return locate_quotes(whole, passages).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("j12_new_documents", """, k as (select distinct sha256(text) h, source from documents where doc_id % 4 = 0)
select d.doc_id, d.source case_id from documents d where not exists (
  select 1 from k where k.h = sha256(d.text) and k.source = d.source)""")
def _(s):
    docs = s.table("documents").select("doc_id", F.col("source").alias("case_id"), F.sha2("text", 256).alias("sha256"))
    return J.new_documents(docs, docs.filter("doc_id % 4 = 0")).select("doc_id", "case_id")


@query("j13_discover_cases", """select cast(n_nationkey as varchar) id, n_name title, 'stored' classification from nation
where n_nationkey % 2 = 0 union all
select id, id, 'Restricted' from (select distinct cast(case_id as varchar) id from ev) where cast(id as int) % 2 = 1""")
def _(s):
    cases = s.sql("""select cast(n_nationkey as string) id, n_name title, 'stored' classification from {nation}
        where n_nationkey % 2 = 0""")
    tables = [t.select(F.col("case_id").cast("string").alias("case_id")) for t in (s.edges(), s.documents())]
    return J.discover_cases(cases, *tables).select("id", "title", "classification")


@query("j15_sources_for_entity", """select case_id, document_id from docs where exists (
  select 1 from ends where ends.report_id = docs.report_id and ends.case_id = docs.case_id and ends.id = 'supplier:3')""")
def _(s):
    return J.sources_for_entity(s.documents(), s.edges(), s.sightings(), "supplier:3").select("case_id", "document_id")


@query("j16_stale_mentions", "select cast(o_orderkey as varchar) doc_id from orders where o_orderkey % 10 = 0")
def _(s):
    units = s.narratives()
    mentions = X.identifier_mentions(units)
    shifted = mentions.withColumn("start", F.col("start") + F.when(F.col("doc_id").cast("bigint") % 10 == 0, 1).otherwise(0))
    return J.stale_mentions(shifted, units).select("doc_id").distinct()


# --- set operations ----------------------------------------------------------------


@query("u1_union_edges", """select id, 'line' producer, amount from ev union all
select concat('O', cast(o_orderkey as varchar)), 'order', null from orders""")
def _(s):
    lines = s.edges().select("id", F.lit("line").alias("producer"), "amount")
    orders = s.sql("select concat('O', cast(o_orderkey as string)) id, 'order' producer from {orders}")
    return U.union_edges(lines, orders)


@query("u2_union_handled", """select distinct cast(l_orderkey as varchar) doc_id, cast(l_linenumber as bigint) unit_index
from lineitem where l_returnflag in ('R', 'A')""")
def _(s):
    rows = s.sql("select cast(l_orderkey as string) doc_id, cast(l_linenumber as bigint) unit_index, l_returnflag f from {lineitem}")
    return U.union_handled(rows.filter("f = 'R'"), rows.filter("f = 'A'"))


@query("u3_retired_ids", """select distinct case_id, source id from ev where source not in (
select source from ev where timestamp >= '1998-01-01')""")
def _(s):
    ids = s.edges().select("case_id", F.col("source").alias("id"), "timestamp")
    return U.retired_ids(ids, ids.filter("timestamp >= '1998-01-01'"), ["case_id", "id"])


@query("u4_all_case_ids", """select distinct case_id from (select case_id from ev union all select case_id from docs
union all select case_id from ent)""")
def _(s):
    return U.distinct_ids("case_id", s.edges(), s.documents(), s.entities())


@query("u5_neighbor_intersection", """, l as (select distinct l_partkey p, l_suppkey k from lineitem)
select a.p part_a, a.k supplier from l a join l b on a.k = b.k and b.p = a.p + 1""")
def _(s):
    """Suppliers shared by consecutive parts: set intersection as an equi-join."""
    pairs = s.table("lineitem").select(F.col("l_partkey").alias("part_a"), F.col("l_suppkey").alias("supplier"))
    following = pairs.select((F.col("part_a") - 1).alias("part_a"), "supplier")
    return U.neighbor_intersection(pairs, following, ["part_a", "supplier"])


@query("u6_soft_delete", """select case_id, id, source, exists (select 1 from ev n where n.source = ev.source
and n.timestamp >= '1998-01-01') active from ev where timestamp < '1998-01-01'""")
def _(s):
    edges = s.edges()
    return U.soft_delete_missing(edges.filter("timestamp < '1998-01-01'"), edges.filter("timestamp >= '1998-01-01'"),
                                 ["source"]).select("case_id", "id", "source", "active")
