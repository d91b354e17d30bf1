"""Queries for sources (s*), header windows (w2–w4, w11), extraction jobs (e*) and their settings (d*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions import identifiers as I
from ...functions.text import find_spans, rule_regex, sentences
from ...operators import extraction as X
from ...operators import filters as flt
from ...operators import mappers as M
from ...operators.forms import extract_forms
from ...operators.iteration import cut, scratch_path
from ...operators.passages import plan_metrics, plan_passages
from ...operators.proposals import context_span, endpoints_inside, locate_quotes, validate_proposals
from ...operators.relations import compile_rules, extract_relations
from ...sources import originals as O
from ...sources import store, units as U
from ...sources.delimited import read_delimited
from ...sources.rules import load_rules
from .registry import query

# --- sources ------------------------------------------------------------------------


def files(s):
    """The documents table as uploaded files."""
    t = s.table("documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".csv", ".exe", ".PDF", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    raw = t.select("source", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ext).alias("path"),
                   F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("timestamp").alias("modificationTime"), "text")
    return O.describe(raw, F.col("source"))


@query("s1_read_originals", """select source case_id, concat('DOC-', sha256(concat(source, ':', sha256(text)))) document_id,
concat(doc_id, case doc_id % 5 when 0 then '.txt' when 1 then '.csv' when 2 then '.exe' when 3 then '.PDF' else '' end) filename,
cast(strlen(text) as bigint) size_bytes, sha256(text) sha256 from documents""")
def _(s):
    return files(s).select("case_id", "document_id", "filename", "size_bytes", "sha256")


@query("s2_admit", """select doc_id, case when doc_id % 5 in (2, 4) then 'unsupported format' when strlen(text) > 20000 then 'file too large'
when strlen(text) = 0 then 'empty file' when length(trim(text)) < 200 then 'insufficient usable text' else 'accepted' end outcome from documents""")
def _(s):
    judged = files(s).withColumn("text", F.decode("content", "UTF-8"))
    good, bad = O.admit(judged, max_bytes=20000, min_chars=200)
    key = F.regexp_extract("filename", r"^\d+", 0).cast("bigint").alias("doc_id")
    return good.select(key, F.lit("accepted").alias("outcome")).union(bad.select(key, "reason"))


@query("s3_text_units", "select case_id, doc_id, cast(0 as bigint) unit_index, length(text) chars from texts")
def _(s):
    raw = s.table("documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return U.to_units(raw, text="text").select("case_id", "doc_id", "unit_index", F.length("text").cast("bigint").alias("chars"))


@query("s4_row_units", """select concat_ws(' | ', cast(c_custkey as varchar), concat('a, "quoted" ', c_name), concat(c_mktsegment, chr(10), 'two lines')) cells
from customer""")
def _(s):
    path = scratch_path(s.spark, "rows")
    s.table("customer").select("c_custkey", F.concat(F.lit('a, "quoted" '), "c_name"), F.concat(
        "c_mktsegment", F.lit("\ntwo lines"))).write.option("escape", '"').csv(path)
    return U.read_row_units(s.spark, path, "c", max_columns=8).select(F.array_join("cells", " | ").alias("cells"))


@query("s4_delimited_documents", """select doc_id, md5(coalesce(text, '')) h, cast(4 as bigint) width, false malformed from documents""")
def _(s):
    """Whole texts, line breaks and quotes in them, written as ';' tables and read back; the separator is found in the files."""
    path = scratch_path(s.spark, "delimited")
    docs = s.table("documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), "lang")
    docs.write.options(sep=";", quoteAll=True, escape='"').csv(path)
    rows = read_delimited(s.spark, path, "c")
    return rows.select(F.col("cells")[0].cast("bigint").alias("doc_id"), F.md5(F.col("cells")[2]).alias("h"),
                       F.size("cells").cast("bigint").alias("width"), "malformed")


@query("s5_to_units", """select doc_id, cast(i - 1 as bigint) unit_index, length(p) chars from (
select doc_id, unnest(string_split(text, chr(10))) p, generate_subscripts(string_split(text, chr(10)), 1) i from texts)""")
def _(s):
    parts = s.texts().select("case_id", "doc_id", F.split("text", "\n").alias("parts"))
    return U.to_units(parts, pieces="parts", kind="paragraph").select(
        "doc_id", "unit_index", F.length("text").cast("bigint").alias("chars"))


@query("s6_flatten_text", "select doc_id, md5(text) h from texts")
def _(s):
    parts = s.texts().select("case_id", "doc_id", F.split("text", "\n").alias("parts"))
    units = U.to_units(parts, pieces="parts").withColumn("cells", F.lit(None).cast("array<string>"))
    return U.flatten_text(units).select("doc_id", F.md5("text").alias("h"))


CALL_FORMS = "(0, 1, 2, 5)"


@query("s7_load_rules", f"""select rule_id, count(*) edges from (select 'transfers' rule_id from orders union all
select 'calls' from orders where o_orderkey % 7 in {CALL_FORMS}) group by 1""")
def _(s):
    """Rules that fired over all narratives, with the number of edges each produced."""
    rules = load_rules(s.spark)
    units = s.narratives()
    edges = extract_relations(units, X.identifier_mentions(units), compile_rules(rules))
    return rules.select(F.col("id").alias("rule_id")).join(edges, "rule_id").groupBy("rule_id").agg(F.count("*").alias("edges"))


def reference_tables(s):
    """Reference collections from the customer, supplier, part, order and nation tables."""
    return {
        "ref_kyc": s.sql("select concat('P', cast(c_custkey as string)) person_id, case when c_custkey % 5 = 0 then '' else c_name end name, c_mktsegment address from {customer}"),
        "ref_accounts": s.sql("select concat('A', cast(o_orderkey as string)) account_id, concat('P', cast(o_custkey as string)) owner_id, o_orderpriority bank, case when o_orderkey % 3 = 0 then '' else lpad(cast(o_orderkey as string), 10, '0') end account_number from {orders}"),
        "ref_companies": s.sql("select concat('C', cast(s_suppkey as string)) company_id, s_name company_name from {supplier}"),
        "ref_directors": s.sql("select concat('P', cast(s_suppkey * 3 as string)) person_id, concat('C', cast(s_suppkey as string)) company_id, case when s_suppkey % 2 = 0 then 'CHAIR' else '' end role from {supplier}"),
        "ref_vehicles": s.sql("select concat('V', cast(p_partkey as string)) vehicle_id, case when p_partkey % 4 = 0 then cast(null as string) else p_name end registration_number, case when p_partkey % 6 = 0 then '' else concat('P', cast(p_partkey % 100 as string)) end owner_id, p_brand make from {part}"),
        "ref_locations": s.sql("select concat('L', cast(n_nationkey as string)) location_id, n_name name from {nation}"),
    }


REF_NODES = """, node as (
  select concat('P', c_custkey) id, coalesce(nullif(case when c_custkey % 5 = 0 then '' else c_name end, ''), concat('P', c_custkey)) label, 'Person' type from customer union all
  select concat('A', o_orderkey), case when o_orderkey % 3 = 0 then concat('A', o_orderkey) else concat(o_orderpriority, ' ···', right(lpad(cast(o_orderkey as varchar), 10, '0'), 4)) end, 'Account' from orders union all
  select concat('C', s_suppkey), s_name, 'Organization' from supplier union all
  select concat('V', p_partkey), case when p_partkey % 4 = 0 then concat('V', p_partkey) else p_name end, 'Vehicle' from part union all
  select concat('L', n_nationkey), n_name, 'Location' from nation),
edge as (select concat('P', o_custkey) source, concat('A', o_orderkey) target, 'OWNS_ACCOUNT' relation from orders union all
  select concat('P', s_suppkey * 3), concat('C', s_suppkey), case when s_suppkey % 2 = 0 then 'CHAIR' else 'DIRECTOR_OF' end from supplier union all
  select concat('P', p_partkey % 100), concat('V', p_partkey), 'OWNS_VEHICLE' from part where p_partkey % 6 <> 0)
"""


@query("s8_scan_collection", "select concat('C', s_suppkey) company_id, s_name company_name from supplier")
def _(s):
    root = scratch_path(s.spark, "collections")
    reference_tables(s)["ref_companies"].write.parquet(store.table_path(root, "ref_companies"))
    return store.scan_collection(s.spark, root, "ref_companies", order="company_id")


# --- header windows ---------------------------------------------------------------


def log_units(s, header, cells, doc="o_orderpriority", extra=""):
    """Rows of the order table below one header row per document."""
    rows = s.sql(f"select cast('K' as string) case_id, {doc} doc_id, o_orderkey unit_index, 'row' kind, array({cells}) cells from {{orders}} {extra}")
    heads = rows.select("case_id", "doc_id").distinct().select(
        "case_id", "doc_id", F.lit(-1).cast("bigint").alias("unit_index"), F.lit("row").alias("kind"),
        F.array(*[F.lit(h) for h in header]).alias("cells"))
    return rows.unionByName(heads)


PHONE_A = "concat('9', lpad(cast(o_custkey as string), 9, '0'))"
PHONE_B = "case when o_orderkey % 10 = 0 then 'missing' else concat('8', lpad(cast(o_orderkey as string), 9, '0')) end"


def call_units(s):
    return log_units(s, ["CALL_ID", "TIMESTAMP", "CALLER_ID", "RECEIVER_ID", "DURATION_SEC", "CALL_TYPE"],
                     f"cast(o_orderkey as string), substr(cast(o_orderdate as string), 1, 10), concat(' ', {PHONE_A}), {PHONE_B}, "
                     "case when o_orderkey % 4 = 0 then 'bad' else cast(o_orderkey % 600 as string) end, 'OUT'")


@query("w2_call_headers", """select o_orderkey unit_index, case when o_orderkey < 5000 then cast(3 as integer)
when o_orderkey between 5001 and 7999 then cast(1 as integer) end as caller_column from orders where o_orderkey not in (5000, 8000)""")
def _(s):
    """One log interrupted: a new header at 5000, a narrative unit at 8000."""
    rows = s.sql("""select 'K' case_id, 'log' doc_id, o_orderkey unit_index, case when o_orderkey = 8000 then 'text' else 'row' end kind,
        case when o_orderkey = 5000 then array('From Number', 'To Number', 'Duration') else array('1', '2', '3') end cells from {orders}""")
    head = s.spark.createDataFrame([("K", "log", -1, "row", ["x", "y", "Caller", "Callee"])], rows.schema)
    found = M.call_headers(rows.union(head)).filter("header is null and unit_index >= 0")
    return found.select("unit_index", F.col("active.pos")[0].alias("caller_column"))


@query("w3_bank_headers", """select doc_id, count(*) "rows", cast(count(*) filter (p) as bigint) mapped from (
  select o_orderpriority doc_id, o_orderpriority <> '5-LOW' p from orders) group by 1""")
def _(s):
    units = log_units(s, ["From Account", "To Account", "Amount"], "'1', '2', '3'")
    broken = units.withColumn("cells", F.when((F.col("doc_id") == "5-LOW") & (F.col("unit_index") < 0), F.array(
        F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.col("cells")))
    rows = M.bank_headers(broken).filter("unit_index >= 0")
    return rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("active").isNotNull()).alias("mapped"))


@query("w4_registry_headers", """select o_orderkey unit_index, case when o_orderkey < 4000 then 'vehicles' else 'domains' end as schema
from orders where o_orderkey <> 4000""")
def _(s):
    rows = s.sql("""select 'K' case_id, 'reg' doc_id, o_orderkey unit_index, 'row' kind, case when o_orderkey = 4000 then
        array('domain_id', 'domain') else array('1', '2', '3') end cells from {orders}""")
    head = s.spark.createDataFrame([("K", "reg", -1, "row", ["vehicle_id", "registration_number", "owner_id"])], rows.schema)
    found = M.registry_headers(rows.union(head)).filter("header is null and unit_index >= 0")
    return found.select("unit_index", F.col("active.schema").alias("schema"))


@query("w11_context_span", """select doc_id, case when o % 2 = 0 then concat('Police denied this claim. Order ', doc_id, ' was called.') else
concat('Order ', doc_id, ' was called. The call was short.') end context from (select cast(o_orderkey as varchar) doc_id, o_orderkey o from orders)""")
def _(s):
    t = s.sql("""select cast(o_orderkey as string) doc_id, concat(case when o_orderkey % 2 = 0 then 'Police denied this claim. ' else 'Rain fell. ' end,
        'Order ', cast(o_orderkey as string), ' was called.', case when o_orderkey % 2 = 0 then ' Rain fell.' else ' The call was short.' end) text from {orders}""")
    at = t.withColumns({"b": sentences(F.col("text")), "start": F.instr("text", "Order") - 1})
    return at.select("doc_id", context_span(F.col("b"), F.col("text"), F.col("start"), F.col("start") + 8).alias("context"))


# --- extraction ------------------------------------------------------------------------


@query("e1_extract_identifiers", r"""select doc_id, 'UPI' type, lower(m) value, count(*) n from (select doc_id,
  unnest(regexp_extract_all(text, '(?i)\b[a-zA-Z0-9.\-_]{2,64}@[a-zA-Z]{2,32}\b')) m from texts) group by 1, 2, 3 union all
select doc_id, 'Phone', concat('+91', right(m, 10)), count(*) from (select doc_id,
  unnest(regexp_extract_all(text, '(?:\+91[- ]?|\b0|\b)[6-9][0-9]{9}\b')) m from texts) group by 1, 2, 3""")
def _(s):
    _e, mentions = X.extract_identifiers(s.texts())
    return mentions.groupBy("doc_id", "type", F.col("normalized_value").alias("value")).agg(F.count("*").alias("n"))


@query("e1_entities", """select 'Phone' type, count(distinct p) entities, count(*) mentions from (
  select concat('9', lpad(cast(o_custkey as varchar), 9, '0')) p, o_custkey % 5 c from orders union all
  select concat('8', lpad(cast(o_orderkey as varchar), 9, '0')), o_custkey % 5 from orders) union all
select 'Account', count(distinct (p, c)), count(*) from (select lpad(cast(o_custkey as varchar), 12, '0') p, o_custkey % 5 c from orders
  union all select lpad(cast(o_orderkey + 1 as varchar), 13, '0'), o_custkey % 5 from orders)""")
def _(s):
    entities, _m = X.extract_identifiers(s.narratives())
    return entities.groupBy("type").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions"))


def meetings(s):
    """Orders told with the names of their customer and of their first supplier, and the table of those names."""
    units = s.sql("""select 'K' case_id, cast(o_orderkey as string) doc_id, cast(0 as bigint) unit_index, 'text' kind, o_orderkey,
        concat(c_name, case when o_orderkey % 3 = 0 then ' never met ' when o_orderkey % 3 = 1 then ' met ' else ' and ' end,
        s_name, '.') text from {orders} join {customer} on o_custkey = c_custkey join (select l_orderkey, min(l_suppkey) k from {lineitem} group by 1) l
        on l_orderkey = o_orderkey join {supplier} on s_suppkey = k""")
    names = s.sql("""select concat(c_name, '') name, 'Organization' type from {customer} union all
        select s_name, 'Organization' from {supplier}""")
    return units, names


# every document's opening one and two words are names, so words such as articles start many of them
OPENINGS = """select distinct regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+', 0) name, 'Place' type from {documents} union
  select distinct regexp_extract(text, '^[A-Za-z]+', 0), 'Place' from {documents} where length(regexp_extract(text, '^[A-Za-z]+', 0)) > 5"""
RE_GAP = r"""[\s.,;:!?()\[\]"]"""
RE_WORD = r"""[^\s.,;:!?()\[\]"]+(?:\.[^\s.,;:!?()\[\]"]+)*"""


@query("e2_tag_gazetteer", f""", nm as (select distinct lower(name) k from ({OPENINGS.replace("{documents}", "documents")}) n where name <> ''),
tk as (select doc_id, i, piece, regexp_extract(piece, '{RE_WORD}') w, length(text) - sum(length(piece)) over (partition by doc_id)
    + sum(length(piece)) over (partition by doc_id order by i) - length(piece) p
  from (select cast(doc_id as varchar) doc_id, text, unnest(pc) piece, unnest(range(len(pc))) i
    from (select *, regexp_extract_all(text, '{RE_WORD}{RE_GAP}*') pc from documents) t) u),
tw as (select *, lead(piece) over o q2, lead(w) over o w2, lead(w, 2) over o w3 from tk window o as (partition by doc_id order by i)),
g as (select doc_id, p, w label from tw union all select doc_id, p, piece || w2 from tw where w2 is not null union all
  select doc_id, p, piece || q2 || w3 from tw where w3 is not null),
h as (select doc_id, p, label, max(p + length(label)) over (partition by doc_id order by p, length(label) desc rows between unbounded preceding
  and 1 preceding) before from g where trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) in (select k from nm))
select doc_id, label, cast(p as integer) "start" from h where before is null or before < p + length(label)""")
def _(s):
    _e, mentions = X.tag_gazetteer(s.texts(), s.sql(OPENINGS))
    return mentions.select("doc_id", "label", "start")


FORM_TEXT = """select cast(o_orderstatus as string) case_id, cast(o_orderkey as string) doc_id, o_orderkey, concat('FIR Number: FIR-', cast(o_orderkey as string),
  chr(10), 'Investigating Officer: Inspector ', n1, chr(10), 'Persons Mentioned:', chr(10), 'ENT-001    ', n2, '    Primary accused', chr(10),
  'ORG-001    ', n3, ' Exports  Shell company', chr(10), case when o_orderkey % 2 = 0 then concat('Repeated calls among ', n2, ' and ', n4, '.') else '' end) text, n1, n2, n3, n4
from (select *, concat('A. Verma', chr(97 + cast(o_orderkey % 26 as int))) n1, concat('Rahul Sharm', chr(97 + cast(o_custkey % 26 as int))) n2,
  concat('Bindal', chr(97 + cast(o_orderkey % 7 as int))) n3, concat('Vikram Seth', chr(97 + cast(o_orderkey % 5 as int))) n4 from {orders}) t"""


@query("e3_extract_forms", f""", f as ({FORM_TEXT.replace('{orders}', 'orders')})
select doc_id, 'INVESTIGATED' type, concat(n1, ' Investigating Officer for FIR FIR-', o_orderkey) evidence_text from f union all
select doc_id, 'ACCUSED_IN', concat(n2, ' (Primary accused) in FIR FIR-', o_orderkey) from f union all
select doc_id, 'MENTIONED_IN', concat(n3, ' Exports (Shell company) in FIR FIR-', o_orderkey) from f union all
select doc_id, 'CONTACTED', concat('Repeated communication reported between ', n2, ' and ', n4) from f where o_orderkey % 2 = 0""")
def _(s):
    return extract_forms(s.sql(FORM_TEXT))[1].select("doc_id", "type", "evidence_text")


@query("e4_extract_relations", f"""select doc_id, 'TRANSFERRED_TO' type, 'asserted' origin, concat(o % 9 + 1, lpad(cast(o % 1000 as varchar), 3, '0'), '.50') amount, 'INR' currency
from (select cast(o_orderkey as varchar) doc_id, o_orderkey o from orders) union all
select cast(o_orderkey as varchar), 'CALLED', case when o_orderkey % 7 = 2 then 'reported' else 'asserted' end, null, null from orders where o_orderkey % 7 in {CALL_FORMS}""")
def _(s):
    units = s.narratives()
    edges = extract_relations(units, X.identifier_mentions(units), compile_rules(load_rules(s.spark)))
    return edges.select("doc_id", "type", "origin", "amount", "currency")


def quotes(s):
    """One proposed call per order, quoting its narrative."""
    who = lambda c: I.entity_id(F.col(c), F.lit("Phone"))
    q = s.sql(f"""select concat('K', cast(o_custkey % 5 as string)) case_id, cast(o_orderkey as string) doc_id, {PHONE_A} a,
        concat('8', lpad(cast(o_orderkey as string), 9, '0')) b, o_orderkey from {{orders}}""")
    return q.select("case_id", "doc_id", F.lit("0").alias("batch"), F.col("doc_id").alias("proposal_id"), who("a").alias("source"),
                    who("b").alias("target"), F.when(F.col("o_orderkey") % 11 == 0, "GUILTY").otherwise("CALLED").alias("type"),
                    F.concat("a", F.lit("  called\nphone "), "b").alias("quote"), F.lit("asserted").alias("origin"))


def whole_passages(units):
    return units.select("case_id", "doc_id", "unit_index", F.lit("0").alias("batch"), F.lit(0).alias("start"),
                        F.length("text").alias("end"))


@query("e5_validate_proposals", """select cast(o_orderkey as varchar) doc_id, case when o_orderkey % 11 = 0 or o_orderkey % 7 not in (0, 1, 2) then 'rejected'
when o_orderkey % 7 = 2 then 'reported' else 'asserted' end outcome from orders""")
def _(s):
    units = s.narratives()
    edges, rejects = validate_proposals(quotes(s), units, cut(X.identifier_mentions(units)), whole_passages(units))
    return edges.select("doc_id", F.col("origin").alias("outcome")).union(rejects.select("doc_id", F.lit("rejected")))


@query("j11_endpoints_inside", """select cast(o_orderkey as varchar) doc_id, true before from orders where o_orderkey % 7 in (0, 1, 2, 4)""")
def _(s):
    units = s.narratives()
    passages = units.select("case_id", "doc_id", "unit_index", F.lit("0").alias("batch"), F.lit(0).alias("passage_start"),
                            F.col("text").alias("passage"))
    inside = endpoints_inside(locate_quotes(quotes(s), passages), cut(X.identifier_mentions(units)))
    return inside.select("doc_id", (F.col("source_end") < F.col("target_start")).alias("before"))


@query("e6_plan_passages", """select doc_id, 'entity-context' mode, cast(1 as bigint) original_requests, cast(1 as bigint) planned_requests,
cast(length(text) as bigint) original_chars, cast(length(text) as bigint) sent_chars from narr""")
def _(s):
    units = s.narratives()
    _p, metrics = plan_passages(units, cut(X.identifier_mentions(units)))
    return metrics.select("doc_id", "mode", "original_requests", "planned_requests", "original_chars", "sent_chars")


def word_mentions(s):
    """Function words of the documents table play entities."""
    hits = s.texts().select("case_id", "doc_id", "unit_index", F.explode(find_spans(
        F.col("text"), rule_regex(r"\b(?:idiot|clown|with|avec|pour)\b"))).alias("m"))
    return hits.select("case_id", "doc_id", "unit_index", F.lower("m.value").alias("entity_id"),
                       F.col("m.start").alias("start"), F.col("m.end").alias("end"))


@query("a16_plan_metrics")
def _(s):
    """Planned and original volume over whole documents, in 2000 character requests."""
    _p, metrics = plan_passages(s.texts(), word_mentions(s), 2000, 200)
    return plan_metrics(metrics)


CALLS_SQL = f"""(select o_orderkey, o_orderpriority doc_id, {PHONE_A} a, concat('8', lpad(cast(o_orderkey as string), 9, '0')) b,
  substr(cast(o_orderdate as string), 1, 10) ts from orders where o_orderkey % 10 <> 0) c"""
PHONE_ID = lambda c: f"concat('phone:', substr(sha256(concat(':Phone:+91', {c})), 1, 24))"


@query("e7_map_calls", f"""select o_orderkey unit_index, {PHONE_ID('a')} source, {PHONE_ID('b')} target, 'CALLED' type, ts as called_at,
case when o_orderkey % 4 <> 0 then cast(o_orderkey % 600 as double) end duration_seconds from {CALLS_SQL}""")
def _(s):
    return M.map_calls(call_units(s))["edges"].select(
        "unit_index", "source", "target", "type", F.col("event")["timestamp"].alias("called_at"), "duration_seconds")


@query("e7_call_mentions", f"""select o_orderkey unit_index, 'caller' "role", a label, cast(length(cast(o_orderkey as varchar)) + 17 as integer) "start" from {CALLS_SQL} union all
select o_orderkey, 'receiver', b, cast(length(cast(o_orderkey as varchar)) + 30 as integer) from {CALLS_SQL}""")
def _(s):
    return M.map_calls(call_units(s))["mentions"].select("unit_index", "role", "label", "start")


@query("e7_call_warnings", """select o_orderkey unit_index, 'caller or receiver is not a valid phone number' reason from orders where o_orderkey % 10 = 0 union all
select o_orderkey, 'duration is not a nonnegative number of seconds' from orders where o_orderkey % 10 <> 0 and o_orderkey % 4 = 0""")
def _(s):
    return M.map_calls(call_units(s))["warnings"].select("unit_index", "reason")


def transfer_units(s):
    return log_units(s, ["Txn Id", "From Account", "To Account", "Amount", "Date", "Mode"],
                     "cast(o_orderkey as string), concat('ACC', cast(o_custkey as string)), concat('ACC', cast(o_orderkey + 100000 as string)), "
                     "cast(o_totalprice as string), substr(cast(o_orderdate as string), 1, 10), case when o_orderkey % 2 = 0 then 'upi' else 'neft' end")


@query("e8_map_transfers", """select o_orderkey unit_index, case when o_orderkey % 2 = 0 then 'SENT_UPI' else 'TRANSFERRED_TO' end type,
concat('account:', substr(sha256(concat(':Account:ACC', o_custkey)), 1, 24)) source, cast(o_totalprice as varchar) amount,
concat('Transferred ', o_totalprice, ' from ACC', o_custkey, ' to ACC', o_orderkey + 100000, ' on ', substr(cast(o_orderdate as varchar), 1, 10)) evidence_text from orders""")
def _(s):
    return M.map_transfers(transfer_units(s))["edges"].select("unit_index", "type", "source", "amount", "evidence_text")


@query("d4_header_aliases", """select o_orderkey unit_index, 'TRANSFERRED_TO' type from orders""")
def _(s):
    """Header names are an argument: a statement in another vocabulary maps with its own aliases."""
    units = log_units(s, ["Remitente", "Destino"], "concat('ACC', cast(o_custkey as string)), concat('ACC', cast(o_orderkey + 100000 as string))")
    aliases = {**V.BANK_ALIASES, "from_account": "remitente", "to_account": "destino"}
    return M.map_transfers(units, aliases)["edges"].select("unit_index", "type")


REGISTRY = {
    # schema: (table, key column, header, cells, expected edge type, expected evidence, where)
    "accounts": ("orders", "o_orderkey", ["account_id", "account_number", "holder_id", "upi_id", "bank"],
                 "concat('a', cast(o_orderkey as string)), lpad(cast(o_orderkey as string), 10, '0'), concat('P', cast(o_custkey as string)), concat('u', cast(o_custkey as string), '@okbank'), o_orderpriority",
                 [("HOLDER_OF", "concat('P', o_custkey, ' holds account ', lpad(cast(o_orderkey as varchar), 10, '0'))"),
                  ("HAS_UPI", "concat('Account ', lpad(cast(o_orderkey as varchar), 10, '0'), ' linked to UPI u', o_custkey, '@okbank')")]),
    "kyc": ("customer", "c_custkey", ["person_id", "name_as_reported", "phone", "email"],
            "concat('P', cast(c_custkey as string)), c_name, concat('9', lpad(cast(c_custkey as string), 9, '0')), ''",
            [("HAS_PHONE", "concat('KYC: ', c_name, ' has phone 9', lpad(cast(c_custkey as varchar), 9, '0'))")]),
    "company_registry": ("supplier", "s_suppkey", ["company_id", "company_name", "registration_number", "primary_bank_account_id"],
                         "concat('C', cast(s_suppkey as string)), s_name, concat('R', cast(s_suppkey as string)), concat('ACC', cast(s_suppkey as string))",
                         [("OPERATES_ACCOUNT", "concat(s_name, ' operates account ACC', s_suppkey)")]),
    "company_directors": ("supplier", "s_suppkey", ["company_id", "person_id", "role", "start_date"],
                          "concat('C', cast(s_suppkey as string)), concat('P', cast(s_suppkey * 2 as string)), case when s_suppkey % 2 = 0 then 'Chair' else '' end, '2024-01-01'",
                          [("DIRECTOR_OF", "concat('P', s_suppkey * 2, ' is ', case when s_suppkey % 2 = 0 then 'Chair' else 'Director' end, ' of C', s_suppkey)")]),
    "vehicles": ("part", "p_partkey", ["vehicle_id", "registration_number", "owner_person_id", "make"],
                 "concat('V', cast(p_partkey as string)), concat('DL1AB', lpad(cast(p_partkey as string), 4, '0')), concat('P', cast(p_size as string)), p_brand",
                 [("OWNS_VEHICLE", "concat('P', p_size, ' owns vehicle DL1AB', lpad(cast(p_partkey as varchar), 4, '0'))")]),
    "vehicle_events": ("lineitem", "l_orderkey * 8 + l_linenumber", ["event_id", "vehicle_id", "timestamp", "location_id", "event_type"],
                       "'e', concat('V', cast(l_partkey as string)), substr(cast(l_shipdate as string), 1, 10), concat('L', cast(l_suppkey as string)), case when l_linenumber = 1 then '' else 'toll' end",
                       [("VEHICLE_SEEN_AT", "concat('Vehicle V', l_partkey, ' ', case when l_linenumber = 1 then 'seen_at' else 'toll' end, ' at L', l_suppkey, ' on ', substr(cast(l_shipdate as varchar), 1, 10))")]),
    "locations": ("nation", "n_nationkey", ["location_id", "name", "city", "latitude"],
                  "concat('L', cast(n_nationkey as string)), n_name, concat('city', cast(n_regionkey as string)), '1.0'", []),
    "cyber_events": ("events", "event_id", ["event_id", "timestamp", "event_type", "source_entity_id", "ip_address", "domain_name"],
                     "cast(event_id as string), substr(cast(ts as string), 1, 19), event_type, concat('P', cast(user_id as string)), '10.0.0.1', case when event_id % 2 = 0 then 'x.org' else '' end",
                     [("CYBER_EVENT", "concat('P', user_id, ' ', event_type, ' on ', case when event_id % 2 = 0 then 'x.org' else '10.0.0.1' end, ' at ', substr(cast(ts as varchar), 1, 19))")]),
    "emails": ("events", "event_id", ["sender_email", "receiver_email", "timestamp"],
               "concat('u', cast(user_id as string), '@x.org'), concat('v', cast(event_id % 50 as string), '@y.org'), substr(cast(ts as string), 1, 19)",
               [("EMAILED", "concat('u', user_id, '@x.org emailed v', event_id % 50, '@y.org at ', substr(cast(ts as varchar), 1, 19))")]),
    "ip_events": ("events", "event_id", ["ip_event_id", "ip_address", "person_id", "event_type", "timestamp"],
                  "cast(event_id as string), concat('10.0.0.', cast(event_id % 200 as string)), concat('P', cast(user_id as string)), event_type, substr(cast(ts as string), 1, 19)",
                  [("IP_ACTIVITY", "concat('P', user_id, ' ', event_type, ' from 10.0.0.', event_id % 200, ' at ', substr(cast(ts as varchar), 1, 19))")]),
    "domains": ("pages", "page_id", ["domain_id", "domain", "registrar"],
                "cast(page_id as string), concat('d', cast(page_id % 97 as string), '.org'), 'reg'", []),
}


def registry_units(s, schema):
    """The rows of a table as a registry sheet, split over a few documents."""
    table, key, header, cells, _e = REGISTRY[schema]
    rows = s.sql(f"select 'K' case_id, concat('{schema}', cast(({key}) % 3 as string)) doc_id, cast({key} as bigint) unit_index, 'row' kind, array({cells}) cells from {{{table}}}")
    heads = rows.select("case_id", "doc_id").distinct().select("case_id", "doc_id", F.lit(-1).cast("bigint").alias("unit_index"),
                                                               F.lit("row").alias("kind"), F.array(*[F.lit(h) for h in header]).alias("cells"))
    return rows.unionByName(heads)


def _register_registry():
    letters = dict(zip(REGISTRY, "abcdefghijk"))
    for schema, (table, key, _h, _c, expected) in REGISTRY.items():
        name = f"e9{letters[schema]}_{schema}"
        # headers of an ip_events sheet also satisfy cyber_events, which is declared first and wins;
        # a caller that knows its sheets passes only the schemas they can have
        schemas = {schema: V.REGISTRY_ALIASES[schema]} if schema == "ip_events" else None
        if expected:
            sql = " union all ".join(f"select cast({key} as bigint) unit_index, '{t}' type, {e} evidence_text from {table}" for t, e in expected)
            query(name, sql)(lambda s, schema=schema, schemas=schemas: M.map_registry(
                registry_units(s, schema), schemas=schemas)["edges"].select(
                "unit_index", "type", "evidence_text"))
        elif schema == "locations":
            query(name, """select concat('L', n_nationkey) external_id, concat(n_name, ', city', n_regionkey) label, 'Location' type from nation""")(
                lambda s: M.map_registry(registry_units(s, "locations"))["entities"].select("external_id", "label", "type"))
        else:
            query(name, """select cast(page_id as varchar) external_id, concat('d', page_id % 97, '.org') label, 'Domain' type from pages""")(
                lambda s: M.map_registry(registry_units(s, "domains"))["entities"].select("external_id", "label", "type"))


_register_registry()


@query("e10_cooccurrence", f"""select (select count(*) from orders) + (select count(*) from orders where o_orderkey % 7 in {CALL_FORMS}) edges,
cast(0 as bigint) violations""")
def _(s):
    """All narrative edges, and how many of them lack their connector: none."""
    units = s.narratives()
    rules = compile_rules(load_rules(s.spark))
    edges = cut(extract_relations(units, X.identifier_mentions(units), rules))
    lacking = X.cooccurrence_violations(edges, X.sentence_rows(units))
    return edges.agg(F.count("*").alias("edges")).crossJoin(lacking.agg(F.count("*").alias("violations")))


@query("d1_custom_rule", """select cast(o_orderkey as varchar) doc_id, 'APPEARS_WITH' type from orders where o_orderkey % 7 = 6""")
def _(s):
    """A rule row added to the rule table changes what is extracted; no code changes."""
    extra = s.spark.createDataFrame([("together", "APPEARS_WITH", None, ["Phone"], r"\s+and\s+phone\s+", False, 99)],
                                    load_rules(s.spark).schema)
    rules = compile_rules(load_rules(s.spark).filter("id = 'meeting'").unionByName(extra))
    units = s.narratives()
    return extract_relations(units, X.identifier_mentions(units), rules).select("doc_id", "type")


@query("d3_pluggable_tagger", """select cast(o_orderkey as varchar) doc_id, 'MET' type from orders join customer on o_custkey = c_custkey
join (select l_orderkey, min(l_suppkey) k from lineitem group by 1) l on l_orderkey = o_orderkey join supplier on s_suppkey = k where o_orderkey % 3 = 1""")
def _(s):
    """Any (name, type) table can tag narratives; its mentions feed the same rules."""
    units, names = meetings(s)
    _e, mentions = X.tag_gazetteer(units, names)
    return extract_relations(units, mentions, compile_rules(load_rules(s.spark))).select("doc_id", "type")


@query("k3_extraction_run", f"""select type, count(*) edges from (
select 'CALLED' type from orders where o_orderkey % 10 <> 0 union all select 'CALLED' from orders where o_orderkey % 7 in {CALL_FORMS} union all
select case when o_orderkey % 2 = 0 then 'SENT_UPI' else 'TRANSFERRED_TO' end from orders union all select 'TRANSFERRED_TO' from orders) group by 1""")
def _(s):
    """A whole run over call logs, bank statements and narratives, saved and read back."""
    from ..extraction_run import run_extraction
    tagged = lambda units, mark: units.withColumn("doc_id", F.concat(F.lit(mark), F.col("doc_id").cast("string")))
    units = (tagged(call_units(s), "calls ").unionByName(tagged(transfer_units(s), "bank "))
             .unionByName(tagged(s.narratives().select("case_id", "doc_id", "unit_index", "kind", "text"), ""), allowMissingColumns=True))
    root = scratch_path(s.spark, "run")
    store.save_extraction(run_extraction(units, F.timestamp_seconds(F.lit(0))), root)
    return s.spark.read.parquet(store.table_path(root, "relationships")).groupBy("type").agg(F.count("*").alias("edges"))
