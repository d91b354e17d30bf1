"""Queries for column functions (x*) and extension points (d*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions import identifiers as I
from ...functions import scoring as S
from ...functions import text as X
from .registry import ORACLES, query

# raw identifiers in several spellings, from the customer keys; the same text runs on both engines
RAW = """(select c_custkey k, c_name, c_nationkey, c_mktsegment, c_acctbal,
  case c_custkey % 6 when 0 then concat('+91 9', lpad(cast(c_custkey as string), 9, '0'))
    when 1 then concat('091', lpad(cast(c_custkey as string), 8, '7')) when 2 then concat('(98765) ', lpad(cast(c_custkey as string), 5, '0'))
    when 3 then concat('+44-', lpad(cast(c_custkey as string), 8, '2')) when 4 then '12345'
    else concat('5', lpad(cast(c_custkey as string), 9, '0')) end phone,
  case c_custkey % 4 when 0 then concat('dl ', cast(c_custkey % 90 + 1 as string), 'c ab ', lpad(cast(c_custkey % 10000 as string), 4, '0'))
    when 1 then concat('22bh', lpad(cast(c_custkey % 10000 as string), 4, '0'), 'a')
    when 2 then concat('MH-12-AB-', lpad(cast(c_custkey % 10000 as string), 4, '0')) else concat('X', cast(c_custkey as string)) end plate,
  case c_custkey % 3 when 0 then concat('User.', cast(c_custkey as string), '@OkBank') when 1 then concat('u@', cast(c_custkey as string))
    else concat(lpad(cast(c_custkey as string), 10, '9'), '@paytm') end upi,
  case c_custkey % 4 when 0 then concat('00 ', lpad(cast(c_custkey as string), 9, '1'), '-5') when 1 then concat('pat/', cast(c_custkey + 100 as string))
    when 2 then 'no digits' else concat('ab', cast(c_custkey as string)) end account,
  case c_custkey % 2 when 0 then concat('hdfc0', lpad(cast(c_custkey as string), 6, '0')) else concat('HDFC1', lpad(cast(c_custkey as string), 6, '0')) end ifsc,
  lpad(cast(c_custkey * 7919 + 1000000000000 as string), 15, '4') digits from {customer}) raw"""
RAW_SQL = RAW.replace("{customer}", "customer")


def raw(s):
    return s.sql(f"select * from {RAW}")


CLEAN_PHONE = "regexp_replace(phone, '[ ().-]', '', 'g')"
PHONE_SQL = f"""case when regexp_full_match({CLEAN_PHONE}, '(\\+91|91|0)?[6-9][0-9]{{9}}') then
concat('+91', right({CLEAN_PHONE}, 10)) when regexp_full_match({CLEAN_PHONE}, '\\+[1-9][0-9]{{6,14}}') then {CLEAN_PHONE} end"""


@query("x1_normalize_phone", f"select k, phone, {PHONE_SQL} value from {RAW_SQL}")
def _(s):
    return raw(s).select("k", "phone", I.normalize_phone(F.col("phone")).alias("value"))


@query("x2_normalize_vehicle", f"""select k, case when k % 4 < 3 then upper(regexp_replace(plate, '[ -]', '', 'g')) end value from {RAW_SQL}""")
def _(s):
    return raw(s).select("k", I.normalize_vehicle(F.col("plate")).alias("value"))


@query("x3_normalize_upi", f"select k, case when k % 3 <> 1 then lower(upi) end value from {RAW_SQL}")
def _(s):
    return raw(s).select("k", I.normalize_upi(F.col("upi")).alias("value"))


@query("x4_normalize_account", f"""select k, case when k % 4 = 0 then regexp_replace(account, '[ -]', '', 'g')
when k % 4 = 1 then upper(account) when k % 4 = 3 and length(account) >= 4 then upper(account) end value from {RAW_SQL}""")
def _(s):
    return raw(s).select("k", I.normalize_account(F.col("account")).alias("value"))


@query("x5_normalize_ifsc", f"select k, case when k % 2 = 0 then upper(ifsc) end value from {RAW_SQL}")
def _(s):
    return raw(s).select("k", I.normalize_ifsc(F.col("ifsc")).alias("value"))


@query("x6_luhn", f"""select k, digits, list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 1
  then cast(substr(reverse(digits), i, 1) as int) else cast(substr('0246813579', cast(substr(reverse(digits), i, 1) as int) + 1, 1) as int) end)) % 10 = 0 ok
from {RAW_SQL}""")
def _(s):
    return raw(s).select("k", "digits", I.luhn_ok(F.col("digits")).alias("ok"))


@query("x7_normalized", f"""select k, {PHONE_SQL.replace(' end', " else regexp_replace(phone, '[^0-9]', '', 'g') end")} as phone_value,
lower(c_name) as name_value, lower(c_mktsegment) as place_value from {RAW_SQL}""")
def _(s):
    kind = lambda c, k: I.normalized(I.nfkc(F.col(c)), F.lit(k))
    padded = raw(s).withColumns({"who": F.concat(F.lit("Dr.  "), "c_name", F.lit(" ")),
                                 "place": F.concat(F.lit("  "), "c_mktsegment")})
    return padded.select("k", kind("phone", "Phone").alias("phone_value"), kind("who", "Person").alias("name_value"),
                         kind("place", "Location").alias("place_value"))


@query("x8_entity_id", """select c_custkey k, concat('person:', substr(sha256(concat('case:', c_nationkey, ':Person:', lower(c_name))), 1, 24)) person_id,
concat('location:', substr(sha256(concat(':Location:', lower(c_mktsegment))), 1, 24)) place_id from customer""")
def _(s):
    scope = F.concat(F.lit("case:"), F.col("c_nationkey").cast("string"))
    return s.table("customer").select(
        F.col("c_custkey").alias("k"), I.entity_id(F.col("c_name"), F.lit("Person"), scope).alias("person_id"),
        I.entity_id(F.col("c_mktsegment"), F.lit("Location"), scope).alias("place_id"))


@query("x9_edge_id", """select o_orderkey, concat('reg:', substr(sha256(concat_ws(':', 'PLACED', o_custkey, o_orderkey)), 1, 24)) edge,
concat('DOC-', sha256(concat(o_orderstatus, ':', o_orderkey))) doc from orders""")
def _(s):
    return s.table("orders").select(
        "o_orderkey", I.edge_id("reg", F.lit("PLACED"), F.col("o_custkey"), F.col("o_orderkey")).alias("edge"),
        I.document_id(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("doc"))


@query("x10_norm_header", "select p_partkey, regexp_replace(lower(concat(p_name, ' #', p_brand)), '[^a-z0-9]', '', 'g') h from part")
def _(s):
    return s.table("part").select("p_partkey", I.norm_header(F.concat("p_name", F.lit(" #"), "p_brand")).alias("h"))


@query("x11_map_roles", """select o_orderkey, cast(case when o_orderkey % 3 = 0 then 2 else 1 end as integer) caller,
cast(case when o_orderkey % 3 = 0 then 1 else 2 end as integer) receiver, cast(case when o_orderkey % 2 = 0 then 3 else 0 end as integer) duration from orders""")
def _(s):
    flip, third = F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "DURATION (sec)").otherwise("note")
    cells = F.array(F.when(flip, "To Number").otherwise("Caller ID"), F.when(flip, "From_Number").otherwise("Callee"), third)
    roles = I.map_roles(F.transform(cells, I.norm_header), V.CALL_ALIASES)
    return s.table("orders").withColumn("r", roles).select(
        "o_orderkey", F.col("r")[0].alias("caller"), F.col("r")[1].alias("receiver"), F.col("r")[3].alias("duration"))


@query("x12_cell", """select o_orderkey, case o_orderkey % 4 when 1 then o_orderstatus when 2 then o_orderpriority else '' end v from orders""")
def _(s):
    cells = F.array(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), F.col("o_orderpriority"))
    return s.table("orders").select("o_orderkey", I.cell(cells, (F.col("o_orderkey") % 4).cast("int")).alias("v"))


@query("x13_find_spans", """, ch as (select doc_id, unnest(string_split(text, '')) c, generate_subscripts(string_split(text, ''), 1) i from documents)
select doc_id, count(*) n, cast(sum(i - 1) as bigint) starts from ch where c in ('.', '!', '?') group by 1""")
def _(s):
    spans = s.table("documents").select("doc_id", F.explode(X.find_spans(F.col("text"), r"[.!?]")).alias("s"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s.start").alias("starts"))


@query("x14_snippet", """select doc_id, md5(substr(text, greatest(pos - 101, 0) + 1, case when pos > 100 then 201 else pos + 100 end)) snippet
from (select doc_id, text, strpos(text, '.') pos from documents) where pos > 0""")
def _(s):
    at = s.table("documents").withColumn("pos", F.instr("text", ".")).filter("pos > 0")
    return at.select("doc_id", F.md5(X.snippet(F.col("text"), F.col("pos") - 1, F.col("pos"))).alias("snippet"))


ABBREVIATED = "'(?i)(^|[^A-Za-z])(" + "|".join(V.ABBREVIATIONS) + "|[A-Z])\\.'"
SENTENCE_COUNT = f"""select doc_id, len(regexp_extract_all(t, '[.!?](\\s|$)')) + len(regexp_extract_all(t, '\\n\\s*\\n'))
  + case when t = '' or regexp_matches(t, '([.!?]|\\n\\s*\\n)$') then 0 else 1 end sentences
from (select doc_id, regexp_replace(regexp_replace(text, {ABBREVIATED}, '\\1\\2_', 'g'), {ABBREVIATED}, '\\1\\2_', 'g') t from documents)"""


@query("x15_sentences", SENTENCE_COUNT.replace("select doc_id,", "select doc_id, cast(", 1).replace(" sentences\n", " as bigint) sentences\n", 1))
def _(s):
    """Sentence counts; their lengths must add up to the text, or the count is negated."""
    spans = s.table("documents").withColumn("s", X.sentences(F.col("text")))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return spans.select("doc_id", F.when(total == F.length("text"), F.size("s")).otherwise(-F.size("s")).cast("bigint").alias("sentences"))


@query("x16_squeeze", """select doc_id, md5(trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}]+', ' ', 'g'))) h from documents""")
def _(s):
    return s.table("documents").select("doc_id", F.md5(I.squeeze(F.col("text"))).alias("h"))


@query("x17_parse_amount", """select o_orderkey, cast(o_totalprice as varchar) amount, case when o_orderkey % 3 <> 0 then
cast(o_orderkey % 900 as double) / 4 end as seconds from orders""")
def _(s):
    parts = s.sql("""select o_orderkey, o_totalprice, case when o_orderkey % 3 = 0 then 'bad' else
        cast(cast(o_orderkey % 900 as double) / 4 as string) end d from {orders}""")
    with_commas = F.regexp_replace(F.col("o_totalprice").cast("string"), r"(\d)(?=(\d{3})+\.)", "$1,")
    return parts.select("o_orderkey", S.parse_amount(with_commas).alias("amount"), S.parse_duration(F.col("d")).alias("seconds"))


@query("x18_lead_confidence", "select case_id, entity_id, confidence_score from hub")
def _(s):
    from ...operators.aggregates import connections
    from ...operators.leads import leads_hub
    return leads_hub(connections(s.entities(), s.edges()), s.edges()).select("case_id", "entity_id", "confidence_score")


@query("x19_lead_severity", "select c_custkey, case when c_custkey % 7 >= 5 or c_custkey % 4 >= 2 then 'high' else 'medium' end severity from customer")
def _(s):
    return s.table("customer").select("c_custkey", S.lead_severity(F.col("c_custkey") % 7, F.col("c_custkey") % 4).alias("severity"))


@query("x20_edge_label", """select case_id, source, target, concat('ordered from', case when n > 1 then concat(' ×', n) else '' end) label
from (select case_id, source, target, count(*) n from ev group by 1, 2, 3)""")
def _(s):
    from ...operators.aggregates import bundle_edges
    return bundle_edges(s.edges())[0].select("case_id", "source", "target", S.edge_label(F.col("type"), F.col("occurrence_count")).alias("label"))


@query("x21_shorten", """select p_partkey, case when length(p_name) > 8 then concat(substr(p_name, 1, 7), '…') else p_name end short,
concat(p_brand, ' ···', right(cast(p_partkey + 10000 as varchar), 4)) masked from part""")
def _(s):
    return s.table("part").select("p_partkey", S.shorten(F.col("p_name"), 8).alias("short"), S.mask_account(
        F.col("p_brand"), (F.col("p_partkey") + 10000).cast("string"), F.lit("?")).alias("masked"))


@query("x22_evidence_text", "select o_orderkey, concat('Customer ', o_custkey, ' placed ', o_orderkey, ' on ', substr(cast(o_orderdate as varchar), 1, 10)) line from orders")
def _(s):
    as_text = lambda c: F.col(c).cast("string")
    return s.table("orders").select("o_orderkey", S.evidence_text(
        "Customer %s placed %s on %s", as_text("o_custkey"), as_text("o_orderkey"),
        F.substr(as_text("o_orderdate"), F.lit(1), F.lit(10))).alias("line"))


WORDS = lambda pattern: "'(?i)" + pattern.replace("'", "''") + "'"


@query("x23_statement_predicates", f"""select doc_id, regexp_matches(text, {WORDS(V.NEGATED)}) negated, regexp_matches(text, {WORDS(V.UNSAFE)}) unsafe,
regexp_matches(text, {WORDS(V.ATTRIBUTION)}) attributed, regexp_matches(text, {WORDS(V.UNCONFIRMED)}) uncertain from narr""")
def _(s):
    t = F.col("text")
    return s.narratives().select("doc_id", X.is_negated(t).alias("negated"), X.is_unsafe(t).alias("unsafe"),
                                 X.is_attributed(t).alias("attributed"), X.is_uncertain(t).alias("uncertain"))


PREFIXES = """(select o_orderkey, case o_orderkey % 6 when 0 then 'On 18 September 2026, the witness stated that phone '
  when 1 then 'Yesterday, ' when 2 then 'Another clerk said ' when 3 then 'According to call records, the accused '
  when 4 then '' else 'At 09:00, phone no. ' end prefix from {orders}) t"""


@query("x24_prefix_context", f"select o_orderkey, o_orderkey % 6 <> 2 safe, o_orderkey % 6 in (0, 3) reported from {PREFIXES.replace('{orders}', 'orders')}")
def _(s):
    return s.sql(f"select * from {PREFIXES}").withColumn("c", X.prefix_context(F.col("prefix"))).select(
        "o_orderkey", "c.safe", "c.reported")


@query("x25_clause_bounds", """select o_orderkey, case when o_orderkey % 2 = 0 then 'then ' else concat('order ', o_orderkey, ' then ') end prefix,
case o_orderkey % 3 when 0 then ' and later' when 1 then ', but this is disputed' else '' end clause, o_orderkey % 3 = 1 qualifier from orders""")
def _(s):
    t = s.sql("""select o_orderkey, concat(case when o_orderkey % 2 = 0 then 'first; x, and ' else concat('order ', o_orderkey, ' ') end, 'then ') before,
        concat('.5', case o_orderkey % 3 when 0 then ' and later' when 1 then ', but this is disputed' else '' end) tail from {orders}""")
    clause = X.following_clause(F.col("tail"))
    return t.select("o_orderkey", X.clause_prefix(F.col("before")).alias("prefix"), clause.alias("clause"),
                    ((clause != "") & X.is_qualifier(clause)).alias("qualifier"))


@query("x26_identifier_label", r"""select doc_id, regexp_replace(text, '(?i)\b((?:mobile\s+|telephone\s+)?(?:phone|vehicle|account|a/c|IMEI))\s+(?:number|no\.?)\s*[:#-]?\s*', '\1 ', 'g') t from narr""")
def _(s):
    return s.narratives().select("doc_id", X.strip_identifier_label(F.col("text")).alias("t"))


@query("x27_chunk")
def _(s):
    """Chunks of every document under a 2000 character window with 200 overlap."""
    parts = s.texts().select("doc_id", F.posexplode(X.chunk(F.col("text"), 2000, 200)).alias("n", "c"))
    return parts.select("doc_id", "n", "c.start", "c.end", "c.clipped")


def _window(at: str) -> str:
    """The window that begins at a place, as columns of a select over text and total."""
    limit = f"least({at} + 2000, total)"
    low = f"greatest({at} + 1, {limit} - 200)"
    reach = " , ".join(f"length(regexp_extract(substr(text, {low} + 1, {limit} - {low}), '(?s)^.*(?:{end})'))"
                       for end in (r"[.!?](?:\s+|\z)", r"\n\s*\n"))
    return f"{at} s, {limit} lim, {low} low, greatest({reach}) reach"


_END = "case when lim < total and reach > 0 then low + reach else lim end"
ORACLES["x27_chunk"] = f"""with recursive w as (
select doc_id, text, total, 0 n, {_window('0')} from (select cast(doc_id as varchar) doc_id, text, length(text) total from documents where length(text) > 0) d
union all select doc_id, text, total, n + 1, {_window('nx')} from (
  select *, greatest(s + 1, {_END} - 200) nx from w where {_END} < total) v)
select doc_id, cast(n as integer) n, cast(s as integer) "start", cast({_END} as integer) "end", lim < total and reach = 0 clipped from w"""


@query("x28_drop_empty", "select o_orderkey, cast(case when o_orderkey % 2 = 0 then 2 else 1 end as integer) kept from orders")
def _(s):
    bag = F.create_map(F.lit("status"), "o_orderstatus", F.lit("note"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(""),
                       F.lit("none"), F.lit(None).cast("string"))
    return s.table("orders").select("o_orderkey", F.size(S.drop_empty(bag)).alias("kept"))


@query("x29_extraction_version", f"""select document_id, '{":".join(V.COMPONENT_VERSIONS)}:rules' extraction_version from docs where processing_status = 'completed'""")
def _(s):
    return s.documents().filter("processing_status = 'completed'").select("document_id", S.extraction_version().alias("extraction_version"))


@query("x30_round3", "select l_orderkey, l_partkey, l_suppkey, round(l_extendedprice / 7, 3) v from lineitem")
def _(s):
    return s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", S.round3(F.col("l_extendedprice") / 7).alias("v"))


@query("x31_role_type", """select s_suppkey, case when s_suppkey % 3 = 0 then 'Organization' else 'Person' end type,
case when s_suppkey % 2 = 0 then 'ACCUSED_IN' else 'MENTIONED_IN' end relation from supplier""")
def _(s):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.lit(" Exports")).otherwise(F.lit("")))
    role = F.when(F.col("s_suppkey") % 2 == 0, F.lit("Prime SUSPECT")).otherwise(F.lit("associate"))
    return s.table("supplier").select("s_suppkey", S.role_type(name).alias("type"), S.role_relation(role).alias("relation"))


@query("x32_column_span", """select c_custkey, cast(length(c_mktsegment) + 4 as integer) "start", cast(length(c_mktsegment) + 4 + length(c_name) as integer) "end", true exact from customer""")
def _(s):
    cells = F.array(F.col("c_mktsegment"), F.concat(F.lit(" "), "c_name"), F.lit("z"))
    spans = s.table("customer").withColumns({"p": I.column_span(cells, F.lit(2)), "row": F.array_join(cells, " | ")})
    return spans.select("c_custkey", "p.start", "p.end", (X.span_text(F.col("row"), F.col("p.start"), F.col("p.end"))
                                                        == F.col("c_name")).alias("exact"))


@query("x33_confidence_band", """select case_id, entity_id, case when confidence_score >= 0.9 then 'strong' when confidence_score >= 0.75 then 'moderate' else 'weak' end band,
cast(round(confidence_score * 100) as integer) percent from hub""")
def _(s):
    from ...operators.aggregates import connections
    from ...operators.leads import leads_hub
    leads = leads_hub(connections(s.entities(), s.edges()), s.edges())
    return leads.select("case_id", "entity_id", S.confidence_band(F.col("confidence_score")).alias("band"),
                        S.confidence_percent(F.col("confidence_score")).alias("percent"))


@query("d2_entity_column", """select s_suppkey, concat('organization:', substr(sha256(concat(':Organization:', lower(s_name))), 1, 24)) id from supplier""")
def _(s):
    """Any mapper can mint ids with one Column function."""
    return s.table("supplier").select("s_suppkey", I.entity_id(F.col("s_name"), F.lit("Organization")).alias("id"))


@query("d5_nfkc", "select doc_id, md5(nfc_normalize(text)) h from documents")
def _(s):
    """Compatibility form of every document; the given texts hold no compatibility characters, so SQL's canonical form
    is the same. The tests compare texts that do hold them."""
    return s.table("documents").select("doc_id", F.md5(I.nfkc(F.col("text"))).alias("h"))
