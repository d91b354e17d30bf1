"""The registered queries of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import (chat, embedding_dedup, exact_dedup, line_dedup, mixing, packing, periodic_runs,
                           prefix_trie, quality_rules, secret_scan, simhash, suffix_dedup, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_best_fit_packing")
def op1(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(), 2048)


@query("op2_secret_scan")
def op2(spark, folder):
    return secret_scan.scan_secrets(table(spark, folder, "documents"))


@query("op3_suffix_dedup")
def op3(spark, folder):
    return suffix_dedup.repeated_spans(table(spark, folder, "documents"), 50).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op4_exact_dedup", """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
select t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, g.keep_id is null and row_number() over (partition by x) = 1) as kept, sha256(t.x) as text_sha256 from t join g using (x)""")
def op4(spark, folder):
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


@query("op5_embedding_dedup", """
with v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
  and len([x for x in embedding if x <> 0]) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (with recursive walk(a, b) as (select a, b from p union select walk.a, p.b from walk join p on walk.b = p.a) select a, min(b) as low from walk group by a),
n as (select a, count(*) as n_links from p group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(r.low, e.vec_id)) as kept
from embeddings e left join n on n.a = e.vec_id left join r on r.a = e.vec_id""")
def op5(spark, folder):
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op6_source_mix")
def op6(spark, folder):
    found = mixing.mix(table(spark, folder, "documents"))
    return found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op7_toxicity")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train_toxicity(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "toxic_spans")


@query("op8_simhash")
def op8(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op9_preference_format", """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  where conv_id is not null and turn is not null),
last as (select conv_id, max(turn) as pos, max_by(text, turn) as reply from c where role = 'assistant' group by conv_id),
swap as (select a.conv_id, a.pos, b.reply from last a join last b on b.conv_id = xor(a.conv_id, 1)),
opening as (select conv_id, min_by(role, turn) as role, min_by(text, turn) as text from c group by conv_id),
pairs as (select * from (select conv_id, lead(conv_id) over (partition by role, text order by conv_id) as nxt from opening) where nxt is not null),
sides as (
  select conv_id * 2 as pair_id, 'c' as side, turn, role, text from c join swap using (conv_id)
  union all select conv_id * 2, 'r', turn, role, text from c join swap using (conv_id) where turn < pos
  union all select conv_id * 2, 'r', pos, 'assistant', reply from swap
  union all select p.conv_id * 2 + 1, 'c', turn, role, text from c join pairs p using (conv_id)
  union all select p.conv_id * 2 + 1, 'r', turn, role, text from c join pairs p on c.conv_id = p.nxt),
placed as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as place from sides),
compared as (select pair_id, place, count(*) = 2 and count(distinct role || chr(0) || text) = 1 as same from placed group by pair_id, place),
prefix as (select pair_id, coalesce(min(place) filter (not same), max(place) + 1) - 1 as n from compared group by pair_id),
rendered as (select pair_id, side, place, n, '<|' || role || '|>' || chr(10) as head, text || chr(10) || '<|end|>' || chr(10) as body, role from placed join prefix using (pair_id))
select pair_id, any_value(n)::int as prefix_turns,
  coalesce(string_agg(head || body, '' order by place) filter (side = 'c' and place <= n), '') as prompt,
  coalesce(string_agg(head || body, '' order by place) filter (side = 'c' and place > n), '') as chosen,
  coalesce(string_agg(head || body, '' order by place) filter (side = 'r' and place > n), '') as rejected,
  coalesce(string_agg('0:' || length(head) || case when role = 'assistant' then ',1:' else ',0:' end || length(body), ',' order by place) filter (side = 'c' and place > n), '') as chosen_mask,
  coalesce(string_agg('0:' || length(head) || case when role = 'assistant' then ',1:' else ',0:' end || length(body), ',' order by place) filter (side = 'r' and place > n), '') as rejected_mask
from rendered group by pair_id""")
def op9(spark, folder):
    conversations = table(spark, folder, "conversations")
    sides = [a.unionByName(b) for a, b in zip(chat.swapped_replies(conversations), chat.next_openings(conversations))]
    return chat.format_preferences(*sides)


@query("op10_line_dedup", """
with l as (select doc_id, i::int as place, string_split(text, chr(10))[i + 1] as line, len(string_split(text, chr(10))) as n
  from documents, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as s(i)),
w as (select doc_id, place, line || chr(10) || l2 || chr(10) || l3 as w from (select *, lead(line) over o as l2, lead(line, 2) over o as l3 from l
  window o as (partition by doc_id order by place)) where place + 2 < n and not (trim(line) = '' and trim(l2) = '' and trim(l3) = '')),
f as (select *, row_number() over (partition by w order by doc_id, place) as nth from w),
c as (select distinct doc_id, place + k as place from f, unnest([0, 1, 2]) as s(k) where nth > 1),
d as (select l.doc_id, coalesce(string_agg(l.line, chr(10) order by l.place) filter (c.place is null), '') as text, count(*) as n_lines, count(c.place) as n_removed
  from l left join c on c.doc_id = l.doc_id and c.place = l.place group by l.doc_id)
select doc_id, text, n_lines, n_removed from d union all select doc_id, null, 0, 0 from documents where text is null""")
def op10(spark, folder):
    return line_dedup.dedupe_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op11_conversation_trie", """
with t as (select conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, d) - 1 as place from t),
i as (select distinct conv_id, conv_id - conv_id % 20 as lead from t),
h as (select *, (xor(list_reduce([ascii(x)::bigint for x in string_split(conv_id::varchar, '')], lambda c, b:
  list_reduce(range(8)::bigint[], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295::bigint), 4294967295) % 4) as h from i),
r as (select h.conv_id, 0 as side, place, d, words from h join o on o.conv_id = h.lead where place < h
  union all select h.conv_id, 1, place, d, words from h join o on o.conv_id = h.conv_id where place >= h),
p as (select conv_id, words, string_agg(d, '') over w as k, row_number() over w as depth, count(*) over (partition by conv_id) as n from r
  window w as (partition by conv_id order by side, place)),
m as (select conv_id, words, k, depth, depth = n as ends from p union all
  select conv_id, 0, '', 0, conv_id not in (select conv_id from r) from i),
n as (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
  coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids from m group by k, depth),
c as (select left(k, 32 * (depth - 1)) as k, count(*) as n_children from n where depth > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (k)),
a as (select left(k, 32 * j) as k, sum((n_children = 0)::bigint)::bigint as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens
  from f, unnest(generate_series(0, depth)) as s(j) group by 1)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ids) as ends_sha256
from f join a using (k) left join n u on f.depth > 0 and u.k = left(f.k, 32 * (f.depth - 1))""")
def op11(spark, folder):
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(table(spark, folder, "conversations")))


@query("op12_periodic_runs")
def op12(spark, folder):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, folder, "documents"), periodic_runs.looped))


@query("op13_quality_rules", r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from documents),
g as (select r, i, array_to_string(w[i:i + 4], ' ') as g from d, unnest(generate_series(1, len(w) - 4)) as s(i)),
c as (select r, count(distinct i + k) as n from (select r, i from g qualify count(*) over (partition by r, g) > 1),
  unnest([0, 1, 2, 3, 4]) as s(k) group by r),
m as (select doc_id, w, l, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words from d left join c using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 3 * n_words and 10 * n_words and 10 * n_symbols <= n_words
  and 10 * n_dup_lines <= 3 * len(l) and 10 * len([x for x in w if regexp_matches(x, '\pL')]) >= 8 * n_words
  and 10 * len([x for x in l if regexp_matches(x, '^[ \t]*[-*•][ \t]*[^\x20\x09-\x0D]')]) <= 9 * len(l)
  and 10 * len([x for x in l if regexp_matches(x, '(\.\.\.|…)[ \t\r]*$')]) <= 3 * len(l) as kept from b""")
def op13(spark, folder):
    return quality_rules.judge_quality(table(spark, folder, "documents"))
