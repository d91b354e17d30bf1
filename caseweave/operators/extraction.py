"""Mentions and entities from text units."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.identifiers import (entity_id_from_value, identity_status, nfkc, normalized, squeeze,
                                     valid_entity)
from ..functions.text import find_spans, let, rule_regex, sentences, snippet

UNIT = ["case_id", "doc_id", "unit_index"]


def _mention_columns(found: DataFrame, method: str) -> DataFrame:
    """Add ids and snippet to (UNIT, text, type, start, end, label, normalized_value)."""
    return found.select(
        *UNIT, entity_id_from_value(F.col("normalized_value"), F.col("type"),
                                    F.concat(F.lit("case:"), F.col("case_id"))).alias("entity_id"),
        "label", "type", F.lit(method).alias("method"), "start", "end", "normalized_value",
        F.greatest(F.col("start") - 100, F.lit(0)).alias("snippet_start"),
        snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


def identifier_mentions(units: DataFrame, patterns=None) -> DataFrame:
    """Identifier spans of every text unit; one narrow pass, no shuffle.

    Validity and normal form are taken per pattern, where the kind is a literal,
    so each kind evaluates only its own rules.
    """
    patterns = patterns or V.IDENTIFIER_PATTERNS

    def typed(name, pattern, group):
        kind = F.lit(name)
        spans = find_spans(F.col("text"), rule_regex(pattern), group)
        valid = F.filter(spans, lambda s: valid_entity(s["value"], kind))
        return F.transform(valid, lambda s: F.struct(
            kind.alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("label"),
            normalized(s["value"], kind).alias("normalized_value")))

    found = F.concat(*[typed(*p) for p in patterns])
    return _mention_columns(units.select(*UNIT, "text", F.explode(found).alias("s")).select(*UNIT, "text", "s.*"),
                            "identifier-rule")


def entities_of_mentions(mentions: DataFrame) -> DataFrame:
    """One entity per (case, id): the first mention's label; combined map-side."""
    order = F.struct("doc_id", "unit_index", "start")
    return (mentions.groupBy("case_id", F.col("entity_id").alias("id"), "type", "normalized_value")
            .agg(F.min_by("label", order).alias("label"), F.count("*").alias("mention_count"))
            .withColumn("identity_status", identity_status(F.col("type"), F.lit("case:"))))


def extract_identifiers(units: DataFrame, patterns=None) -> tuple[DataFrame, DataFrame]:
    mentions = identifier_mentions(units, patterns)
    return entities_of_mentions(mentions), mentions


GAP = r"[\s.,;:!?()\[\]\"]"
TOKEN = r"[^\s.,;:!?()\[\]\"]++(?:\.(?=\S)[^\s.,;:!?()\[\]\"]++)*+"


def word_runs(text: Column, max_words: int) -> Column:
    """What starts at each word, as array<struct<start,word,runs>>: the word in lower case, and runs of one to max_words
    words as array<struct<end,label>>.  A label is pieced together from its words and the gaps between them, so a run
    costs its own length wherever it stands in the text."""
    def build(tokens: Column, pieces: Column) -> Column:
        def runs(i: Column) -> Column:
            lengths = F.filter(F.array(*[F.lit(n) for n in range(1, max_words + 1)]), lambda n: i + n <= F.size(tokens))
            return F.transform(lengths, lambda n: let(F.element_at(tokens, i + n), lambda last: F.struct(
                last["end"].alias("end"), F.concat(F.array_join(F.slice(pieces, i + 1, n - 1), ""), last["value"]).alias("label"))))
        return F.transform(tokens, lambda first, i: F.struct(
            first["start"].alias("start"), F.lower(first["value"]).alias("word"), runs(i).alias("runs")))

    pieces = F.regexp_extract_all(text, F.lit(rule_regex(f"{TOKEN}{GAP}*+")), F.lit(0))
    return let(find_spans(text, rule_regex(TOKEN)), lambda tokens: let(pieces, lambda p: build(tokens, p)))


def tag_gazetteer(units: DataFrame, names: DataFrame, max_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """Names of a (name, type) table found in the text, longest match first; of a name's types the smallest holds.

    A word of the text meets the first words of the names, one row a word, and only where a name can start do its runs of
    the lengths that such names have meet whole names.  So a common word, even one that starts a name, is a key of many
    rows against one in the first join, which splits or broadcasts, and never a key of whole names.  Only texts with a
    name come back for their snippets.  Null texts and names match nothing; names of more than max_words words are not
    looked for.
    """
    vocabulary = names.select(squeeze(F.lower("name")).alias("key"), "type").groupBy("key").agg(F.min("type").alias("type"))
    parts = vocabulary.select(F.regexp_extract_all("key", F.lit(rule_regex(TOKEN)), F.lit(0)).alias("w"))
    heads = (parts.filter(F.size("w").between(1, max_words)).groupBy(F.col("w")[0].alias("word"))
             .agg(F.collect_set(F.size("w")).alias("lengths")))  # at most max_words of them
    words = units.select(*UNIT, F.explode(word_runs(F.col("text"), max_words)).alias("r")).select(*UNIT, "r.*")
    runs = words.join(heads, "word").select(*UNIT, "start", F.explode(F.filter(
        "runs", lambda r, i: F.array_contains("lengths", i + 1))).alias("r")).select(*UNIT, "start", "r.*")
    hits = runs.withColumn("key", squeeze(F.lower("label"))).join(vocabulary, "key")
    # inside one text unit, drop a match that an earlier or longer one covers
    before = (Window.partitionBy("doc_id", "unit_index").orderBy("start", F.desc("end"))
              .rowsBetween(Window.unboundedPreceding, -1))
    outer = (hits.withColumn("covered", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False)))
             .filter(~F.col("covered")))
    valid = (outer.filter(valid_entity(F.col("label"), F.col("type")))
             .withColumn("normalized_value", normalized(nfkc(F.col("label")), F.col("type")))
             .join(units.select("doc_id", "unit_index", "text"), ["doc_id", "unit_index"]))
    mentions = _mention_columns(valid, "gazetteer")
    return entities_of_mentions(mentions), mentions


def sentence_rows(units: DataFrame) -> DataFrame:
    """One row per sentence of each text unit, with offsets in the unit."""
    return (units.select(*UNIT, "text", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "s"))
            .select(*UNIT, "sentence_index", F.col("s.start").alias("sentence_start"),
                    F.col("s.end").alias("sentence_end"),
                    F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence")))


def cooccurrence_violations(edges: DataFrame, sentences_df: DataFrame) -> DataFrame:
    """Narrative edges whose evidence lacks the connector its rule demands: always empty.

    An edge's evidence is compared with the wording between its endpoints, so an
    edge made from mere co-occurrence in a sentence would show here.
    """
    from .relations import compile_rules, connector_present
    return edges.join(sentences_df.select("doc_id", "unit_index", "sentence_start"),
                      ["doc_id", "unit_index", "sentence_start"], "left_semi").filter(
        ~connector_present(F.col("gap"), F.col("rule_id"), compile_rules()))
