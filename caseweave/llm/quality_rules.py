"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample.

Only built-in functions: a document is measured and judged within its own row, without a shuffle.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut, fresh

BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
#: About so many rows are sampled to time the rules.
SAMPLE_ROWS = 4_000
LEAST_SECONDS = 1e-3


class Rule(NamedTuple):
    """A rule rejects a document where ``rejects`` holds; it may read the columns text and those of ``base_measures``."""
    name: str
    rejects: Column


class Judged(NamedTuple):
    """A rule with its seconds on the sample and the share of the sample that it rejects."""
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, LEAST_SECONDS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body's inner lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+", -1))


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more. Windows are compared by 64-bit hashes;
    a text without equal hashes ends there, others sort (hash, place) once: n log n whatever repeats."""
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda z: F.filter(z, lambda x, i: (x["h"] == F.get(z, i - 1)["h"]).eqNullSafe(True)
                                               | (x["h"] == F.get(z, i + 1)["h"]).eqNullSafe(True)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
                           lambda a: a["n"])
    hashes = let(words, lambda w: F.when(F.size(w) > width, F.transform(
        F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))))
    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0)).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {"n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(f"[{BLANK}]"))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_window_words(split_words(text))}


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules in use for web text, with their usual limits; each looks at what does not depend on the language."""
    count = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern))
    lines = count(rf"(?md)^[^\n]*?[^{BLANK}]")
    return [
        Rule("mean_word_length", (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words"))),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        # words without any letter
        Rule("letters", 10 * count(rf"(?<![^{BLANK}])[^{BLANK}\p{{L}}]*+\p{{L}}") < 8 * F.col("n_words")),
        Rule("bullets", 10 * count(rf"(?md)^[ \t]*+[-*•][ \t]*+[^{BLANK}]") > 9 * lines),
        Rule("ellipses", 10 * count(r"(?md)(?:\.\.\.|…)[ \t\r]*+$") > 3 * lines),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the base measures."""
    text, = fresh(docs.select("doc_id", "text"), "body")
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias(text)).select(
        "doc_id", F.col(text).alias("text"), *[c.alias(n) for n, c in base_measures(F.col(text)).items()]))


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Judged]:
    """The rules by rejection per second, best first, as seen on a sample of about ``sample_rows`` documents.

    The sample is drawn by a hash of doc_id and text and stays in the checkpoint folder. Of the order only the running
    time depends on it, so that a noisy clock cannot change a result. Rules that reject alike keep their given order;
    without documents all do.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = cut(measured(docs.select("doc_id", "text").where(F.lit(share >= 1) | drawn)))

    def run(rejects: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        n, bad = sample.agg(F.count("*"), F.count_if(rejects)).first()
        return time.perf_counter() - began, n, bad

    run(F.lit(False))
    idle = min(run(F.col("n_words") < -1)[0] for _ in range(2))
    found = []
    for rule in rules:
        times = [run(rule.rejects) for _ in range(2)]
        _, n, bad = times[0]
        found.append(Judged(rule, max(min(t for t, _, _ in times) - idle, LEAST_SECONDS), bad / n if n else 0.0))
    return sorted(found, key=lambda j: -j.gain)


def cascade(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects; a rule is looked at only where those before it let the document pass."""
    verdict = F.when(base_failed(), False)
    for rule in rules:
        verdict = verdict.when(rule.rejects, False)
    return verdict.otherwise(True)


def judge_quality(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    A null or empty text has no words and fails; a null doc_id is judged like any other; repeated rows are judged each
    time; a text of any length is judged whole, in n log n time; an empty table gives no rows. Other columns of docs are
    not read, so their names cannot clash.
    """
    order = [j.rule for j in plan_cascade(docs, default_rules() if rules is None else rules, sample_rows)]
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 base_failed().alias("base_failed"), cascade(order).alias("kept"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all their columns, that the cascade keeps."""
    order = [j.rule for j in plan_cascade(docs, default_rules() if rules is None else rules, sample_rows)]
    body, verdict = fresh(docs, "body", "verdict")
    facts = F.struct(F.col(body).alias("text"), *[c.alias(n) for n, c in base_measures(F.col(body)).items()])
    row, = fresh(docs, "measures")
    judged = docs.withColumn(body, F.coalesce("text", F.lit(""))).select(F.struct(*docs.columns).alias(row), facts.alias("m"))
    return judged.select(row, "m.*").where(cascade(order)).select(f"{row}.*")
