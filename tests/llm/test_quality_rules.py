import random
import re

import pytest
from pyspark.sql import functions as F

from caseweave.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, dup = len(words), sum(map(len, words)), len(lines) - len(set(lines))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = n < 10 or 100 * len(covered) > 20 * n
    letters = sum(any(c.isalpha() for c in w) for w in words)
    bullets = sum(bool(re.match(r"[ \t]*[-*•][ \t]*[^\x20\x09-\x0D]", x)) for x in lines)
    dots = sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines)
    kept = (not failed and 3 * n <= chars <= 10 * n and 10 * symbols <= n and 10 * dup <= 3 * len(lines) and 10 * letters >= 8 * n
            and 10 * bullets <= 9 * len(lines) and 10 * dots <= 3 * len(lines))
    return n, chars, symbols, dup, len(covered), failed, kept


def texts():
    r = random.Random(3)
    some = [None, "", " \t\n\x0b\x0c\r ", "one", "\n\n", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 60, "é ü " * 20, "naïve 𝔘nicode " * 3]
    for _ in range(120):
        vocabulary = [r.choice(["the", "of", "word", "longer", "#tag", "a|b", "42", "…", "élan", "z..."]) + r.choice(["", "", "s", str(r.randrange(30))])
                      for _ in range(r.choice([3, 20, 200]))]
        some.append("".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\n", "\t", "\n- ", "\n* ", " ...\n", "\r\n"])
                            for _ in range(r.choice([5, 12, 60, 300]))))
    some.append("never the same " + " ".join(f"w{i}" for i in range(40_000)))
    some.append(" ".join(f"w{i % 9_000}" for i in range(40_000)))
    return some


def test_equals_plain_python(docs):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(7, "twice " * 12), (7, "twice " * 12), (None, "a document without an id has a text of ten words or so")]
    found = Q.judge_quality(docs(rows)).collect()
    assert len(found) == len(rows)
    got = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found)
    assert got == sorted((repr(i), *plain(t)) for i, t in rows)


def test_order_follows_rejection_per_cost_and_never_changes_the_verdict(docs):
    frame = docs([(i, t) for i, t in enumerate(texts()[:100])])
    slow = Q.Rule("slow", F.length(F.regexp_replace(F.repeat("text", 300), "[a-z]", "")) < 0)
    rules = [slow, *Q.default_rules()]
    order = Q.plan_cascade(frame, rules)
    assert [j.gain for j in order] == sorted((j.gain for j in order), reverse=True)
    assert order[-1].rejected == 0 and {j.rule.name for j in order} == {r.name for r in rules}
    measured = Q.measured(frame)
    ways = [measured.select("doc_id", Q.cascade(o).alias("kept")).orderBy("doc_id").collect() for o in (rules, rules[::-1], [j.rule for j in order])]
    assert ways[0] == ways[1] == ways[2]


def test_later_rules_are_not_looked_at(docs):
    frame = Q.measured(docs([(1, "### " * 3 + " ".join(f"word{i}" for i in range(20)))]))
    boom = Q.Rule("boom", F.raise_error(F.lit("looked at")).cast("boolean"))
    symbols = next(r for r in Q.default_rules() if r.name == "symbols")
    assert not frame.select(Q.cascade([symbols, boom]).alias("kept")).first().kept
    with pytest.raises(Exception, match="looked at"):
        frame.select(Q.cascade([boom, symbols])).collect()


def test_empty_table_and_kept_rows(docs):
    assert Q.judge_quality(docs([])).count() == 0
    good = " ".join(f"plain{i}" for i in range(30))
    frame = docs([(1, good), (2, None), (3, "too short"), (None, good)])
    kept = Q.keep_good(frame)
    assert kept.columns == frame.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "None"]
