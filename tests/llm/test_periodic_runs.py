import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from caseweave.llm import periodic_runs as P


def smallest_period(words):
    """By the failure function."""
    fail, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k - 1]
        k += words[i] == words[k]
        fail[i] = k
    return len(words) - fail[-1]


def plain_runs(words):
    found = set()
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and smallest_period(words[i:i + length]) == q:
                found.add((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    if rewrite and doc_id is not None and words:
        h = zlib.crc32(b"%d" % doc_id)
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def texts():
    r = random.Random(5)
    some = [None, "", " \t\r\n", "a", "a " * 23, "a " * 24, "a " * 25, "a b " * 12, "a b " * 11 + "a", "x " * 50 + "y " * 50,
            ("x " * 9 + "y ") * 9, ("x " * 30 + "y ") * 4, "a\x0bb\x0cc\x1cd " * 12, "é ü " * 30]
    for _ in range(150):
        parts = []
        for _ in range(r.choice([1, 2, 5])):
            base = [r.choice("abcd"[:r.choice([1, 2, 4])]) + (str(r.randrange(40)) if r.random() < .3 else "") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 16, 17, 33, 50]))]
            parts += (base * 12)[:int(len(base) * r.choice([1, 2.5, 3, 3.4, 5, 11]))]
            if r.random() < .4:
                parts += parts[-r.randrange(1, 40):]
        some.append(" ".join(parts))
    word = fib = "b"
    word, fib = "b", "a"
    for _ in range(11):
        word, fib = fib, fib + word
    some.append(" ".join(fib))  # many overlapping repetitions
    return some


def test_equals_plain_python(docs):
    rows = [(i, t) for i, t in enumerate(texts())] + [(40, "m n o " * 30), (40, "m n o " * 30), (None, "u v " * 40)]
    found = P.run_digests(P.periodic_runs(docs(rows), P.looped)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_row(i, t)) for i, t in rows)


def test_each_text_alone_and_grouped():
    split = [(t or "").split() for t in texts()]
    number = P.Numbers().__getitem__
    codes = [np.array([number(w) for w in some], dtype=np.int64) for some in split]
    together = P.find_runs(np.concatenate(codes), np.array([len(c) for c in codes]))
    for code, grouped in zip(codes, together):
        assert P.find_runs(code, np.array([len(code)])) == [grouped]
        assert [tuple(r) for r in grouped] == plain_runs(code.tolist())


def test_long_texts_take_no_pairs_of_occurrences():
    same = np.zeros(400_000, dtype=np.int64)
    assert P.find_runs(same, np.array([len(same)])) == [[P.Run(0, 400_000, 1)]]
    loop = np.resize(np.arange(70_000), 400_000)
    assert P.find_runs(loop, np.array([len(loop)])) == [[P.Run(0, 400_000, 70_000)]]


def test_operator_gives_spans_and_text(docs):
    row = P.periodic_runs(docs([(1, "start " + "a b " * 20 + "end")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 40, 2)] and row.collapsed == "start a b end"
    assert P.periodic_runs(docs([])).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_plain_python(spark, folder):
    from caseweave.llm.queries import QUERIES
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_periodic_runs"](spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted(plain_row(r.doc_id, r.text) for r in rows)
