import random
import re

import pytest
from pyspark.sql import functions as F

from caseweave.functions import fixed_values as V
from caseweave.functions import identifiers as I
from caseweave.functions import scoring as S
from caseweave.functions import text as X


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


VECTORS = [
    (I.normalize_phone, "+91 98765 43210", "+919876543210"), (I.normalize_phone, "09876543210", "+919876543210"),
    (I.normalize_phone, "919876543210", "+919876543210"), (I.normalize_phone, "+14155552671", "+14155552671"),
    (I.normalize_phone, "12345", None), (I.normalize_phone, "5876543210", None), (I.normalize_phone, "", None),
    (I.normalize_vehicle, "DL 8C AB 1234", "DL8CAB1234"), (I.normalize_vehicle, "22bh1234aa", "22BH1234AA"),
    (I.normalize_vehicle, "ABC", None), (I.normalize_upi, "User.Name@OkHdfcBank", "user.name@okhdfcbank"),
    (I.normalize_upi, "9876543210@paytm", "9876543210@paytm"), (I.normalize_upi, "not-a-upi", None),
    (I.normalize_account, "001234567890", "001234567890"), (I.normalize_account, "pat/2029", "PAT/2029"),
    (I.normalize_account, "ABCDEF", None), (I.normalize_ifsc, "hdfc0001234", "HDFC0001234"),
    (I.normalize_ifsc, "HDFC1001234", None), (I.luhn_ok, "490154203237518", True), (I.luhn_ok, "490154203237519", False),
    (I.luhn_ok, "4111111111111111", True), (I.luhn_ok, "0", False), (I.squeeze, "  a \n b\t", "a b"),
    (I.norm_header, "From_Number #1", "fromnumber1"), (I.valid_call_number, "+44 (20) 7946-0958", True),
    (I.valid_call_number, "1.5E+9", False), (I.valid_case_id, "CASE-1_a", True), (I.valid_case_id, "a/b", False),
    (S.parse_duration, "12.5", 12.5), (S.parse_duration, "-1", None), (S.parse_amount, "5,000.00", "5000.00"),
]


@pytest.mark.parametrize("fn", sorted({v[0] for v in VECTORS}, key=lambda f: f.__name__), ids=lambda f: f.__name__)
def test_scalar_vectors(spark, fn):
    mine = [v for v in VECTORS if v[0] is fn]
    assert values(spark, fn, [v[1] for v in mine]) == [v[2] for v in mine]


def test_normal_forms_and_ids(spark):
    kind = lambda k: (lambda c: I.normalized(I.nfkc(c), F.lit(k)))
    assert values(spark, kind("Person"), ["Dr. Ａnn   LEE", "Inspector Rao"]) == ["ann lee", "rao"]
    assert values(spark, kind("Phone"), ["98765 43210", "12-34"]) == ["+919876543210", "1234"]
    got = values(spark, lambda c: I.entity_id(c, F.lit("Phone")), ["+919876543210"])
    assert got == ["phone:753b085b454e1df347443583"]


def test_entity_validity(spark):
    def check(kind, labels):
        return values(spark, lambda c: I.valid_entity(c, F.lit(kind)), labels)
    assert check("Person", ["Alex Example", "the", "Case", "A1", "x", "Section 4", "v1.2", "a" * 81, "*", "R2D2"]) == \
        [True] + [False] * 9
    assert check("Organization", ["Example Ltd", "b" * 101, "report"]) == [True, False, False]
    assert check("IMEI", ["490154203237518", "490154203237519"]) == [True, False]
    assert check("Account", ["1234", "12", "ab1c"]) == [True, False, True]


def test_spans_match_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1é \n.!") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", "a" * 5000]
    for pattern in (r"a+", r"[.!]", r"b1|é"):
        got = values(spark, lambda c: X.find_spans(c, pattern), texts)
        want = [[(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)] for t in texts]
        assert [[tuple(x) for x in row] for row in got] == want


def python_sentences(text):
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)|\n\s*\n", text):
        if m.group() == ".":
            word = re.search(r"[A-Za-z]+$", text[:m.start()])
            if word and (len(word.group()) == 1 or word.group().lower() in V.ABBREVIATIONS):
                continue
        out.append((start, m.end()))
        start = m.end()
    return out + ([(start, len(text))] if start < len(text) else [])


def test_sentences_match_brute_force(spark):
    rng = random.Random(5)
    pieces = ["Dr. ", "A. ", "Phone no. 5 ", "called", "! ", "? ", ". ", ".\n\n", "\n \n", "Prof.", " xdr. ", "é. ", "v", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = values(spark, X.sentences, texts)
    assert [[tuple(x) for x in row] for row in got] == [python_sentences(t) for t in texts]


def test_chunks_cover_whole_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["word ", "end. ", "x" * 30, "\n\n"]) for _ in range(n)) for n in (0, 3, 40, 400)]
    got = values(spark, lambda c: X.chunk(c, 200, 20), texts)
    for text, chunks in zip(texts, got):
        assert (not text and not chunks) or (chunks[0]["start"] == 0 and chunks[-1]["end"] == len(text))
        for a, b in zip(chunks, chunks[1:]):
            assert a["start"] < b["start"] <= a["end"] and b["end"] > a["end"]
        assert all(c["end"] - c["start"] <= 200 for c in chunks)
        for c in chunks[:-1]:
            window = text[max(c["start"] + 1, min(c["start"] + 200, len(text)) - 20):c["start"] + 200]
            assert c["clipped"] == (not re.search("|".join(V.CHUNK_ENDS).replace(r"\z", "$"), window))
    with pytest.raises(ValueError):
        X.chunk(F.lit("x"), 1, 0)


def test_pack_is_greedy(spark):
    df = spark.createDataFrame([([5, 5, 1, 20, 1, 9],), ([],)], "c array<int>")
    assert [list(r[0]) for r in df.select(X.pack(F.col("c"), 10)).collect()] == [[0, 0, 1, 2, 3, 3], []]


def test_snippet_bounds(spark):
    got = values(spark, lambda c: X.snippet(c, F.lit(3), F.lit(5)), ["abcdefgh" * 40])
    assert got == [("abcdefgh" * 40)[0:105]]


def test_prefix_context(spark):
    got = values(spark, X.prefix_context, ["On 18 September 2026, ", "The witness stated that ", "Another Person said ",
                                           "On the officer ", "of the " * 20000, "on " + "of " * 20000])
    assert [(r["safe"], r["reported"]) for r in got[:4]] == [(True, False), (True, True), (False, False), (True, False)]


def test_long_runs_do_not_overflow_the_regex_stack(spark):
    long = "a.b" * 50000
    from caseweave.operators.extraction import TOKEN
    assert len(values(spark, lambda c: X.find_spans(c, X.rule_regex(TOKEN)), [long])[0]) == 1
    assert values(spark, X.sentences, ["word. " * 20000])[0][-1]["end"] == 120000
