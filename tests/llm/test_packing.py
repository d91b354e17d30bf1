import random
import zlib

import numpy as np
import pytest

from caseweave.llm import packing
from caseweave.llm.queries import tokenizer_path

TEXTS = ["The quick  brown FOX, it's 42!", "", None, "<|endoftext|> <|ENDOFTEXT|> É é ß İ", "word " * 5000, "x" * 30000,
         "áb café… 中文 n't", "same", "same", " \n\t "]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, rows):
    out = []
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(doc, n // 2048, n, len(ids[n:n + 2048]), zlib.crc32(ids[n:n + 2048].tobytes())) for n in range(0, len(ids), 2048)]
    return sorted(out, key=str)


def test_pieces_and_sequences(docs, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "repeated id"), (3, "repeated id"), (None, "no id")]
    found = packing.pack_documents(docs(rows), tokenizer_path()).collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == expected(tokenizer, rows)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(docs):
    assert packing.pack_documents(docs([]), tokenizer_path()).count() == 0


def plain_best_fit(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - length)
        else:
            room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_over_items(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 64, 2048])
    lengths = [min(capacity, max(1, int(rnd.expovariate(3 / capacity)))) for _ in range(rnd.choice([1, 50, 700]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_best_fit(histogram, capacity)
    assert {n: int(plan[plan[:, 0] == n][:, 2].sum()) for n in histogram} == histogram
    assert int((plan[:, 3] + -(-plan[:, 2] // plan[:, 4])).max()) == plain_best_fit(lengths, capacity)
    assert packing.plan_best_fit({}, capacity).shape == (0, 6)


def test_words_equal_the_whole_tokenizer(tokenizer):
    rnd = random.Random(5)
    letters = list("abcDEFÉéßıİſKΣσ’'.,!-_019٣½ \u0085\t\ń̈中ªº") + [
        "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'RE", "</w>"]
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(25))) for _ in range(3000)]
    with open(tokenizer_path(), encoding="utf-8") as file:
        coder = packing.WordEncoder(file.read())
    for text, got in zip(texts, coder.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
