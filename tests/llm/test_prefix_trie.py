import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from caseweave.llm import prefix_trie as T

TURN = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, shared=True):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            talks.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    talks = {c: [t[3:] for t in sorted(turns)] for c, turns in talks.items()}
    if shared:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in talks}
        talks = {c: talks.get(c - c % 20, [])[:h[c]] + turns[h[c]:] for c, turns in talks.items()}
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        parents = {k[:-1] for k in nodes if k}
        ends = ",".join(map(str, sorted(c for c in members if len(talks[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
                    sum(k[:-1] == key for k in nodes if k), sum(k not in parents for k in below),
                    sum((len(nodes[k]) - 1) * words(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, shared=True):
    frame = spark.createDataFrame(rows, TURN)
    for name in ("rep", "depth", "node", "block", "words", "part", "place", "n"):
        frame = frame.withColumn(name, F.lit("clash"))
    out = T.prefix_trie(*(T.with_shared_openings if shared else T.as_they_are)(frame))
    return sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                        "ends_sha256").collect()))


def talks(seed, conversations, turns, choices):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * conversations), conversations):
        for t in range(r.randrange(1, turns + 1)):
            rows.append((c, t if r.random() < .95 else None, r.choice(["user", "assistant", None]) if r.random() < .2 else ["user", "assistant"][t % 2],
                         r.choice(["hi there", "well then\nyes", "", None, "ok", "a b c d"][:choices])))
    return rows + r.sample(rows, len(rows) // 10)


@pytest.mark.parametrize("seed, conversations, turns, choices", [(1, 60, 3, 6), (2, 40, 12, 2), (3, 25, 30, 1)])
def test_equals_plain_python(spark, seed, conversations, turns, choices):
    rows = talks(seed, conversations, turns, choices) + [(None, 1, "user", "nobody's")]
    assert found(spark, rows, seed != 2) == plain(rows, seed != 2)


def test_turnless_conversations_and_empty_table(spark):
    rows = [(c, 0, "user", "one") for c in range(1, 20)]  # without conversation 0 those with h > 0 lose their turn
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_digests_tell_role_and_text_apart(spark):
    rows = [(1, 0, "a", "b c"), (2, 0, "a b", "c"), (3, 0, "", "ab c"), (4, 0, None, "ab c"), (5, 0, "ab c", None)]
    assert len(found(spark, rows, False)) == 1 + 4 and found(spark, rows, False) == plain(rows, False)


def test_frequent_keys_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 3)
    monkeypatch.setattr(T, "HOT_ROWS", 2)
    monkeypatch.setattr(T, "HOT_KEYS", 8)
    monkeypatch.setattr(T, "PIECE_IDS", 3)
    rows = [(c, t, "user", "same") for c in range(40) for t in range(6)]  # a large group of copies
    rows += [(c, t, "user", "same" if t < 3 else f"other {c}") for c in range(100, 120) for t in range(5)]  # one prefix, many children
    rows += [(200, t, "user", "same" if t < 70 else "end") for t in range(80)]
    assert found(spark, rows) == plain(rows)


def test_chains_of_chains_are_summed(spark):
    # conversation n leaves conversation n - 1 one turn before its end: the tree of chains is as high as it can be
    rows = [(n, t, "user", f"turn {t}" if t < n - 1 else f"end {n}") for n in range(1, 40) for t in range(n)]
    rows += [(n, n, "user", "tail") for n in range(1, 40)]
    assert found(spark, rows, False) == plain(rows, False)
