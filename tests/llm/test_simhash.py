import random

import numpy as np
import xxhash

from caseweave.llm import simhash
from caseweave.llm.common import components


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((doc, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def some_rows():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdeé", k=5)) for _ in range(400)]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one TWO"), (105, "word " * 20000)]
    for g in range(6):
        base = rnd.choices(words, k=300)
        for c in range(6):
            copy = list(base)
            for _ in range(c):
                copy[rnd.randrange(300)] = rnd.choice(words)
            rows.append((g * 10 + c, " ".join(copy)))
    return rows + [(7, "repeated id"), (7, "repeated id"), (None, "no id at all")]


def test_components_equal_brute_force(docs):
    rows = some_rows()
    found = simhash.near_duplicates(docs(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(rows)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_document_of_each_stays(docs):
    rows = some_rows()
    table = docs(rows)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(c) for _, _, c in brute(rows)})


def test_bucket_links_join_what_all_pairs_join():
    rnd = np.random.default_rng(1)
    centre = rnd.integers(-2 ** 62, 2 ** 62, 3)
    fp = np.unique(np.concatenate([c ^ (1 << rnd.integers(0, 62, 40)) ^ (1 << rnd.integers(0, 62, 40)) for c in centre]))
    for size in (3, 12, 13, len(fp)):
        part = fp[:size]
        a, b = simhash._bucket_links(np.zeros(size, np.int64), part)
        links = {i: i for i in part.tolist()}
        every = dict(links)
        def root(table, x):
            while table[x] != x:
                x = table[x]
            return x
        for x, y in zip(a.tolist(), b.tolist()):
            assert bin((x ^ y) & (2 ** 64 - 1)).count("1") <= 4
            links[root(links, x)] = root(links, y)
        for x in part.tolist():
            for y in part.tolist():
                if bin((x ^ y) & (2 ** 64 - 1)).count("1") <= 4:
                    every[root(every, x)] = root(every, y)
        assert len({root(links, x) for x in links}) == len({root(every, x) for x in every})


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 299), (300, 299), (None, 5)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 300: 299, 299: 299}


def test_one_row_of_each_component_stays_without_an_id_too(docs):
    rows = [(None, "alpha beta gamma"), (None, "delta epsilon zeta"), (None, "delta epsilon zeta"), (7, "eta theta iota"),
            (None, "eta theta iota"), (8, "kappa lambda mu"), (8, "nu xi omicron"), (9, "nu xi omicron")]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(rows)).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[3], rows[5], rows[6]], key=str)
