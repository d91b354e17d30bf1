import hashlib

from caseweave.llm import exact_dedup

LONG = "Long text of many words and lines.\n" * 4000


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower(text), []).append(doc)
    out, nameless = [], set()
    for doc, text in rows:
        ids = groups[lower(text)]
        keep = max((i for i in ids if i is not None), default=None)
        kept = doc == keep if keep is not None else lower(text) not in nameless
        if keep is None:
            nameless.add(lower(text))
        out.append((doc, keep, len(ids), kept, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_brute_force(docs):
    rows = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, LONG), (7, LONG.upper()), (8, LONG + "!"), (9, "É"), (10, "é"),
            (11, "x" * 9000), (12, "x" * 9001), (13, "x" * 9000), (14, "same"), (14, "same"), (15, "\n"), (16, "\n\n"), (None, "nobody's"), (None, "Nobody's"), (None, "same")]
    found = exact_dedup.duplicate_groups(docs(rows))
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(rows)
    assert exact_dedup.duplicate_groups(docs([])).count() == 0


def test_chunks_give_the_text_back(spark, docs):
    from pyspark.sql import functions as F
    texts = ["", "a", LONG, "é" * 10000, "a b" * 3000, "\n" * 600]
    rows = docs([(i, t) for i, t in enumerate(texts)]).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert "".join(r["c"]) == texts[r["doc_id"]] and all(0 < len(c) <= 4096 for c in r["c"])


def test_hash_collisions_are_told_apart(spark):
    parts = spark.createDataFrame([(7, bytearray(b"a")), (7, bytearray(b"b")), (8, bytearray(b"a"))], "id bigint, digest binary")
    assert sorted((r["id"], r["variant"]) for r in exact_dedup.verified_ids(parts).collect()) == [(7, 0), (7, 1), (8, 0)]
