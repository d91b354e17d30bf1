"""Names in texts against plain Python, with common words that start many names."""
from __future__ import annotations

import random
import re

from caseweave.operators.extraction import tag_gazetteer

WORD = re.compile(r"[^\s.,;:!?()\[\]\"]+(?:\.[^\s.,;:!?()\[\]\"]+)*")


def brute(text, names, max_words=3):
    tokens = list(WORD.finditer(text))
    hits = []
    for i, first in enumerate(tokens):
        for n in range(1, max_words + 1):
            if i + n <= len(tokens):
                label = text[first.start():tokens[i + n - 1].end()]
                if " ".join(label.lower().split()) in names:
                    hits.append((first.start(), tokens[i + n - 1].end(), label))
    hits.sort(key=lambda h: (h[0], -h[1]))
    kept, reach = [], -1
    for start, end, label in hits:
        if end > reach:
            kept.append((start, label))
        reach = max(reach, end)
    return kept


def test_common_first_words(spark):
    random.seed(5)
    pool = ["the", "the", "The", "red", "fox", "inn", "old", "mill", "a.b", "Zoë"]
    names = {"the red fox", "the old", "fox inn", "old mill inn", "mill", "the zoë", "a.b the", "absent name", "red fox inn old"}
    texts = {str(k): "".join(random.choice(pool) + random.choice([" ", "  ", ", ", ". ", "\n", " ("]) for _ in range(120)) for k in range(6)}
    texts |= {"long": "the fox, " * 20_000 + "the red fox", "empty": "", "none": None}
    units = spark.createDataFrame([("K", k, 0, t, "x") for k, t in texts.items()], "case_id string, doc_id string, unit_index long, text string, type string")
    table = spark.createDataFrame([(n, "Place") for n in sorted(names)] + [("the old", "Vessel"), (None, "Place"), ("", "Place")], "name string, type string")
    _, mentions = tag_gazetteer(units.select("case_id", "doc_id", "unit_index", "text"), table)
    got = {}
    for r in mentions.collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["label"]))
    want = {k: brute(t, names - {"red fox inn old"}) for k, t in texts.items() if t}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert got["long"] == [(180_000, "the red fox")]
    assert {r["type"] for r in mentions.select("type").distinct().collect()} == {"Place"}
    empty = tag_gazetteer(units.select("case_id", "doc_id", "unit_index", "text"), table.limit(0))[1]
    assert empty.count() == 0
