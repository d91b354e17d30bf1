import os
import re

import pytest

import corpus_pipeline
from caseweave.llm import packing, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_stages_equal_plain_python(spark):
    line, sim, mixed = _helpers()
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    tagger = toxicity.Tagger(toxicity.train_toxicity(table, labels))
    rows = [r for r in rows if tagger.score((r[1] or "").encode())[0] < 0.7]
    text = {d: t for d, t, *_ in line.brute([(d, t) for d, t, _ in rows])}
    rows = [(d, text[d], s) for d, _, s in rows]
    keep = {c for _, _, c in sim.brute([(d, t) for d, t, _ in rows])}
    rows = [r for r in rows if r[0] in keep]
    sizes, want = mixed.targets(rows)

    found = corpus_pipeline.run(spark, FOLDER).collect()
    times, length = {}, {}
    for r in found:
        if r["piece"] == 0:
            times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r[0] for r in rows} and max(times.values()) <= 3
    with open(corpus_pipeline.tokenizer_path(), encoding="utf-8") as file:
        coder = packing.WordEncoder(file.read())
    for (doc, body, _), ids in zip(rows, coder.encode([(r[1] or "").encode() for r in rows])):
        length[doc] = len(ids) // 4 + 1
    packed = {}
    for r in found:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {d: n * length[d] for d, n in times.items()}
    for source, target in want.items():
        own = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows if s == source]
        assert abs(sum(times.get(d, 0) * n for d, n in own) - target) <= max(n for _, n in own)


def _helpers():
    import sys
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    import test_line_dedup
    import test_mixing
    import test_simhash
    return test_line_dedup, test_simhash, test_mixing


def test_stages_keep_the_columns(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet") if os.path.isdir(FOLDER) else pytest.skip("test tables are not here")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == table.columns, name
