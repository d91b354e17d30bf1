import itertools
import random
import zlib

import numpy as np

from caseweave.llm import toxicity

BAD = ["vile", "nasty", "rotten"]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeiostrn", k=rnd.randrange(2, 7))) for _ in range(500)]
    rows = []
    for i in range(n):
        text, bad = rnd.choices(words, k=rnd.randrange(5, 120)), i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(BAD).capitalize() + rnd.choice(["", ",", "!"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_scores_and_spans(spark, docs):
    rows = corpus(900)
    texts = [(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "quiet " * 50000 + "vile nasty rotten"), (0, "again"), (None, "vile nasty rotten")]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (99999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs(texts), labels, max_rows=400)
    found = toxicity.score_toxicity(docs(texts), model).withColumn("held", toxicity.held_out()).collect()
    assert len(found) == len(texts)
    label = {i: y for i, _, y in rows}
    held = [r for r in found if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held"] for r in held) and sum(r["held"] for r in found if r["doc_id"] in label) == len(held)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[2000]["score"] == by[2001]["score"] < 0.5 and by[2002]["predicted"] == 1 and by[None]["predicted"] == 1
    for r in found:
        text = dict((i, t) for i, t in texts if i != 0).get(r["doc_id"])
        for s in r["toxic_spans"] if text else []:
            assert text.encode()[s["start"]:s["end"]].lower().strip(toxicity.STRIP).decode() in BAD


def test_held_out_rows_are_not_learnt_from(spark, docs):
    rows = corpus(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    table = docs([(i, t) for i, t, _ in rows])
    models = [toxicity.train_toxicity(table, spark.createDataFrame(x, "doc_id bigint, toxic int"))
              for x in ([(i, y) for i, _, y in rows], flipped)]
    assert models[0].kinds == models[1].kinds and np.array_equal(models[0].document, models[1].document)


def test_no_labels_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs([(1, "a")]), none)
    assert [r["score"] for r in toxicity.score_toxicity(docs([(1, "a"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert toxicity.score_toxicity(docs([]), model).count() == 0


def test_filter_keeps_rows_as_they_are(spark, docs):
    rows = corpus(400)
    table = docs([(i, t) for i, t, _ in rows] + [(None, None)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    kept = toxicity.drop_toxic(table, labels)
    assert kept.schema == table.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert None in ids and len(ids ^ ({i for i, _, y in rows if not y} | {None})) <= 4


def test_marginals_equal_all_tag_sequences():
    rnd = np.random.default_rng(2)
    model = toxicity.Model(emission=rnd.normal(size=3 * toxicity.KINDS), transition=rnd.normal(size=(2, 2)))
    tagger = toxicity.Tagger(model)
    for kind in ([0, 0, 2, 0, 0, 0, 1, 3, 0], [1], [0, 4], [5, 0, 0, 0, 0, 0, 0, 6]):
        kind = np.array(kind, np.int8)
        total, marks = 0.0, np.zeros(len(kind))
        for tags in itertools.product((0, 1), repeat=len(kind)):
            w = sum(tagger.weight(int(kind[i]), int(kind[i - 1]) if i else 0, int(kind[i + 1]) if i + 1 < len(kind) else 0)
                    for i, t in enumerate(tags) if t)
            w = np.exp(w + sum(model.transition[a, b] for a, b in zip(tags, tags[1:])))
            total, marks = total + w, marks + w * np.array(tags)
        at, got = tagger.marginals(kind)
        assert np.allclose(got, (marks / total)[at])


def test_a_row_without_id_is_not_held_out(docs):
    frame = docs([(None, "x"), (1, "y")]).withColumn("held", toxicity.held_out())
    assert {r.doc_id: r.held for r in frame.collect()} == {None: False, 1: zlib.crc32(b"1") % 3 == 1}
