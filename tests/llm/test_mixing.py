import re

import numpy as np
import pytest

from caseweave.llm import mixing


def targets(rows, cap=3.0):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return sizes, {s: cap * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def some_rows(n=400):
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rnd.lognormal(3, 1))), ["big", "big", "b", "C", None, "é", "tiny"][min(6, int(rnd.integers(0, 60)) // 9)]) for i in range(n)]
    return rows + [(900, "only these few words", "rare"), (901, None, "rare"), (902, "", "empty"), (903, "   x\t", "rare"),
                   (7000, "a very long one " * 5000, "big")]


def test_sources_come_near_their_targets(docs):
    rows = some_rows()
    sizes, want = targets(rows)
    found = mixing.mix(docs(rows)).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs(rows[::-1])).collect()}
    assert len(found) == len(rows) and {(r["doc_id"], r["taken"]) for r in found} == again
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")) and r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for source in sizes:
        taken = sum(r["taken"] for r in found if r["source"] == source)
        large = max(r["size"] for r in found if r["source"] == source)
        assert abs(taken - want[source]) <= max(2, 0.5 * large if source == "big" else 0.02 * sizes[source]), (source, taken, want[source])


def test_repeated_rows_and_empty_tables(docs):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s"), (None, "d e f", None)]
    found = {(r["doc_id"], r["source"], r["size"]): r["rows"] for r in mixing.mix(docs(rows)).collect()}
    assert found == {(1, "s", 2): 2, (1, "s", 1): 1, (None, None, 3): 1}
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None, "s"), (2, "", "t")])).agg({"taken": "sum"}).first()[0] == 0


def test_mix_repeats_whole_rows(docs):
    rows = some_rows(120)
    table = docs(rows)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    got = mixing.apply_mix(table)
    assert got.columns == table.columns
    counts = {}
    for r in got.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {k: v for k, v in want.items() if v}


def test_flight_keeps_both_totals():
    rnd = np.random.default_rng(8)
    size, chance = rnd.integers(1, 500, 300).astype(float), rnd.random(300)
    p = mixing.flight(size, chance, rnd.random(300))
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert p.sum() == pytest.approx(chance.sum()) and p @ size == pytest.approx(chance @ size)
    picked = np.mean([mixing.flight(size[:9], np.full(9, 0.3), rnd.random(9)) for _ in range(4000)], axis=0)
    assert np.abs(picked - 0.3).max() < 0.04


def test_many_blocks_do_not_depend_on_row_order(spark, docs):
    rnd = np.random.default_rng(6)
    rows = [(i if i % 50 else None, f"t{i} " + "w " * int(rnd.integers(1, 90)), "big" if i % 10 else "small") for i in range(9000)]
    taken = []
    for table in (docs(rows), docs(rows[::-1]).repartition(5)):
        taken.append(sorted((r["text_key"], r["copies"]) for r in mixing.mix(table).collect()))
    assert taken[0] == taken[1]
