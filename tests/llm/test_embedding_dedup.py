import numpy as np
import pytest

from caseweave.llm import embedding_dedup
from caseweave.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, h string, rep string, cell string"


def brute(rows, threshold=0.93):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)
    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
              and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out)


def some_rows(n=500, dim=8):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, dim))
    rows = [(i, (base[rnd.integers(40)] + 0.25 * rnd.normal(size=dim)).tolist(), int(rnd.integers(3))) for i in range(n)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)]
    return rows + [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [1.0, None] + [0.0] * (dim - 2), 1), (2003, [float("nan")] * dim, 1),
                   (2004, [float("inf")] + [0.0] * (dim - 1), 1), (2005, rows[0][1], None), (2006, rows[0][1][:5], rows[0][2]), (2007, [], 2),
                   (2008, (np.array(rows[1][1]) * 7).tolist(), rows[1][2])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, None, None, None) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # 16: many cells, many blocks
    rows = some_rows()
    found = near_vectors(frame(spark, rows))
    assert sorted(tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)


def test_no_vectors(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors(frame(spark, [(3, None, None)])).collect()] == [(3, 0, 3, True)]


def test_vectors_without_an_id_come_back(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (5, [0.01, 1.0], 1), (None, [1.0, 0.0], 2),
            (6, [1.0, 0.0], 3), (6, [0.0, 1.0], 3), (7, [0.01, 1.0], 3)]
    found = near_vectors(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted([
        (None, 1, None, True), (None, 1, None, True), (None, 1, 5, False), (5, 1, 5, True), (None, 0, None, True),
        (6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False)], key=str)
