"""Predicted links without a table of the pairs around nodes."""
from caseweave.operators import links as K


def test_pairs_are_not_written_where_every_link_is_heavy(spark, monkeypatch):
    rows = []

    def counted(df, name="step", settle=K.settle):
        table = settle(df, name)
        rows.append(table.count())
        return table
    monkeypatch.setattr(K, "settle", counted)
    edges = spark.range(120 * 12).selectExpr("'K' case_id", "concat('c', id div 12) source", "concat('s', id * 7 % 40) target")
    found = K.predict_links(edges, 5).collect()
    assert len(found) == 5 * 160 and max(rows) <= 2 * 120 * 12


def test_lists_in_pieces_give_the_same(spark, monkeypatch):
    edges = spark.range(400).selectExpr("'K' case_id", "concat('c', id % 37) source", "concat('s', id * 5 % 23) target")
    whole = sorted(map(tuple, K.predict_links(edges, 4, 0.4).collect()))
    monkeypatch.setattr(K, "LIST", 3)
    assert sorted(map(tuple, K.predict_links(edges, 4, 0.4).collect())) == whole and whole
