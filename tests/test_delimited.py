import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from caseweave.sources.delimited import read_delimited


def plain(text, sep):
    """Rows, and the first line of each, as the standard library reads them."""
    reader, rows, line = csv.reader(io.StringIO(text, newline=""), delimiter=sep), [], 0
    for cells in reader:
        rows.append((cells, line + 1))
        line = reader.line_num
    return rows


def got(spark, path, sep=None):
    rows = read_delimited(spark, str(path), "c", sep).orderBy("unit_index").collect()
    assert [r["row_number"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["cells"], r["line_number"]) for r in rows]


def test_random_tables_in_many_splits(spark, tmp_path):
    """Quotes, separators and breaks of all kinds inside cells; splits far smaller than the file."""
    pick = random.Random(7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for trial, (sep, end) in enumerate([(",", "\n"), (";", "\r\n"), ("\t", "\n"), ("|", "\r")]):
            out = io.StringIO(newline="")
            writer = csv.writer(out, delimiter=sep, lineterminator=end)
            for _ in range(400):
                writer.writerow(["".join(pick.choice(['a', 'b', '"', ",", ";", "\n", "\r\n", "\r", " ", "é", "\t", "|"]) for _ in range(pick.randrange(9)))
                                 for _ in range(pick.randrange(1, 5))])
            text = out.getvalue()
            path = tmp_path / f"t{trial}.csv"
            path.write_bytes(text.encode())
            assert got(spark, path, sep) == plain(text, sep)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_loose_quotes_blank_lines_and_open_ends(spark, tmp_path):
    cases = ['a,b\n\n5" pipe,x\n"q" tail,y\n', 'x\n"never closed,\nrest\nof file', '\ufeffid,v\n"1","""quoted"""\n', '"",""\n,\n"",x\n']
    for n, text in enumerate(cases):
        path = tmp_path / f"l{n}.csv"
        path.write_bytes(text.encode())
        assert got(spark, path, ",") == plain(text.lstrip("\ufeff"), ",")
    rows = read_delimited(spark, str(tmp_path / "l0.csv"), "c", ",").orderBy("unit_index").collect()
    assert [r["malformed"] for r in rows] == [False, False, False, True]
    assert [r["malformed"] for r in read_delimited(spark, str(tmp_path / "l1.csv"), "c", ",").orderBy("unit_index").collect()] == [False, True]
    (tmp_path / "empty.csv").write_text("")
    assert got(spark, tmp_path / "empty.csv") == []
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "l0.csv"), "c", "#")


def test_separators_are_found_per_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id;amount,with\n1;2\n3;4\n")
    (folder / "b.tsv").write_text("id\tname\n1\t\"a,b,c\"\n")
    (folder / "c.csv").write_text("id|x\n1|2\n")
    (folder / "e.csv").write_text('1;"some, text\nover, lines, 5"\n2;"more, of\nthe, same"\n3;x\n')
    (folder / "d.tsv").write_text("one\ntwo\n")
    rows = read_delimited(spark, str(folder), "c").withColumn("f", F.element_at(F.split("doc_id", "/"), -1)).collect()
    cells = {(r["f"], r["unit_index"]): r["cells"] for r in rows}
    assert cells["a.csv", 0] == ["id", "amount,with"] and cells["b.tsv", 1] == ["1", "a,b,c"]
    assert cells["c.csv", 1] == ["1", "2"] and cells["d.tsv", 1] == ["two"]
    assert cells["e.csv", 1] == ["2", "more, of\nthe, same"] and cells["e.csv", 2] == ["3", "x"]


def test_wide_rows_and_long_cells(spark, tmp_path):
    wide, long = [str(i) for i in range(5000)], 'line "one"\n' * 20000
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([wide, ["k", long], ["z"]])
    (tmp_path / "w.csv").write_bytes(out.getvalue().encode())
    assert [c for c, _ in got(spark, tmp_path / "w.csv", ",")] == [wide, ["k", long], ["z"]]
