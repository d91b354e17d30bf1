"""Delimited text files as rows of cells, of any width, with line breaks inside quotes, read by many tasks per file.

A line alone does not tell whether it begins inside a quoted cell.  But it tells what it makes of either beginning: it ends
open, ends closed, keeps the state, or turns it around.  Those four compose, so the state at each line follows from the
lines that matter before it by running values in blocks (``operators.windows``), and no file has to be one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.iteration import settle
from ..operators.windows import number_rows, running_max, running_sum

#: Separators that are told apart, in order of preference where a file's head does not decide.
SEPARATORS = (",", ";", "\t", "|")
HEAD_LINES = 200
HEAD_CHARS = 65536
TERMINATOR = r"(?:\r\n|\n|\r)\z"


def _quoted(sep: str) -> tuple[str, str]:
    """Patterns of a complete cell and of a cell that is open at the end; possessive, so that long texts don't recurse."""
    s = "\\t" if sep == "\t" else "\\" + sep
    inside = r'(?:[^"]++|"")*+'
    return rf'(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+|)', rf'"{inside}\z'


def _by_separator(column: Column, value) -> Column:
    """value(separator) for the separator that the column holds."""
    out = F.lit(None)
    for sep in SEPARATORS:
        out = F.when(column == sep, value(sep)).otherwise(out)
    return out


def ends_open(line: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted cell; one that begins inside is judged with a quote before it."""
    whole, opened = _quoted(sep)
    s = "\\t" if sep == "\t" else "\\" + sep
    return line.rlike(rf"\A(?:{whole}{s})*+{opened}")


def split_cells(record: Column, sep: str) -> Column:
    """The cells of a record: quotes off, doubled quotes single, text behind a closing quote kept as it is. A blank record has none."""
    s = "\\t" if sep == "\t" else "\\" + sep
    inside = r'(?:[^"]++|"")*+'
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'{s}("{inside}(?:"[^{s}]*+|\z)|[^{s}]*+)'), F.lit(1))
    plain = lambda c: F.concat(F.regexp_replace(F.regexp_extract(c, rf'\A"({inside})', 1), '""', '"'),
                               F.regexp_extract(c, rf'\A"{inside}"([\s\S]*)', 1))
    cells = F.transform(found, lambda c: F.when(c.startswith('"'), plain(c)).otherwise(c))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(cells)


def is_malformed(record: Column, sep: str) -> Column:
    """Whether a quoted cell is never closed, or has text behind its closing quote."""
    s = "\\t" if sep == "\t" else "\\" + sep
    inside = r'(?:[^"]++|"")*+'
    return ~record.rlike(rf'\A(?:"{inside}"|[^"{s}][^{s}]*+|)(?:{s}(?:"{inside}"|[^"{s}][^{s}]*+|))*+\z')


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(doc_id, line_no from 0, text with its line break) of all files; breaks are \\r\\n, \\n and \\r.

    The lines are written once below the shared folder: their numbers come from counts per split, so the files would be read
    twice otherwise. Numbers don't depend on which task reads which split.
    """
    raw = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    # what a carriage return alone ends is a line of its own
    pieces = F.split("value", r"(?<=\r)(?!\z)")
    last = F.size("pieces") - 1
    lines = (raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("split"), pieces.alias("pieces"))
             .select("doc_id", "split", last.alias("last"), F.posexplode("pieces").alias("piece", "text"))
             .select("doc_id", "split", F.when(F.col("piece") == F.col("last"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"),
                     F.monotonically_increasing_id().alias("at")))
    lines = settle(lines, "lines")
    splits = lines.groupBy("doc_id", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("doc_id", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.join(offsets, ["doc_id", "split"]).select("doc_id", (F.col("at") + F.col("shift")).alias("line_no"), "text")
    mark = F.when(F.col("line_no") == 0, F.regexp_replace("text", "\\A\ufeff", "")).otherwise(F.col("text"))
    return numbered.withColumn("text", mark)


def find_separators(lines: DataFrame) -> DataFrame:
    """(doc_id, sep): of each file, the separator that the most lines of its head hold equally often outside quotes.

    The head is what the first 200 lines have within 65 536 characters. Ties go by the order of ``SEPARATORS``. A file whose
    head holds none has the tab where its name ends in .tsv, else the comma.
    """
    first = F.array_sort(F.collect_list(F.struct("line_no", F.substring("text", 1, HEAD_CHARS).alias("text"))))
    head = lines.filter(F.col("line_no") < HEAD_LINES).groupBy("doc_id").agg(
        F.substring(F.array_join(F.transform(first, lambda l: l["text"]), ""), 1, HEAD_CHARS).alias("head"))
    # quoted cells, over as many lines as they go; each leaves a mark so that its line is not blank
    bare = F.regexp_replace("head", r'(?<![^,;\t|\r\n])"(?:[^"]++|"")*+(?:"|\z)', "q")
    bare = head.select("doc_id", F.explode(F.split(bare, r"\r\n|\n|\r")).alias("line"))
    counts = bare.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(sep).alias("sep"), F.regexp_count("line", F.lit("\\t" if sep == "\t" else "\\" + sep)).alias("n"))
        for i, sep in enumerate(SEPARATORS)])).alias("c")).select("doc_id", "c.*").filter("n > 0")
    same = counts.groupBy("doc_id", "rank", "sep", "n").agg(F.count("*").alias("agree"))
    best = same.groupBy("doc_id").agg(F.max_by("sep", F.struct("agree", -F.col("rank"), "n")).alias("found"))
    named = F.when(F.lower("doc_id").endswith(".tsv"), "\t").otherwise(",")
    return lines.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("found", named).alias("sep"))


def join_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, sep, line_no of the first line, record) from lines with their separator: a quoted cell joins the lines it covers.

    Only lines that matter to the state, and lines of records of several lines, are sorted; others stand for themselves.
    A quote that is never closed takes the rest of its file, as one record.
    """
    outside = _by_separator(F.col("sep"), lambda s: ends_open(F.col("text"), s))
    inside = _by_separator(F.col("sep"), lambda s: ends_open(F.concat(F.lit('"'), F.col("text")), s))
    marked = lines.withColumns({"out": outside, "in": inside})
    # lines that set or turn the state take effect behind themselves: order 2n + 1; lines ask at 2n
    turns = marked.filter(F.col("out") | ~F.col("in")).select("doc_id", (2 * F.col("line_no") + 1).alias("order"), "out", "in")
    flip = (F.col("out") & ~F.col("in")).cast("int")
    turns = running_sum(turns, ["doc_id"], "order", {"flips": flip})
    turns = running_max(turns, ["doc_id"], "order", {"fixed": F.when(F.col("out") == F.col("in"), F.struct("order", "out", "flips"))})
    since = F.col("flips") - F.coalesce("fixed.flips", F.lit(0))
    turns = turns.select("doc_id", "order", (F.coalesce("fixed.out", F.lit(False)) != (since % 2 == 1)).alias("state"))
    ask = marked.withColumn("order", 2 * F.col("line_no")).unionByName(turns, allowMissingColumns=True)
    known = running_max(ask, ["doc_id"], "order", {"latest": F.when(F.col("state").isNotNull(), F.struct("order", "state"))})
    begins = F.coalesce("latest.state", F.lit(False))
    known = known.filter(F.col("line_no").isNotNull()).withColumn("begins_in", begins).withColumn(
        "ends_in", F.when(F.col("begins_in"), F.col("in")).otherwise(F.col("out")))
    known = settle(known.select("doc_id", "sep", "line_no", "text", "begins_in", "ends_in"), "states")
    alone = known.filter(~F.col("begins_in") & ~F.col("ends_in")).select("doc_id", "sep", "line_no", F.col("text").alias("record"))
    parts = running_max(known.filter(F.col("begins_in") | F.col("ends_in")), ["doc_id"], "line_no",
                        {"first": F.when(~F.col("begins_in"), F.col("line_no"))})
    several = parts.groupBy("doc_id", "sep", F.col("first").alias("line_no")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), "text"))), lambda p: p["text"]), "").alias("record"))
    return alone.unionByName(several)


def read_delimited(spark: SparkSession, path: str, case_id: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Row units of delimited files: case_id, doc_id, unit_index, kind 'row', cells, row_number, line_number, malformed.

    The header stays a row, identifiers keep their zeros, rows have the cells they have, however many, and a blank line is a
    row without cells. ``sep`` is one of ``SEPARATORS``; without it each file's own is found. row_number counts rows from 1
    and line_number is the row's first line. A row that is ``malformed`` (a quote never closed, text behind a closing quote)
    is read as far as it goes. An empty file gives no rows.
    """
    if sep is not None and sep not in SEPARATORS:
        raise ValueError(f"unknown separator {sep!r}; known: {SEPARATORS}")
    lines = read_lines(spark, path, encoding)
    lines = lines.withColumn("sep", F.lit(sep)) if sep else lines.join(find_separators(lines), "doc_id")
    records = join_lines(lines).withColumn("record", F.regexp_replace("record", TERMINATOR, ""))
    rows = number_rows(records, ["doc_id"], "line_no")
    return rows.select(
        F.lit(case_id).alias("case_id"), "doc_id", (F.col("row_number") - 1).cast("bigint").alias("unit_index"), F.lit("row").alias("kind"),
        _by_separator(F.col("sep"), lambda s: split_cells(F.col("record"), s)).alias("cells"), "row_number",
        (F.col("line_no") + 1).alias("line_number"),
        _by_separator(F.col("sep"), lambda s: is_malformed(F.col("record"), s)).alias("malformed"))
