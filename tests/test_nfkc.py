"""Compatibility forms of a batch are made a slice at a time."""
import unicodedata

from pyspark.sql import functions as F

from caseweave.functions import identifiers as I


def test_nfkc_of_several_slices_equals_python(spark):
    points = [c for c in range(0x80, 0x30000, 17) if not 0xD800 <= c <= 0xDFFF]
    texts = [None, "", "plain", *(f"a{chr(c)}́" for c in points)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = [r["n"] for r in rows.select("i", I.nfkc(F.col("t")).alias("n")).orderBy("i").collect()]
    assert len(texts) > 2 * I.NFKC_SLICE
    assert got == [t and unicodedata.normalize("NFKC", t) for t in texts]
