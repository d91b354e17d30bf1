import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs(spark):
    """documents with the given (doc_id, text[, source]) rows and columns whose names operators might use themselves."""
    def make(rows, extra=True):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F
            for name in ("row", "key", "size", "copies", "target", "rows", "component_id", "fp", "g", "p", "n", "score"):
                frame = frame.withColumn(name, F.lit(None).cast("string"))
        return frame
    return make
