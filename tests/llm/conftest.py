import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_text", "_key", "_in", "row", "group", "size", "copies", "host", "secrets", "pii", "quality", "fp", "ids", "term")


@pytest.fixture(scope="module")
def frame(spark):
    """Documents with further columns whose names operators use themselves."""
    def make(rows, clash=False):
        df = spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], COLUMNS)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df

    return make
