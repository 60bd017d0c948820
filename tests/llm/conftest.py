import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with columns that clash with the operators' own."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            names = ("node", "size", "score", "id", "token", "TEXT", "copies", "key")
            df = df.select("*", *[F.lit(1).alias(n) for n in names if n != "TEXT"])
        return df

    return make


def same(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
