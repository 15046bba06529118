import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs; with a clashing extra column on demand."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
