import math
import re

import __spark_entry__


def test_text_similarity_reads_whole_texts_of_all_documents(spark, tmp_path):
    items = [(5, "alpha beta gamma"), (900, "delta epsilon"), (17, "alpha omega")]
    docs = [(0, "first line\nalpha beta\nomega"), (1, "alpha\n\nomega x"), (2, "Delta, Epsilon!"), (300, "none\nof these"), (-1, "delta\n" * 3), (4, None), (None, "\n\nbeta gamma ALPHA"), (4, "omega alpha")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: {w for w in re.split("[^a-z0-9]+", (t or "").lower()) if len(w) > 1}

    def want(id_, text):
        item, b = sorted(items)[(id_ or 0) % 3]
        a, b = words(text), words(b)
        return id_, item, math.floor((len(a & b) / len(a | b) if a and b else 0) * 1e4 + 0.5) / 100

    out = [tuple(r) for r in __spark_entry__.queries()["text_similarity"](spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted((want(*d) for d in docs), key=str)
