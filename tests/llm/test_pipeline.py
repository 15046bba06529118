import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_drops_and_keeps(spark, tmp_path):
    import random

    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n=80: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(400):
        t, toxic, good = text(), i % 8 == 0, i % 7 != 0
        if toxic:
            t = " ".join(w if k % 9 else "scum" for k, w in enumerate(t.split()))
        if not good:
            t = " ".join(f"{w}%%%" for w in t.split())
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), int(toxic)))
    clean = [i for i in range(400) if i % 8 and i % 7]
    item = text(30)
    near = rows[clean[0]][1].split()
    near[5] = "changed"
    rows += [(1000, rows[clean[0]][1], "en", "s", 1), (1001, " ".join(near), "en", "s", 1), (1002, f"{text(40)} {item} {text(40)}", "en", "s", 1), (1003, None, None, None, None)]
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in out}
    assert not left & {1000, 1001, 1002}
    assert len(left & set(clean)) >= 0.97 * len(clean)
    assert len(left - set(clean)) <= 0.05 * 400
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "leaks", "packing"]


def test_rows_that_share_an_id_or_have_none_are_judged_apart(spark, tmp_path):
    import random

    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n=80: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    toxic = lambda t: " ".join(w if k % 9 else "scum" for k, w in enumerate(t.split()))
    poor = lambda t: " ".join(f"{w}%%%" for w in t.split())
    item, rows, labels = text(30), [], []
    for i in range(240):
        t = text()
        rows.append((i, toxic(t) if i % 8 == 0 else poor(t) if i % 7 == 0 else t, "en", "s", 1))
        labels.append((i, int(i % 7 != 0), int(i % 8 == 0)))
    clean, gone, groups = [], [], []
    for id_ in (None, 2000):
        clean += [(id_, text()) for _ in range(3)]
        gone += [(id_, toxic(text())), (id_, poor(text())), (id_, None), (id_, f"{text(40)} {item} {text(40)}")]
        near = (own := text()).split()
        near[5] = "changed"
        groups.append([(id_, own), (id_, own), (id_, " ".join(near))])
    groups.append([(None, own := text()), (2000, f"{own} more"), (1500, own)])
    rows += [(i, t, "en", "s", 1) for i, t in (*clean, *gone, *(x for g in groups for x in g))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(left.count(x) == 1 for x in clean)
    assert not set(gone) & set(left)
    assert all(sum(x in g for x in left) == 1 for g in groups)
    assert groups[-1][2] in left  # the smallest id of its group
