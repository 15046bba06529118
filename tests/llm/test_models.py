import itertools

import numpy as np

from rubrica.llm import language, quality, toxicity
from rubrica.llm.common import fold_of_value

LABELS = "doc_id long, quality int, toxic int"
RNG = np.random.default_rng(1)
WORDS = {"en": "the of and house river stone light water green field".split(), "de": "der und nicht schule straße kinder größe über wälder haus".split()}


def sentences(lang, n):
    return " ".join(RNG.choice(WORDS[lang], n))


def corpus(spark, docs, bad):
    rows, labels = [], []
    for i in range(600):
        t, toxic, good = sentences("en", 60), i % 6 == 0, i % 5 != 0
        w = t.split()
        if toxic:
            for k in RNG.integers(0, 60, 6):
                w[k] = str(RNG.choice(bad))
        rows.append((i, " ".join(w) if good else " ".join(f"{x}%%%" for x in w)))
        labels.append((i, int(good), int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, rows[0][1]), (9003, rows[0][1]), (None, rows[1][1])]
    labels += [(None, 1, 1), (9001, None, None), (3, 1, 0)]
    return docs(rows, extra=["score", "predicted", "held_out", "y"]), spark.createDataFrame(labels, LABELS), dict(rows), {a: (b, c) for a, b, c in labels[:600]}


def test_toxicity_finds_held_out_passages(spark, docs):
    bad = ["scum", "vileness", "vilest", "vilely", "scummy"]
    df, labels, texts, marks = corpus(spark, docs, bad)
    model = toxicity.train(df, labels)
    out = toxicity.score(df, model).collect()
    assert len(out) == df.count()
    held = [r for r in out if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (fold_of_value(r.doc_id) == 0) for r in out)
    assert np.mean([r.predicted == marks[r.doc_id][1] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.score < 0.2 for r in out if r.doc_id in (9000, 9001, 9002))
    toxic = next(i for i, m in marks.items() if m[1])
    assert toxicity.passages(model, texts[toxic]) and toxicity.score(docs([]), model).count() == 0


def test_toxicity_without_labels_of_both_kinds(spark, docs):
    df = docs([(i, "some words here") for i in range(30)])
    none = toxicity.score(df, toxicity.train(df, spark.createDataFrame([], LABELS))).collect()
    assert len(none) == 30 and all(r.predicted == 0 for r in none)


def test_segments_are_those_of_a_plain_scan():
    def plain(s):
        """Maximal scoring segments by recursion: the best segment, then what is left of it and right of it."""
        if not len(s):
            return []
        best = max(((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (x[0], -x[1], x[1] - x[2]))
        if best[0] <= 0:
            return []
        _, i, j = best
        return plain(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain(s[j:])]

    for _ in range(200):
        s = np.round(RNG.normal(-0.3, 1, RNG.integers(1, 14)), 6)
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == plain(s.tolist())


def test_quality_classifier_on_held_out_rows(spark, docs):
    df, labels, _, marks = corpus(spark, docs, ["scum"])
    out = quality.score(df, quality.train(df, labels)).collect()
    held = [r for r in out if r.held_out and r.doc_id in marks]
    assert len(out) == df.count() and np.mean([r.predicted == marks[r.doc_id][0] for r in held]) > 0.97
    assert all(r.predicted == 0 for r in out if r.doc_id in (9000, 9001, 9002))
    one = quality.train(df, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality.score(docs([(1, "a b")]), one).collect())


def test_quality_sums_over_kept_words_are_the_features_means():
    weights, bias = quality.fit(["a b c a", "x%%% y%%%", "a c", "z%%%"], np.asarray([1, 0, 1, 0]), epochs=2)
    m = quality.Reader(quality.Model(weights, bias))
    weights = m.weights
    for t in ("a b c", "new words %%% here\nnew words %%% here", "a a a a"):
        at, n = quality.text_features(t, {})
        assert abs(m.probability(t) - 1 / (1 + np.exp(-(n / n.sum() @ weights[at] + bias)))) < 1e-5


def test_marginals_are_exact():
    for n in (1, 3, 5):
        p, a, z = RNG.random((n, 3)), RNG.random((3, 3)), np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = a[:, path[0]].sum() / 3 * p[0, path[0]]
            for t in range(1, n):
                w *= a[path[t - 1], path[t]] * p[t, path[t]]
            for t in range(n):
                z[t, path[t]] += w
        assert np.allclose(language.marginals(p, np.array([n]), a), z / z.sum(1, keepdims=True))
    lengths = np.array([1, 31, 32, 33, 64, 200])
    p, a, at = RNG.random((lengths.sum(), 3)), RNG.random((3, 3)), 0
    got = language.marginals(p, lengths, a)
    for n in lengths:
        assert np.allclose(got[at : at + n], language.marginals(p[at : at + n], np.array([n]), a))
        at += n


def test_languages_of_texts_and_of_switched_words(spark, docs):
    rows = [(i, sentences("en" if i % 2 else "de", 30)) for i in range(300)]
    base = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in rows] + [(900, None, "en"), (901, "12 !", "de"), (902, "", None), (903, "über der straße", None)], "doc_id long, text string, lang string")
    model = language.train(base)
    out = {r.doc_id: r for r in language.predict(base, model).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") for i in range(300))
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and out[900].score == 0
    mixed = [x for _, x, _ in language.label_words(model, "the house and the river und nicht der wälder straße")]
    assert mixed == ["en"] * 5 + ["de"] * 5
    none = language.predict(base, language.train(base.where("lang IS NULL")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_quality_counts_every_character_of_long_runs():
    from collections import Counter

    def grams(word):
        marked = f"<{word}>"
        return [quality.zlib.crc32(g.encode()) % quality.BUCKETS for g in (f"w:{word}", *(marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)))]

    rng = np.random.default_rng(4)
    run = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FFF, n)))
    m = quality.Reader(quality.Model(rng.normal(size=quality.BUCKETS), 0.1))
    once = run(70)
    for w in (["a", run(64), "b"], ["a", run(65)], [once, "a", once], [run(n) for n in (1 << 14) + np.arange(-4, 5)], [run(70_000)]):
        want = Counter(x for word in w for x in grams(word))
        heads = [np.uint32(grams(word)[0]) for word in w]
        want.update(int(x) for x in (np.asarray(heads[:-1], np.uint32) * quality.PAIR + np.asarray(heads[1:], np.uint32)) % np.uint32(quality.BUCKETS))
        at, n = quality.text_features(" ".join(w), {})
        got = Counter()
        for a, k in zip(at.tolist(), n.tolist(), strict=True):
            got[a] += k
        assert +got == want
        mean = sum(float(m.weights[a]) * k for a, k in want.items()) / sum(want.values())
        assert abs(m.probability(" ".join(w)) - 1 / (1 + np.exp(-mean - m.bias))) < 1e-6
    small = quality.Vocabulary(most_chars=100)
    assert [small.numbers([run(80)])[2] for _ in range(4)] == [False, False, True, False]


def test_quality_sees_junk_past_the_head_of_a_run():
    good, junk = "石水光田野河家森山海", "%#@~^*=+|&"
    rng = np.random.default_rng(2)
    run = lambda chars, n: "".join(rng.choice(list(chars), n))
    texts = [run(good, 500) if i % 2 else run(good, 64) + run(junk, 436) for i in range(200)]
    weights, bias = quality.fit(texts[:100], np.arange(100) % 2)
    m = quality.Reader(quality.Model(weights, bias))
    assert all((m.probability(t) > 0.5) == i % 2 for i, t in enumerate(texts) if i >= 100)
