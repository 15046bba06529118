import collections
import random
import re

import numpy as np

from rubrica.llm import jaccard as J

RNG = random.Random(4)


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return collections.Counter((d, len(sets[i]), least.get(find(i), d) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def corpus(n=250):
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    passage = " ".join(RNG.choice(vocab) for _ in range(55))
    for _ in range(n):
        t = [RNG.choice(vocab) for _ in range(RNG.choice([0, 1, 2, 3, 5, 8, 12, 40, 150]))]
        if RNG.random() < 0.3:
            t += passage.split()
        texts.append(" ".join(t))
    base = [RNG.choice(vocab) for _ in range(120)]
    for _ in range(60):  # near copies of one text
        t = list(base)
        for _ in range(RNG.randint(0, 4)):
            t[RNG.randrange(len(t))] = RNG.choice(vocab)
        texts.append(" ".join(t))
    texts += [RNG.choice(texts).upper() for _ in range(30)] + [RNG.choice(texts) for _ in range(30)]
    RNG.shuffle(texts)
    return list(enumerate(texts)) + [(5000, None), (5001, " \n\t "), (7, texts[3]), (None, texts[4]), (None, "entirely new text of null id here")]


def test_components_links_and_sizes_match_brute_force(docs):
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        rows = corpus(150)
        out = J.jaccard_components(docs(rows, extra=["key", "component_id"]), k, num, den).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, k, num, den)
    assert J.jaccard_components(docs([])).count() == 0


def test_large_clusters_are_tiled_without_losing_links(docs, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(J, "BLOCK", 7)
    out = J.jaccard_components(docs(rows), 4, 85, 100, buckets=3).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, 4, 85, 100)


def test_similar_sets_always_share_a_part():
    parts, rng = J.Parts(85, 100), np.random.default_rng(2)
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 1 + n // 6))):
            b[rng.integers(n)] = rng.integers(0, 1 << 63)
        b = b[: max(1, n - int(rng.integers(0, 1 + n // 8)))]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            pa, pb = dict(parts.hashes(a)), dict(parts.hashes(b))
            low = min(parts.band(len(a)), parts.band(len(b)))
            assert len(np.intersect1d(pa[low], pb[low]))


def test_trees_prune_nothing_that_links():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, int(rng.integers(1, 120)))) for _ in range(150)]
    for s in list(sets[:80]):
        sets.append(np.unique(np.concatenate([s[: max(1, len(s) - 2)], rng.choice(pool, 2)])))
    keys = np.arange(len(sets))
    for sides in (np.zeros(len(sets), int), keys % 2):
        work = [0] * 4
        i, j = J.tile_links(sets, sides, 85, 100, 1 << 40, work)
        assert 0 < work[1] <= work[0] and work[2] + work[3] > 0
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(got) == len(i)
        want = set()
        for p in range(len(sets)):
            for q in range(p):
                both = len(np.intersect1d(sets[p], sets[q]))
                if (sides[p] != sides[q] or sides.max() == 0) and 100 * both >= 85 * (len(sets[p]) + len(sets[q]) - both):
                    want.add((q, p))
        assert got == want


def test_components_of_chains_and_stars(spark):
    from rubrica.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 161)) and all(out[500 + i] == 500 for i in range(40)) and out[7] == 7 and 3 not in out


def test_copies_are_dealt_over_all_tasks(spark, docs):
    from pyspark.sql import functions as F

    from rubrica.llm import jaccard as J

    rows = [(i, "one text that most rows have in common" if i % 10 < 8 else "" if i % 10 == 8 else f"text number {i} is its own") for i in range(4000)]
    met = J.meet(docs(rows).repartition(4), 4, 85, 100, 16, "doc_id", "text").where(F.col("kind") == J.ROW)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_a_passage_in_common_makes_no_cluster():
    """Texts that share some of their shingles, and link with nothing, meet in small groups at most, and tell no more parts than they need."""
    rng, parts = np.random.default_rng(3), J.Parts(80, 100)
    passage = rng.integers(0, (1 << 64) - 1, 40, np.uint64)
    hashes, keys = [], []
    for i in range(1500):
        s = np.unique(np.concatenate([rng.choice(passage, 15, replace=False), rng.integers(0, (1 << 64) - 1, 235, np.uint64)]))
        for f, x in parts.hashes(s):
            assert len(x) <= len(s) // 4 + 1
            hashes.append(x)
            keys.append(np.full(len(x), i ^ J.band_mark(f), np.int64))
    *_, pairs = J.forest(np.concatenate(hashes), np.concatenate(keys))
    assert max(collections.Counter(pairs[:, 0].tolist()).values(), default=0) < 150


def test_shuffles_leave_nothing_once_a_table_stands(spark):
    import pathlib
    import time

    from rubrica.llm.common import forget, written

    disk = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in disk for p in pathlib.Path(d).rglob("shuffle_*.data")}
    before, told = files(), written(spark.range(100_000).repartition(5, "id"), "shuffled")
    for _ in range(50):  # they go in the background
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and told.count() == 100_000
    forget(told)
