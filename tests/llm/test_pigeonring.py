import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rubrica.llm import pigeonring as P


def slow_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def slow_components(fps):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return [find(i) for i in range(len(fps))]


def near(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b c", "A B c D", "a b c d " * 5000, "é x y z w"] + [" ".join(rng.choices("ab cd EF gh ij k".split(), k=rng.randint(1, 60))) for _ in range(60)]
    assert [P.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_hash_is_spark_s(spark):
    s = ["a b c d", "é ü", "x" * 100]
    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(x,) for x in s], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(x.encode(), P.SEED) for x in s]


def test_every_pair_within_the_distance_has_a_chain_and_a_key():
    rng = random.Random(2)
    ring = P.Ring(4)
    for length in (P.SHORT, P.LONG):
        sets = P.unequal(length, 4)
        for _ in range(3000):
            a = rng.getrandbits(64)
            b = near(rng, a, 4)
            ok = []
            for s in range(8):
                d = a ^ b
                segs = [d >> 8 * ((s + x) % 8) & 255 for x in range(8)]
                chain = all(sum(x.bit_count() for x in segs[:n]) <= n // 2 for n in range(1, 9))
                passed = len(ring.passed(np.asarray([a], P.U), np.asarray([b], P.U), np.asarray([s]))) == 1
                # The filter may leave out what a tighter length implies, never more
                assert chain <= passed or any(segs[x] for x in (0,))
                meets = any(all(not segs[x] for x in range(length) if x not in out) for out in sets)
                assert not chain or meets
                ok.append(chain)
            assert any(ok)


def test_long_keys_go_on_from_short_ones():
    sets, short = P.unequal(P.LONG, 4), [o[0] for o in P.unequal(P.SHORT, 4)]
    assert short == [1, 2] and len(sets) == 14
    assert all(len([x for x in o if x < P.SHORT]) <= 1 for o in sets)


@pytest.mark.parametrize("crowd", [20_000, 12, 3])
def test_links_connect_what_brute_force_does(spark, crowd):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(250)}
    for hub in [rng.getrandbits(64) for _ in range(6)] + [0]:  # dense groups, chains, and what lies at 5 and 6 bits
        fps |= {near(rng, hub, 6) for _ in range(90)}
    prefix = rng.getrandbits(32) << 32  # one passage in many: half the bits are equal
    fps = sorted(fps | {prefix | rng.getrandbits(32) for _ in range(150)})
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = P.components(P.links(rows, 4, crowd)).collect()
    label = {r.node: r.label for r in got}
    want = slow_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    mine = [label.get(x, x) for x in signed]
    pairs = set(zip(mine, want, strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_large_groups_are_searched_once():
    rng = random.Random(4)
    ring, hub = P.Ring(4), rng.getrandbits(64) | 0
    fps = sorted({hub ^ (1 << a) ^ (1 << b) for a in range(16, 64) for b in range(16, 64)} | {hub})
    i, j = ring.large(np.asarray(fps, P.U), 0)
    assert len(i) <= len(fps) - 1
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in zip(i, j, strict=True))


def test_documents(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [" ".join(word() for _ in range(300)) for _ in range(12)]
    edited = [" ".join(w if rng.random() > 0.004 else word() for w in b.split()) for b in base for _ in range(4)]
    texts = [None, "", "  ", *base, *edited, base[0], base[0].upper(), base[0].replace(" ", "\n\t"), "one", "one two"]
    rows = list(enumerate(texts, 5)) + [(None, base[1]), (None, "alone here"), (5, base[2]), (7, base[2])] + [(1000 + i, base[3]) for i in range(200)]
    out = P.near_copies(docs(rows, extra=["fp", "top", "fingerprint"])).collect()
    fps = [P.fingerprint(t) for _, t in rows]
    comp = slow_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp, strict=True)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {5}


def test_no_rows(spark, docs):
    assert P.near_copies(docs([])).collect() == []


def test_distances_that_the_keys_are_not_made_for(spark):
    with pytest.raises(ValueError, match="budget of one bit"):
        P.links(spark.createDataFrame([(1,)], "fp long"), 2)
