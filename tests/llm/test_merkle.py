import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rubrica.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n):
    return h(*map(field, (doc_id, source, lang, n, text)))


def grow(nodes):
    """All levels of a tree, the last of one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        low = i - i % 8
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 8])))
        i //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    trees = {x: grow([leaf(*r) for r in own[x]]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            path = siblings(trees[x], i) + siblings(top, n)
            back = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                back = leaf(r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for a, b in path:
                back = h(a, back, b)
            out.append((r[0], leaf(*r), trees[x][-1][0], top[-1][0], h(*(a + b for a, b in path)), back, back == top[-1][0]))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"leaf": F.lit("clash"), "pos": F.lit(3), "grp": F.lit("clash")})


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def check(spark, rows, height):
    got = M.manifest(table(spark, rows), height).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert key([tuple(r) for r in got]) == key(brute(rows))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_equal_to_whole_trees(spark, height):
    rows = [(i * 7 % 701, f"Text {i} É", ["en", "de", None, "EN"][i % 13 % 4], "s", i) for i in range(600)] + [(9000 + i, "A", f"l{i}", None, None) for i in range(9)]
    check(spark, rows, height)


def test_one_hot_language_and_block_edges(spark):
    for n in (1, 8, 9, 64, 65, 513):
        check(spark, [(i, "Some Text", "en", "s", 1) for i in range(n)], 2)


def test_nulls_repeated_rows_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "", "", 0)] * 20 + [(None, "A", "en", "s", 1)] * 70 + [(2, "B " * 300_000, "en", "s", 1), (2, "b", "en", "s", 1), (3, None, "en", None, -4)]
    check(spark, rows, 2)


def test_empty_table(spark):
    assert M.manifest(table(spark, [])).collect() == []


def test_tampering_shows(spark):
    rows = [(i, "Upper Case" if i % 2 else "lower case", "en", "s", 1) for i in range(200)]
    for r in M.manifest(table(spark, rows)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2 == 1))
