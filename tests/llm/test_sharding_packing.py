import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.llm import packing, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def same(weights):
    return {s: weights for s in range(4)}


def test_rendezvous_moves_rows_only_into_the_new_shard_and_numbers_without_gaps(docs):
    rows = [(i, f"text {i}") for i in range(400)] + [(None, "x"), (7, "text 7"), (7, "text 7"), (8, None), (9, "")]
    df = docs(rows, extra=["shard", "slot", "law"])
    out = sharding.rendezvous(df, same(1.0), {s: 1.0 for s in range(5)}).toPandas()
    assert len(out) == len(rows) and set(out.law) == {"key"}
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved.grown_shard) == {4} and 40 < len(moved) < 130
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    r = out[out.doc_id == 8].iloc[0]
    assert out[out.doc_id == 9]["size"].tolist()[-1] >= 1 and 1 in out[out.doc_id == 8]["size"].tolist() and r["size"] in (1, 7)
    t = out[(out.doc_id == 5)].iloc[0]
    assert t["size"] == len(b"text 5") + 1 and t.text_crc32 == zlib.crc32(b"text 5")


def test_weights_decide_shares_and_empty_tables_pass(docs):
    out = sharding.rendezvous(docs([(i, "t") for i in range(3000)]), {0: 1.0, 1: 3.0, 2: 0.0}).toPandas()
    assert set(out["shard"]) == {0, 1} and 0.70 < (out["shard"] == 1).mean() < 0.80 and out.grown_shard.isna().all()
    assert sharding.rendezvous(docs([]), same(1.0)).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(docs([]), {0: 0.0})


def check_packing(out, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    ends = {}
    for r in sorted(out.itertuples(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= 2048
    texts = [t or "" for _, t in rows]
    assert out.length.sum() == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    return len(ends)


def test_packing_places_every_token_once(docs):
    rows = [(i, "alpha beta, gamma. " * (i * 13 % 700)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "word " * 9000), (1003, "word " * 9000), (None, "x y"), (5, "dup"), (5, "dup")]
    out = packing.pack(docs(rows, extra=["piece", "length"]), TOKENIZER).toPandas()
    n = check_packing(out, rows)
    assert n <= 1.02 * -(-out.length.sum() // 2048) + 1
    big = out[out.doc_id == 1002].sort_values("piece")
    assert (big.length[:-1] == 2048).all() and big.piece.tolist() == list(range(len(big)))
    assert packing.pack(docs([]), TOKENIZER).count() == 0


def test_ids_are_the_tokenizers_own():
    tok = packing.tokenizer_at(TOKENIZER)
    odd = ["", " ", "ΟΔΟΣ ΣΑΣ.", "İstanbul, İ.", "H̱ a, b. c.", "<|endoftext|>. x", "<|ENDOFTEXT|>, y", "it's, don't. we'll ", "a.. b., c,. d", "3.5, 4. 5", "x.\ny,\tz", "ét. É, É.", "日本。語, 中.", "a\x1cb. c"]
    for text, got in zip(odd, packing.token_bytes(TOKENIZER, odd), strict=True):
        assert got == np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_histogram_plan_holds_each_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 400, 300), strict=True)}
    plan = packing.pack_histogram(counts, 2048)
    used = {}
    for p in plan:
        assert sum(n * m for n, m in p.parts) <= 2048 and p.repeats > 0
        for n, m in p.parts:
            used[n] = used.get(n, 0) + m * p.repeats
    assert used == counts
    hist = np.zeros(2049, np.int64)
    hist[list(counts)] = list(counts.values())
    assert sum(p.repeats for p in plan) <= 1.01 * sum(p.repeats for p in packing.best_fit(hist, 2048))


def planned(counts, most):
    plan, used = packing.pack_histogram(counts, most), {}
    for p in plan:
        assert sum(n * m for n, m in p.parts) <= most and p.repeats > 0
        for n, m in p.parts:
            used[n] = used.get(n, 0) + m * p.repeats
    assert used == {k: v for k, v in counts.items() if v}
    return sum(p.repeats for p in plan)


def alone(counts, most):
    hist = np.zeros(most + 1, np.int64)
    hist[list(counts)] = list(counts.values())
    return sum(p.repeats for p in packing.best_fit(hist, most))


def test_plans_are_never_worse_than_best_fit():
    few = {1030: 500, 500: 900, 300: 700, 200: 100}
    assert planned(few, 2048) <= alone(few, 2048)
    rng = np.random.default_rng(11)
    for n in [1, 2, 3, 5, 10, 10, 10, 40]:
        counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 2049), n, replace=False), rng.integers(1, 900, n), strict=True)}
        assert planned(counts, 2048) <= alone(counts, 2048)
    assert planned({}, 2048) == 0 and planned({2048: 3, 1: 1}, 2048) == 4


def optimum(pieces, most):
    """The fewest sequences, by trying each piece in every open sequence of another fill."""
    best = len(pieces)

    def go(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(pieces):
            best = len(fills)
            return
        for f in sorted(set(fills)):
            if f + pieces[i] <= most:
                rest = list(fills)
                rest.remove(f)
                go(i + 1, [*rest, f + pieces[i]])
        go(i + 1, [*fills, pieces[i]])

    go(0, [])
    return best


def test_small_histograms_are_within_one_of_the_optimum():
    rng, exact = np.random.default_rng(5), 0
    for _ in range(40):
        pieces = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        counts = {int(k): pieces.count(k) for k in set(pieces)}
        got, want = planned(counts, 20), optimum(pieces, 20)
        assert want <= got <= want + 1
        exact += got == want
    assert exact >= 36


def test_numbering_is_gapless_for_a_hot_key(spark):
    from rubrica.llm.slots import numbered

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    out = numbered(df, ["g"], ["k"], "n", 7).toPandas()
    assert len(out) == 5000
    for _, g in out.groupby("g"):
        assert sorted(g.n) == list(range(len(g)))


def test_patterns_carry_the_bulk_and_best_fit_the_residue():
    rng = np.random.default_rng(8)
    lengths = np.clip(np.exp(rng.normal(6, 1, 20_000)).astype(int), 1, 2048)
    hist = np.bincount(lengths, minlength=2049)
    counts = {int(k): int(hist[k]) for k in np.flatnonzero(hist)}
    total = sum(p.repeats for p in packing.pack_histogram(counts, 2048))
    full = int(hist[2048])
    hist[2048] = 0
    by_patterns = sum(p.repeats for p in packing.fitted(hist.copy(), 2048))
    assert by_patterns > 0.6 * (total - full)
    assert total <= 1.001 * -(-int(lengths.sum()) // 2048) + 1


def test_ids_of_random_words_are_the_tokenizers_own():
    tok, words = packing.tokenizer_at(TOKENIZER), packing.WordIds(TOKENIZER, most=50)
    rng = np.random.default_rng(6)
    letters = list("abcéßñœÅΣσςIıİ中日ไทย'.,;:!?()[]{}\"$%&*#012 <|>\n\t\u00a0\u0301\u1f71")
    for _ in range(40):
        texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(20)]
        for t, got in zip(texts, words.texts(texts), strict=True):
            assert got == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
