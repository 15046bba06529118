"""Language of words by a linear-chain conditional random field.

A word's features are its prefixes, suffixes, character n-grams and, for words of the training lexicon, itself; transitions between the
languages of neighbouring words are learned with them by stochastic gradient ascent of the conditional likelihood. Forward and backward
messages give every word its marginals; a text's language has the largest sum of them, and its score is that sum's share.

The messages are exact for texts of any length: blocks of words are multiplied up to transfer matrices, messages run over blocks, then
within them, so that numpy works on many blocks at once.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with null text, id or language train nothing. Without training rows
everything is `und`. Texts and words of any length are read whole. Ties go to the language that sorts first. Repeated rows are labelled one by one.
An empty table gives no row. Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import TRAINING_CHARS, fold_of, small_batches, tidy
from rubrica.llm.common import pieces as cut

TOKEN = re.compile(r"[^\W\d_]+")
#: Training uses about so many rows of each language, chosen by a hash of their ids, and TRAINING_CHARS characters. Words that those hold twice or more are the lexicon.
ROWS_EACH = 150
BUCKETS = 1 << 16
BLOCK = 32


def words_in(text: str) -> list[str]:
    return [w for w in TOKEN.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


#: The n-grams of a longer word are taken in pieces of so many characters, so that memory stays bounded.
PIECE = 1 << 14


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[int]:
    """Buckets of a word's affixes and n-grams, edges marked, and of itself if the lexicon has it."""
    m = f"^{word}$"
    names = [f"p{word[:n]}" for n in range(1, 4) if n <= len(word)] + [f"s{word[-n:]}" for n in range(1, 4) if n <= len(word)]
    names += [m[i : i + n] for n in (2, 3) for i in range(min(PIECE, len(m) - n + 1))]
    if word in lexicon:
        names.append(f"w{word}")
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def further_features(word: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a long word that features() leaves, in pieces."""
    m = f"^{word}$" if len(word) + 2 > PIECE else ""
    for at in range(PIECE, len(m), PIECE):
        part = m[at : at + PIECE + 2]
        grams = [part[i : i + n] for n in (2, 3) for i in range(min(PIECE, len(part) - n + 1))]
        yield np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int64, len(grams))


class Model:
    """langs, feature weights (bucket, language), transitions in probability form, lexicon."""

    def __init__(self, langs: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: set[str]):
        self.langs, self.weights, self.transitions, self.lexicon = langs, weights, transitions, lexicon


class Words:
    """Potentials of words by a model; what it keeps lives as long as its task."""

    def __init__(self, model: Model, most: int = 150_000, most_chars: int = 8 << 20):
        self.model, self.most, self.most_chars, self.chars = model, most, most_chars, 0
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def potentials(self, words: list[str]) -> np.ndarray:
        """exp of each word's feature sums, the largest scaled to 1; each distinct word is worked out once while it is kept."""
        if len(self.number) > self.most or self.chars > self.most_chars:
            self.number.clear()  # it only saves time
            self.chars = 0
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            weights = self.model.weights
            each = [features(w, self.model.lexicon) for w in new]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            e = np.add.reduceat(weights[np.fromiter((x for f in each for x in f), np.int64, int(sizes.sum()))], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            for k in [k for k, w in enumerate(new) if len(w) + 2 > PIECE]:
                for grams in further_features(new[k]):
                    e[k] += weights[grams].sum(0)
            at = len(self.number)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((2 * (at + len(new)) - len(self.rows), len(self.model.langs)))])
            self.rows[at : at + len(new)] = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.chars += sum(map(len, new))
        return self.rows[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]


def messages(p: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at every word of texts that lie one after another in p, each scaled to sum 1; a: transition potentials. Every text has a word."""
    n_lang = p.shape[1]
    blocks = -(-lengths // BLOCK)
    first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(text)) - first_block[text]
    start = first_word[text] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[text] - nth * BLOCK)
    at = np.minimum(start[:, None] + np.arange(BLOCK), len(p) - 1)
    real = np.arange(BLOCK) < size[:, None]
    x = p[at]  # block, place, language
    norm = lambda m, axes: m / np.maximum(m.sum(axes, keepdims=True), 1e-300)
    g = np.broadcast_to(np.eye(n_lang), (len(text), n_lang, n_lang))
    for t in range(BLOCK if blocks.max() > 1 else 0):  # transfer matrices, for texts of more than a block
        g = np.where(real[:, t, None, None], norm((g @ a) * x[:, t, None, :], (1, 2)), g)
    into, out = np.full((len(text), n_lang), 1.0 / n_lang), np.full((len(text), n_lang), 1.0)
    order = np.argsort(-blocks, kind="stable")
    for k in range(1, int(blocks.max())):
        live = order[: int((blocks > k).sum())]
        i = first_block[live] + k
        into[i] = norm(np.einsum("bi,bij->bj", into[i - 1], g[i - 1]), 1)
        j = first_block[live] + blocks[live] - 1 - k
        out[j] = norm(np.einsum("bij,bj->bi", g[j + 1], out[j + 1]), 1)
    alpha, beta = np.empty_like(x), np.empty_like(x)
    f = into
    for t in range(BLOCK):
        f = np.where(real[:, t, None], norm((f @ a) * x[:, t], 1), f)
        alpha[:, t] = f
    b = out
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = b
        b = np.where(real[:, t, None], norm((x[:, t] * b) @ a.T, 1), b)
    return alpha[real], beta[real]


def marginals(p: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each word's distribution over languages."""
    forward, backward = messages(p, lengths, a)
    m = forward * backward
    return m / np.maximum(m.sum(1, keepdims=True), 1e-300)


def fit(texts: list[str], y: list[str], epochs: int = 2, rate: float = 0.5, seed: int = 5) -> Model:
    """Whole texts in runs of up to 64 words; every word carries its text's language."""
    langs = sorted(set(y))
    n = len(langs)
    number: dict[str, int] = {}
    runs: list[tuple[np.ndarray, int]] = []
    count: Counter[str] = Counter()
    for t, lang in zip(texts, y, strict=True):
        ws = words_in(t)
        count.update(ws)
        ids = np.asarray([number.setdefault(w, len(number)) for w in ws], np.int64)
        runs += [(ids[i : i + 64], langs.index(lang)) for i in range(0, len(ids), 64)]
    lexicon = {w for w, c in count.items() if c > 1}
    feats = [np.concatenate([features(w, lexicon), *further_features(w)]).astype(np.int64) for w in number]
    weights, trans = np.zeros((BUCKETS, n)), np.zeros((n, n))
    rng = np.random.default_rng(seed)
    size, done = 64, 0
    total = epochs * -(-len(runs) // size)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for s in range(0, len(runs), size):
            part = [runs[i] for i in order[s : s + size]]
            lr = rate * (1 - done / total)
            done += 1
            used, inv = np.unique(np.concatenate([r for r, _ in part]), return_inverse=True)
            f = [feats[u] for u in used]
            sizes = np.fromiter(map(len, f), np.int64, len(f))
            flat = np.concatenate(f)
            e = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            p = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
            lengths = np.fromiter((len(r) for r, _ in part), np.int64, len(part))
            gold = np.repeat([g for _, g in part], lengths)
            a = np.exp(trans)
            forward, backward = messages(p[inv], lengths, a)
            m = forward * backward
            m /= np.maximum(m.sum(1, keepdims=True), 1e-300)
            grad = -m
            grad[np.arange(len(gold)), gold] += 1
            own = np.zeros((len(used), n))
            np.add.at(own, inv, grad)
            per = np.repeat(own, sizes, axis=0)
            for k in range(n):
                weights[:, k] += lr / size * np.bincount(flat, per[:, k], BUCKETS)
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths) - 1] = False
            here = np.flatnonzero(inner)
            pair = forward[here][:, :, None] * a * (p[inv][here + 1] * backward[here + 1])[:, None, :]
            pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[here], gold[here + 1]), 1)
            trans += lr * ((seen - pair.sum(0)) / max(1, len(here)) - 0.002 * trans)
    return Model(langs, weights, np.exp(trans), lexicon)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", each: int = ROWS_EACH) -> Model:
    """From about `each` rows of each language: the number of rows of a language is counted over all, then a hash of the id decides. An id that several rows have
    trains by the least of their languages and texts; texts are taken in the order of that hash, whole, up to TRAINING_CHARS characters."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where((fold_of(F.col(key)) != 0) & F.col("l").isNotNull() & F.col("k").isNotNull() & F.col("t").isNotNull())
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), set())
    share = F.create_map(*[F.lit(x) for c in counts.items() for x in (c[0], min(1.0, each / c[1]))])
    place = F.shiftrightunsigned(F.xxhash64("k"), 11).cast("double") * F.lit(2.0**-53)
    some = rows.where(place < share[F.col("l")]).groupBy("k").agg(F.min(F.struct("l", "t")).alias("x")).select("k", "x.l", "x.t", F.length("x.t").alias("n"))
    kept, chars = [], 0
    for k, n in some.orderBy(F.xxhash64("k"), "k").select("k", "n").collect():  # about `each` rows of each language
        if chars + n <= TRAINING_CHARS:
            chars += n
            kept.append((k,))
    told = some.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "k long")), "k").toArrow().sort_by("k")
    pairs = [(t, x) for t, x in zip(told.column("t").to_pylist(), told.column("l").to_pylist(), strict=True) if words_in(t)]
    if not pairs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), set())
    return fit(*map(list, zip(*pairs, strict=True)))


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of a text."""
    ws = words_in(text or "")
    if not ws or not model.langs:
        return []
    m = marginals(Words(model).potentials(ws), np.asarray([len(ws)]), model.transitions)
    return [(w, model.langs[int(r.argmax())], float(r.max())) for w, r in zip(ws, m, strict=True)]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches) of each row; n_switches counts neighbouring words of different languages."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        words = Words(m)
        for whole in batches:
            for b in cut(whole, "t", 1 << 20):
                each = [words_in(t) for t in b.column("t").to_pylist()]
                lengths = np.fromiter(map(len, each), np.int64, len(each))
                lang, score, switches = np.full(len(each), "und", object), np.zeros(len(each)), np.zeros(len(each), np.int64)
                some = np.flatnonzero(lengths) if m.langs else np.zeros(0, int)
                if len(some):
                    x = marginals(words.potentials([w for ws in each for w in ws]), lengths[some], m.transitions)
                    at = np.cumsum(lengths[some]) - lengths[some]
                    sums = np.add.reduceat(x, at, axis=0) / lengths[some][:, None]
                    best = sums.argmax(1)
                    lang[some], score[some] = np.asarray(m.langs, object)[best], np.clip(sums[np.arange(len(some)), best], 0, 1)
                    own = x.argmax(1)
                    turn = np.concatenate([[False], own[1:] != own[:-1]])
                    turn[at] = False
                    switches[some] = np.add.reduceat(turn.astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(lang, pa.string()), pa.array(score), pa.array(lengths), pa.array(switches)], names=names)

    slim = docs.select(F.col(key).cast("long").alias("k"), (fold_of(F.col(key)) == 0).alias("h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long")


def op7_word_crf(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
