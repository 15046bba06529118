"""Quality by supervised subword embeddings.

A text's features are its words, the character n-grams of its words, its word pairs, and two marks for repetition (a word that repeats the
one before it, a line seen before). Each is hashed to a learned vector; the vectors are averaged, and a softmax layer turns the average
into class probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy. As averaging is linear, a
trained model is one number for each bucket, and a text is scored by sums over words that each worker keeps. Every character counts, in runs of any length.

Nulls: a null or empty text, or one of white space alone, gets EMPTY. Null ids and labels train nothing. Texts of any length are read whole. Ties: a text
at the threshold exactly is predicted good. Repeated rows are scored one by one. An empty table gives no row. With one kind of label, or none, the score is that
label's share of the training rows (0.5 without any). Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import fold_of, rows_kept, small_batches, tidy, training_rows
from rubrica.llm.common import pieces as cut

#: Training uses at most so many labelled rows.
TRAINING_ROWS = 4_000
BUCKETS = 1 << 18
DIM = 8
EMPTY = 0.05
NGRAMS = (2, 3, 4)
#: A mark for repetition weighs as much as a word with its n-grams.
MARK_WEIGHT = 12
PAIR = np.uint32(2654435761)
AGAIN, LINE_AGAIN = (zlib.crc32(x) % BUCKETS for x in (b"\x00again", b"\x00line again"))


#: A run of more characters is no word: its n-grams are taken in pieces of PIECE characters, so that memory stays bounded.
LONG = 64
PIECE = 1 << 14


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, edges marked; of a long run only its own, as long_features has its n-grams."""
    marked = f"<{word}>" if len(word) <= LONG else ""
    grams = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in (f"w:{word}", *grams)]


def long_features(word: str) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a long run, edges marked, in pieces; none of a word."""
    marked = f"<{word}>" if len(word) > LONG else ""
    for at in range(0, len(marked), PIECE):
        part = marked[at : at + PIECE + max(NGRAMS) - 1]
        grams = [part[i : i + n] for n in NGRAMS for i in range(min(PIECE, len(part) - n + 1))]
        yield np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int64, len(grams))


def marks(text: str, words: np.ndarray) -> tuple[int, int]:
    """How often a word repeats the one before it, and how many words stand in lines seen before."""
    again = int((words[1:] == words[:-1]).sum())
    lines = [x.strip() for x in text.split("\n")]
    seen: set[str] = set()
    late = 0
    if len(lines) > 1:
        for x in lines:
            if x in seen:
                late += x.count(" ") + 1 if x else 0
            seen.add(x)
    return again, late


class Vocabulary:
    """Words met so far, by number; whatever is kept for a word is kept at its number. It starts anew beyond so many words, or characters of new words."""

    def __init__(self, most: int = 150_000, most_chars: int = 8 << 20):
        self.number: dict[str, int] = {}
        self.most, self.most_chars, self.chars = most, most_chars, 0

    def numbers(self, words: list[str]) -> tuple[np.ndarray, list[str], bool]:
        """(numbers, words that are new, whether everything kept before is void)"""
        void = len(self.number) > self.most or self.chars > self.most_chars
        if void:
            self.number.clear()
            self.chars = 0
        known = self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        self.chars += sum(map(len, new))
        for w in new:
            known[w] = len(known)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), new, void


def text_features(text: str, cache: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs, in the smallest types that hold them."""
    words = text.split()
    for w in words:
        if w not in cache:
            cache[w] = np.asarray(word_features(w), np.uint32).tobytes()
    each = [cache[w] for w in words]
    heads = np.frombuffer(b"".join(x[:4] for x in each), np.uint32)
    pairs = (heads[:-1] * PAIR + heads[1:]) % np.uint32(BUCKETS)
    again, late = marks(text, heads)
    at, n = np.unique(np.concatenate([np.frombuffer(b"".join(each), np.uint32), pairs]), return_counts=True)
    long = Counter(w for w in words if len(w) > LONG)
    if long:
        counts = np.bincount(at, n, BUCKETS).astype(np.int64)
        for w, times in long.items():
            del cache[w]
            for grams in long_features(w):
                np.add.at(counts, grams, times)
        at = np.flatnonzero(counts).astype(np.uint32)
        n = counts[at]
    at = np.concatenate([at, np.asarray([AGAIN, LINE_AGAIN], np.uint32)]).astype(np.int32)
    n = np.concatenate([n, [again * MARK_WEIGHT, late * MARK_WEIGHT]])
    return at, n.astype(np.uint16 if n.max() < 1 << 16 else np.uint32)


def fit(texts: list[str], y: np.ndarray, epochs: int = 6, rate: float = 40.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias) whose mean plus bias is the log-odds of class 1."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    layer = ((rng.random((DIM, 2), np.float32) - 0.5) * 2).astype(np.float32)
    bias = np.zeros(2, np.float32)
    cache: dict[str, bytes] = {}
    rows = [text_features(t, cache) for t in texts]
    cache.clear()
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, n = rows[i]
            share = n / np.float32(max(1, n.sum(dtype=np.int64)))
            lr = 1.0 - done / steps
            done += 1
            h = share @ vectors[at]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = layer @ p
            layer -= 0.2 * lr * np.outer(h, p)
            bias -= 0.02 * lr * p
            vectors[at] -= (rate * lr * share)[:, None] * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias


class Reader:
    """Scores texts by a model; what it keeps of words lives as long as its task."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias
        self.words, self.sums, self.heads, self.sizes = Vocabulary(), np.zeros(0), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def probability(self, text: str) -> float:
        words = text.split()
        if not words:
            return EMPTY
        i, new, _ = self.words.numbers(words)
        if new:
            each = [word_features(w) for w in new]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = self.weights[np.fromiter((x for f in each for x in f), np.int64, int(sizes.sum()))]
            sums = np.add.reduceat(flat.astype(float), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for k in [k for k, w in enumerate(new) if len(w) > LONG]:
                for grams in long_features(new[k]):
                    sums[k] += self.weights[grams].sum(dtype=float)
                    sizes[k] += len(grams)
            at = len(self.words.number)
            if at > len(self.sums):  # room for twice as many
                self.sums, self.heads, self.sizes = (np.concatenate([a, np.zeros(2 * at - len(a), a.dtype)]) for a in (self.sums, self.heads, self.sizes))
            own = slice(at - len(new), at)
            self.sums[own], self.heads[own], self.sizes[own] = sums, [f[0] for f in each], sizes
        heads = self.heads[i]
        pairs = (heads[:-1] * PAIR + heads[1:]) % np.uint32(BUCKETS)
        again, late = marks(text, heads)
        total = self.sums[i].sum() + self.weights[pairs].sum(dtype=float) + MARK_WEIGHT * (again * self.weights[AGAIN] + late * self.weights[LINE_AGAIN])
        n = self.sizes[i].sum() + len(pairs) + MARK_WEIGHT * (again + late)
        return 1 / (1 + math.exp(-min(max(total / n + self.bias, -50), 50)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS) -> Model:
    """The training rows go to the driver: at most `most` of them, and TRAINING_CHARS characters."""
    rows = training_rows(docs, labels, label, most).select("text", "y", "doc_id").toArrow().sort_by("doc_id")
    y = np.clip(rows.column("y").to_numpy().astype(int), 0, 1)
    share = (y.mean() + 1e-3) / 1.002 if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), math.log(share / (1 - share)))
    return Model(*fit([t or "" for t in rows.column("text").to_pylist()], y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Reader(told.value)
        for whole in batches:
            for b in cut(whole, "t"):
                p = [m.probability(t) for t in b.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(p, pa.float64()), pa.array([int(x >= least) for x in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(key).cast("long").alias("k"), (fold_of(F.col(key)) == 0).alias("h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_rows(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, whole, that score `least` or more."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def judge(model: Model):
        m = Reader(model)
        return lambda texts: [m.probability(t) >= least for t in texts]

    return rows_kept(docs, told, judge, text)


def op4_subword_embeddings(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
