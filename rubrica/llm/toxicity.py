"""Toxic passages by maximum-scoring segments.

Each token has a score: the log-odds of standing in a toxic document, under Dirichlet (for two classes, beta) priors that descend from
the corpus through the token's prefixes to the token, so that a new inflection of a known stem is scored by its stem. A linear scan finds all maximal
scoring segments of a text. Segment scores are judged by extreme-value statistics (the number of segments as good by chance in a text of
that length), and the surprise of the best ones together becomes a probability by a logistic fit on labelled texts that trained no token score.

Nulls: a null or empty text has no token and gets the score of a text without surprise, at most EMPTY. Null ids and labels train nothing. Texts of
any length are scanned whole. Ties: a text at 0.5 exactly is predicted toxic. Repeated rows are scored one by one. An empty table gives no row; without labels of both kinds
every score is 0. Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import fold_of, rows_kept, small_batches, tidy, training_rows
from rubrica.llm.common import pieces as cut

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
#: Training uses at most so many labelled rows. All their tokens and prefixes are counted, in hashed buckets.
TRAINING_ROWS = 12_000
BUCKETS = 1 << 22
#: Token scores that a task keeps; it only saves time.
SCORES_KEPT = 150_000
EMPTY = 0.01


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def names_of(token: str) -> list[str]:
    """A token's prefixes, shortest first, and itself; those of a prefix end in a mark that no token has."""
    return [*(f"{token[:n]}*" for n in PREFIXES if n < len(token)), token]


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@dataclass
class Model:
    clean: np.ndarray  # by bucket: clean documents that have it
    toxic: np.ndarray
    base: float  # share of toxic documents, weighted by distinct tokens
    kappa: float = 20.0
    drift: float = 1.5
    lam: float = 1.0
    ln_k: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def rate(self, token: str) -> float:
        r = self.base
        for at in map(bucket, names_of(token)):
            if n := int(self.clean[at]) + int(self.toxic[at]):
                r = (int(self.toxic[at]) + self.kappa * r) / (n + self.kappa)
        return r

    def score(self, token: str) -> float:
        r = min(max(self.rate(token), 1e-6), 1 - 1e-6)
        return math.log(r / (1 - r)) - math.log(self.base / (1 - self.base)) - self.drift

    def scores(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        """known: scores to look up and add to."""
        if len(known) > SCORES_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.score(w)
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def surprise(self, best: float, n: int) -> float:
        """Minus the logarithm of the expected number of segments this good in a clean text of n tokens."""
        return self.lam * best - self.ln_k - math.log(max(n, 1))

    def joint_surprise(self, sums: list[float], n: int) -> float:
        """The same for the best r segments together, at the r where it is largest: with T the sum of their normalized scores, chance
        brings as much with probability exp(-T) T^(r-1) / (r! (r-1)!)."""
        if not sums:
            return self.surprise(0.0, n)
        x = self.lam * np.sort(np.asarray(sums))[::-1] - self.ln_k - math.log(max(n, 1))
        r = np.arange(1, len(x) + 1)
        t = np.cumsum(x)
        log_r = np.cumsum(np.log(r))
        z = np.where(t > 1, t - (r - 1) * np.log(np.maximum(t, 1)) + 2 * log_r - np.log(r), -np.inf)
        return float(max(x[0], z.max()))

    def probability(self, sums: list[float], n: int) -> float:
        if not n:
            return min(EMPTY, self.probability([], 1))
        z = self.slope * self.joint_surprise(sums, n) + self.shift
        return 1 / (1 + math.exp(-min(max(z, -50), 50)))


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in linear time; runs of positive scores are taken at once."""
    hit = np.flatnonzero(s > 0)
    if not len(hit):
        return []
    total = np.concatenate([[0.0], np.cumsum(s)])
    breaks = np.flatnonzero(np.diff(hit) > 1)
    starts = hit[np.concatenate([[0], breaks + 1])]
    ends = hit[np.concatenate([breaks, [len(hit) - 1]])] + 1
    out: list[list] = []  # start, end, sum before, sum after, the last earlier one with a smaller sum before
    for a, b, low, high in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist(), strict=True):
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                out.append([a, b, low, high, j])
                break
            a, low = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high, _ in out]


def passages(model: Model, text: str, most_expected: float = 0.01) -> list[tuple[int, int, float]]:
    """(first token, end token, surprise) of each passage of a text that chance would hardly bring."""
    s = model.scores(tokens(text), {})
    found = ((a, b, model.surprise(x, len(s))) for a, b, x in segments(s))
    return [(a, b, z) for a, b, z in found if z >= -math.log(most_expected)]


def count_features(rows: DataFrame) -> DataFrame:
    """(at, n0, n1): in how many clean and toxic documents each bucket's tokens and prefixes are; at -1: the documents' distinct tokens."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            at = list(set(n[0]) | set(n[1]))
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array([c[x] for x in at], pa.int64()) for c in n)], names=["at", "n0", "n1"])

        for whole in batches:
            for b in cut(whole, "text"):
                for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                    own = set(tokens(t or ""))
                    n[y > 0].update({bucket(x) for w in own for x in names_of(w)})
                    n[y > 0][-1] += len(own)
                if len(n[0]) + len(n[1]) > 300_000:
                    yield out()
                    n[0].clear()
                    n[1].clear()
        yield out()

    return rows.select("text", "y").mapInArrow(run, "at int, n0 long, n1 long").groupBy("at").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))


def best_segments(rows: DataFrame, model: Model) -> DataFrame:
    """(y, sums, n, gain): each text's segment scores and token count, and the mean of exp(lambda * score) at each of LAMBDAS."""
    told = rows.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = told.value, {}
        for whole in batches:
            for b in cut(whole, "text"):
                out = []
                for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                    s = m.scores(tokens(t or ""), known)
                    out.append((y, [x for *_, x in segments(s)], len(s), [float(np.exp(k * s).mean()) if len(s) else 1.0 for k in LAMBDAS]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.float64()) if i % 2 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=["y", "sums", "n", "gain"])

    return rows.select("text", F.col("y").cast("long").alias("y")).mapInArrow(run, "y long, sums array<double>, n long, gain array<double>")


#: Where the clean tokens' moment generating function is sampled; lambda is where it is 1.
LAMBDAS = [0.05 * k for k in range(1, 41)]


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y) on z, by Newton steps with a small ridge."""
    center, spread = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - center) / spread, np.ones_like(z)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w), -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * center / spread)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS) -> Model:
    """Token scores from two thirds of the training rows, calibration from the rest. What the driver gets is bounded by the training rows."""
    if most >= 1 << 16:
        raise ValueError("counts are kept in 16 bits: train on fewer than 65536 rows")
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, most)
    third = F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(3)) == 0
    counted = count_features(rows.where(~third)).toArrow()
    at, *n = (counted.column(c).to_numpy() for c in ("at", "n0", "n1"))
    n0, n1 = (int(x[at < 0].sum()) for x in n)
    clean, toxic = (np.zeros(BUCKETS, np.uint16) for _ in range(2))
    for held, x in zip((clean, toxic), n, strict=True):
        held[at[at >= 0]] = x[at >= 0]
    model = Model(clean, toxic, (n1 + 1) / (n0 + n1 + 2))
    held = best_segments(rows.where(third), model).toArrow()
    y, n, sums = held.column("y").to_numpy(), held.column("n").to_numpy(), held.column("sums").to_pylist()
    best = np.asarray([max(x, default=0.0) for x in sums])
    if not n1 or len(set(y.tolist())) < 2:
        model.slope, model.shift = (0.0, -50.0) if not n1 else (1.0, -4.0)
        return model
    calm = (y == 0) & (n > 0)
    if not calm.any():
        model.slope, model.shift = 1.0, -4.0
        return model
    gain = np.average(np.asarray(held.column("gain").to_pylist())[calm], axis=0, weights=n[calm])
    over = np.flatnonzero(gain >= 1)
    model.lam = LAMBDAS[int(over[0])] if len(over) else LAMBDAS[-1]
    # ln K: a Gumbel law with unit scale has its mean at Euler's constant above its location
    model.ln_k = float(np.median(model.lam * best[calm] - np.log(n[calm])) + math.log(math.log(2)))
    z = np.asarray([model.joint_surprise(b, int(k)) for b, k in zip(sums, n, strict=True)])
    model.slope, model.shift = logistic(z, y.astype(float))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passage_tokens) of each row."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int32()), ("passage_tokens", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = told.value, {}
        for whole in batches:
            for b in cut(whole, "t"):
                out = []
                for k, h, t in zip(*(b.column(c).to_pylist() for c in ("k", "h", "t")), strict=True):
                    s = m.scores(tokens(t), known)
                    found = segments(s)
                    p = m.probability([x for *_, x in found], len(s))
                    sure = [(a, e) for a, e, x in found if m.surprise(x, len(s)) >= 4.6]  # chance brings one in a hundred texts
                    out.append((k, h, p, int(p >= 0.5), len(sure), sum(e - a for a, e in sure)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    slim = docs.select(F.col(key).cast("long").alias("k"), (fold_of(F.col(key)) == 0).alias("h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int, passage_tokens long")


def clean_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, whole, that score() does not predict as toxic."""
    small_batches(docs.sparkSession)

    def judge(m: Model):
        known: dict[str, float] = {}

        def clean(t: str) -> bool:
            s = m.scores(tokens(t), known)
            return m.probability([x for *_, x in segments(s)], len(s)) < 0.5

        return lambda texts: [clean(t) for t in texts]

    return rows_kept(docs, docs.sparkSession.sparkContext.broadcast(model), judge, text)


def op3_segment_scan(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
