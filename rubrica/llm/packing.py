"""Best-fit packing of token pieces by pattern fitting.

Texts are tokenized and cut into pieces of at most `most` tokens. The histogram of piece lengths (at most `most` bins, whatever the
corpus) goes to the driver, which enumerates patterns of a few lengths that leave no room for any other, fits their repeat counts to the histogram by
non-negative least squares, rounds them within what the histogram holds, fits what is left again, and packs the residue by best fit. Where best fit
needs fewer sequences with a share of the repeats given back to it, it gets that share. The plan is a table of runs: ranks r0.. of length L go to sequences base.. at a given offset. Pieces are numbered within their length and look their
place up, so neither pieces nor sequences are ever gathered.

Nulls: a null or empty text is a single end token. Null ids and repeated rows are packed like others. Texts of any length are tokenized whole. Ties:
pieces alike in length, id and place may trade places. An empty table gives no row. Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import pieces as cut
from rubrica.llm.common import small_batches, tidy, written
from rubrica.llm.slots import block_count, numbered


@functools.cache
def tokenizer_at(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts with these aren't lowered before the tokenizer does it: characters whose lower case depends on their place or composes anew, and what could become a special token.
PLACED = re.compile(r"[Σİ\u0300-\u036f]|<\|")
#: A full stop or a comma after a letter or digit and before a space is a token group by itself; where one follows anything else, texts are searched mark by mark.
MARK = re.compile(r"(?<=[a-z0-9ß-öø-ÿ])([.,]) ")
OTHER_MARK = re.compile(r"[^a-z0-9ß-öø-ÿ][.,] ")


def word_list(text: str) -> list[str]:
    """Words whose ids, in turn, are those of the text: cut at spaces and, where that can't change them, lowered and freed of a closing mark. Others start with a newline, which the tokenizer drops."""
    text = text.replace("\n", " ")
    if "<|" in text if text.isascii() else PLACED.search(text) or not unicodedata.is_normalized("NFC", text):
        return [f"\n{w}" for w in text.split(" ")]
    text = text.lower()
    if OTHER_MARK.search(text) or text[:2] in (". ", ", "):
        return MARK.sub(r" \1 ", text).split(" ")
    return text.replace(". ", " . ").replace(", ", " , ").split(" ")


#: Marks that are a token group by themselves before and after a letter or a digit.
OPENING, CLOSING = "([{\"“„«*", ".,;:!?)]}\"…”»*#$%&"


def edges_cut(word: str) -> list[str]:
    """A word's opening marks, its core and its closing marks, where they are token groups of their own; else the word alone."""
    core = word.strip(OPENING + CLOSING)
    if not core or not (core[0].isalpha() and core[-1].isalpha()):
        return [word]
    lead, tail = word.split(core, 1)
    return [x for x in (lead, core, tail) if x] if all(x in OPENING for x in lead) and all(x in CLOSING for x in tail) else [word]


@functools.cache
def bare_tokenizer_at(path: str):
    """The tokenizer without its first steps, for words that those leave whole: the byte marks of lower-case letters in, ids out. None if it isn't of that kind."""
    own = tokenizer_at(path)
    names = [type(own.normalizer).__name__, type(own.pre_tokenizer).__name__, *(type(x).__name__ for x in (own.pre_tokenizer or ()) if own.pre_tokenizer is not None)]
    if names != ["Sequence", "Sequence", "Split", "ByteLevel"] or own.post_processor is not None:
        return None
    from tokenizers import Tokenizer

    bare = Tokenizer.from_file(path)
    bare.normalizer = bare.pre_tokenizer = None
    return bare


#: The printable stand-ins of bytes in byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_MARKS = dict(zip((b for b in range(256) if b not in set(PRINTED)), range(256, 512)))


class WordIds:
    """Ids of words, each encoded once while it is kept. Beyond `most` words, those of the latest texts stay and the rest is forgotten."""

    def __init__(self, path: str, most: int = 400_000):
        self.tok, self.bare, self.most = tokenizer_at(path), bare_tokenizer_at(path), most
        self.known: dict[str, bytes] = {"": b""}
        self.latest: set[str] = set()

    def learn(self, words: list[str]) -> None:
        known = self.known
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            if self.bare:
                plain = [w for w in part if w.isalpha() and w.islower()]
                marks = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_MARKS) for w in plain]
                for w, e in zip(plain, self.bare.encode_batch_fast(marks, add_special_tokens=False), strict=True):
                    known[w] = array("I", e.ids).tobytes()
                part = [w for w in part if w not in known]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers.

        The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids in turn.
        """
        if len(self.known) > self.most:
            self.known = {"": b""} | {w: self.known[w] for w in self.latest}
        known, split = self.known, [word_list(t) for t in texts]
        self.latest = set().union(*split)
        new = self.latest.difference(known)
        cuts = {w: x for w in new if not (w[0].isalpha() and w[-1].isalpha()) and len(x := edges_cut(w)) > 1}
        self.learn(list(new.difference(cuts).union(*cuts.values()).difference(known)))
        for w, x in cuts.items():
            known[w] = b"".join([known[p] for p in x])
        return [b"".join(map(known.__getitem__, words)) for words in split]


def token_bytes(path: str, texts: list[str]) -> list[bytes]:
    return WordIds(path).texts(texts)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each piece of each row's ids, the end token last."""
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for whole in batches:
            for batch in cut(whole, "t", 2 << 20):
                rows: list[tuple] = []
                for k, ids in zip(batch.column("k").to_pylist(), words.texts(batch.column("t").to_pylist()), strict=True):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * most)):
                        x = ids[at : at + 4 * most]
                        rows.append((k, p, at // 4, len(x) // 4, zlib.crc32(x)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    slim = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Pattern:
    """parts: (length, how many) in order of place; repeats: sequences of this shape."""

    parts: list[tuple[int, int]]
    repeats: int


def enumerate_patterns(present: np.ndarray, most: int, turn: int = 0, gap: int = 0, seconds: int = 12, thirds: int = 4) -> np.ndarray:
    """Rows of up to four lengths (0: none), longest first, that fill a sequence but for `gap` at most.

    For each length `seconds` partners, and for each two `thirds` more, are drawn evenly from those that fit, others in each turn, and the longest that fits is taken
    too; the fourth is the longest that fits what is left.
    """
    have = np.zeros(most + 1, bool)
    have[present] = have[0] = True
    floor = np.maximum.accumulate(np.where(have, np.arange(most + 1), 0))  # the longest length there is, up to each
    rng, out = np.random.default_rng(turn), []
    for a in present[::-1]:
        rest = most - a
        fits = present[present <= min(a, rest)]
        if not len(fits):
            continue
        n = min(seconds, len(fits))
        b = np.unique(np.append(fits[((np.arange(n) + rng.random()) * len(fits) / n).astype(int)], fits[-1]))
        left = rest - b
        n = np.searchsorted(present, np.minimum(left, b), side="right")[:, None]
        c = present[np.clip(((np.arange(thirds) + rng.random((len(b), thirds))) * n / thirds).astype(int), 0, np.maximum(n - 1, 0))]
        c = np.concatenate([np.where(n > 0, c, 0), floor[np.minimum(left, b)][:, None]], 1)
        b, left = np.broadcast_to(b[:, None], c.shape), np.broadcast_to(left[:, None], c.shape)
        d = floor[np.minimum(left - c, c)]
        full = left - c - d <= gap
        out.append(np.stack([np.full(int(full.sum()), a), b[full], c[full], d[full]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), int)


def fit(patterns: np.ndarray, hist: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: non-negative least squares by accelerated projected gradient."""
    n = len(hist)
    real = patterns > 0
    weight = np.arange(n) / (n - 1.0)  # a long piece that is left costs more than a short one
    use = lambda x: np.bincount(patterns[real], np.broadcast_to(x[:, None], patterns.shape)[real], n)
    norm = use(np.ones(len(patterns)))
    step = 1.0 / max(1e-9, 4.0 * float((norm * weight**2).max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        g = ((use(y) - hist) * weight**2)[patterns] * real
        nx = np.maximum(0, y - step * g.sum(1))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nx + (t - 1) / nt * (nx - x), nx, nt
    return x


def best_fit(hist: np.ndarray, most: int) -> list[Pattern]:
    """Best fit on a histogram, longest lengths first; equal sequences are kept as one with a count."""
    free: list[list[Pattern]] = [[] for _ in range(most + 1)]
    some = np.zeros(most + 1, bool)

    def put(p: Pattern, left: int) -> None:
        free[left].append(p)
        some[left] = True

    for length in range(most, 0, -1):
        n = int(hist[length])
        while n:
            where = np.flatnonzero(some[length:])
            left = int(where[0]) + length if len(where) else most
            own = free[left].pop() if len(where) else Pattern([], n)
            if len(where) and not free[left]:
                some[left] = False
            m = min(left // length, n)
            k = min(own.repeats, n // m)
            if own.repeats > k and len(where):
                put(Pattern(own.parts, own.repeats - k), left)
            put(Pattern([*own.parts, (length, m)], k), left - m * length)
            n -= m * k
    return [p for group in free for p in group]


#: Of the lengths up to an eighth of a sequence this share waits for best fit, which closes its gaps with them.
WAITING = 0.5
#: Fits that follow one another; the next one is made while so large a share of the pieces is left.
TURNS, LEFT = 2, 0.25


def fitted(hist: np.ndarray, most: int) -> list[Pattern]:
    """Patterns by least squares, in turns: the counts are rounded so that their running sum stays within a half, held to what the histogram has, and what is left is fitted again by other patterns. Takes its pieces out of hist."""
    plan: list[Pattern] = []
    waiting = np.zeros_like(hist)
    waiting[: most // 8] = (hist[: most // 8] * WAITING).astype(np.int64)
    # Pieces of more than half a sequence need one each; only so many sequences as the tokens ask for beyond those may go without
    without = max(0, -(-int(hist @ np.arange(most + 1)) // most) - int(hist[most // 2 + 1 :].sum()))
    hist -= waiting
    total = hist.sum()
    for turn in range(TURNS):
        some = np.flatnonzero(hist + waiting)
        pats = enumerate_patterns(np.flatnonzero(hist), most, turn, int(some[0]) - 1 if len(some) else 0)
        if not len(pats):
            break
        x = fit(pats, hist.astype(float))
        order = np.lexsort((-x, -pats[:, 0]))
        sums = np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64)
        times = np.diff(sums, prepend=0)
        for i, k in zip(order[times > 0].tolist(), times[times > 0].tolist(), strict=True):
            parts = [(int(v), int(m)) for v, m in zip(*np.unique(pats[i][pats[i] > 0], return_counts=True), strict=True)][::-1]
            large = 2 * parts[0][0] > most
            k = min(k, k if large else without, *(int(hist[v]) // m for v, m in parts))
            if k:
                plan.append(Pattern(parts, k))
                without -= 0 if large else k
                for v, m in parts:
                    hist[v] -= m * k
        if hist.sum() <= LEFT * total:
            break
    hist += waiting
    return plan


#: Shares of the patterns' repeats that are tried, the largest first; at 0 best fit packs all.
KEPT = (1.0, 0.98, 0.9, 0.75, 0.5, 0.25, 0.0)


def fewest(hist: np.ndarray) -> int:
    """No plan has fewer sequences: the tokens ask for as many, and pieces of over half a sequence need one each."""
    most = len(hist) - 1
    return max(-(-int(hist @ np.arange(most + 1)) // most), int(hist[most // 2 + 1 :].sum()))


def repaired(hist: np.ndarray, plan: list[Pattern], most: int) -> list[Pattern]:
    """The plan and best fit of what it leaves, with as many of its repeats given back to best fit as make for the fewest sequences.

    Rounding and a residue of few lengths can cost sequences. The shares in KEPT are tried until none can be better; of equal ones the largest stays, so
    the result is never worse than best fit alone.
    """
    best, least = None, fewest(hist)
    for share in KEPT:
        some = [Pattern(p.parts, int(p.repeats * share)) for p in plan if int(p.repeats * share)]
        left = hist.copy()
        for p in some:
            for length, m in p.parts:
                left[length] -= m * p.repeats
        whole = [*some, *best_fit(left, most)]
        n = sum(p.repeats for p in whole)
        if best is None or n < best[0]:
            best = n, whole
        if n <= least:
            break
    return best[1]


def pack_histogram(counts: dict[int, int], most: int) -> list[Pattern]:
    """Patterns that hold every piece of the histogram exactly once: full pieces alone, then fitted patterns, then best fit of the residue."""
    hist = np.zeros(most + 1, np.int64)
    for length, n in counts.items():
        hist[length] = n
    full = [Pattern([(most, 1)], int(hist[most]))] if hist[most] else []
    hist[most] = 0
    return [*full, *repaired(hist, fitted(hist.copy(), most), most)]


def runs_of(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """The plan as runs, sorted by length and first rank: pieces r0 .. of a length go, `m` to a sequence, to sequences base .. from place `at`."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for p in plan:
        at = 0
        for length, m in p.parts:
            r0 = rank.get(length, 0)
            rows.append((length, r0, m, base, at))
            rank[length] = r0 + m * p.repeats
            at += length * m
        base += p.repeats
    rows.sort()
    cols = np.asarray(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "r0", "m", "base", "at"), cols, strict=True))


RANK_BITS = 50


def place(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset. The histogram and the runs are bounded by `most` and the pattern count, not by the corpus."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    runs = spark.sparkContext.broadcast(runs_of(pack_histogram(counts, most)))
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = numbered(pieces, ["length"], keys, "rank", block_count(max(counts.values(), default=0), least=8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        heads = (r["length"] << RANK_BITS) | r["r0"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(heads, (length << RANK_BITS) | rank, side="right") - 1
            nth = rank - r["r0"][i]
            seq, off = r["base"][i] + nth // r["m"][i], r["at"][i] + nth % r["m"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row, in as few sequences as the plan finds."""
    return place(written(token_pieces(docs, tokenizer, most, end_id, key, text), "pieces"), most)


def op10_pattern_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rubrica.llm.common import read

    return pack(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
