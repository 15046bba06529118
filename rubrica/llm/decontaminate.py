"""Benchmark decontamination by BM25 with block-max WAND.

Test items, cut into units of at most `unit` words, are an inverted index. Every document is cut into overlapping passages that hold any
run of `unit` words whole, and each passage is a query: all units whose BM25 score reaches `least` of the score they give themselves are
retrieved. Impacts are stored as shares of that self-score, so one threshold holds for all units. The sums of a passage's list
maxima, over all units and over spans of them, are worked out for many passages at once: below the threshold WAND would find no pivot. What
remains goes through block-max WAND. A document and
an item that meet are then compared word for word: five-word shingles of the item's question and of its answer in the whole document.

The index of a block of items is broadcast: a block holds ITEMS_AT_ONCE items and BYTES_AT_ONCE bytes of text at most, and further blocks
are further scans. Document frequencies and lengths are those of all items.

Nulls: null and empty texts match nothing, on either side. Null ids are kept. Texts of any length are searched whole. Ties: a passage at the threshold exactly is
retrieved. Repeated rows are judged one by one, on both sides. Without documents or items there is no row. Extra columns are not carried, so their names can't
clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import rows_kept, small_batches, tidy
from rubrica.llm.common import pieces as cut

WORD = re.compile(r"\w+")
SHINGLE = 5
ITEMS_AT_ONCE = 20_000
BYTES_AT_ONCE = 32 << 20
POSTINGS_IN_BLOCK = 16
SPANS = 64
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: parted at its last question mark, or else before its last sentence, or else after two thirds of its words."""
    at = text.rfind("?") + 1
    if at and words_of(text[at:]) and words_of(text[:at]):
        return text[:at], text[at:]
    ends = [m.end() for m in re.finditer(r"[.!…\n]", text) if words_of(text[m.end() :]) and words_of(text[: m.end()])]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    spans = [m.start() for m in WORD.finditer(text)]
    at = spans[2 * len(spans) // 3] if len(spans) > 1 else len(text)
    return text[:at], text[at:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class Index:
    """Postings of the units of a block of items, by term; within a term by unit, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n_units: int, mean: float, unit: int):
        self.items, self.unit = items, unit
        units = [(i, w[s : s + unit]) for i, (_, t) in enumerate(items) for w in [words_of(t)] for s in starts(len(w), unit)]
        self.item_of = [i for i, _ in units]
        idf = {t: math.log(1 + (n_units - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        lists: dict[str, list[tuple[int, float]]] = {}
        for u, (_, w) in enumerate(units):
            own = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            whole = sum(own.values())
            for t, x in own.items():
                lists.setdefault(t, []).append((u, x / whole))
        self.terms = {t: k for k, t in enumerate(lists)}
        self.units = [[u for u, _ in p] for p in lists.values()]
        self.impacts = [[x for _, x in p] for p in lists.values()]
        self.most = np.asarray([max(p) for p in self.impacts]) if lists else np.zeros(0)
        # The same by spans of units: a passage whose list maxima would do must also find them together in one span
        self.spans = np.zeros((len(lists), min(SPANS, max(1, len(units)))), np.float32)
        for t, (own, x) in enumerate(zip(self.units, self.impacts, strict=True)):
            np.maximum.at(self.spans[t], np.asarray(own) * self.spans.shape[1] // len(units), np.asarray(x, np.float32))
        self.block_last = [[p[min(i + POSTINGS_IN_BLOCK, len(p)) - 1] for i in range(0, len(p), POSTINGS_IN_BLOCK)] for p in self.units]
        self.block_most = [[max(p[i : i + POSTINGS_IN_BLOCK]) for i in range(0, len(p), POSTINGS_IN_BLOCK)] for p in self.impacts]

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(unit, score) of all units that score `least` or more for a query of distinct terms: block-max WAND."""
        end = len(self.item_of)
        at = dict.fromkeys(terms, 0)
        block = dict.fromkeys(terms, 0)
        unit = {t: self.units[t][0] for t in terms}
        out = []

        def advance(t: int, to: int) -> None:
            """Moves t's cursor to its first unit at or after `to`, by blocks first."""
            last, own, b = self.block_last[t], self.units[t], block[t]
            while b < len(last) and last[b] < to:
                b += 1
            i = max(at[t], b * POSTINGS_IN_BLOCK)
            while i < len(own) and own[i] < to:
                i += 1
            at[t], block[t] = i, min(b, len(last) - 1)
            unit[t] = own[i] if i < len(own) else end

        while True:
            order = sorted(terms, key=unit.__getitem__)
            total, pivot = 0.0, end
            for n, t in enumerate(order):
                if unit[t] == end:
                    break
                total += self.most[t]
                if total >= least - 1e-9:
                    pivot = unit[t]
                    break
            if pivot == end:
                return out
            while n + 1 < len(order) and unit[order[n + 1]] == pivot:
                n += 1
            bound, until = 0.0, unit[order[n + 1]] if n + 1 < len(order) else end
            for t in order[: n + 1]:  # the blocks where the pivot would be
                last, b = self.block_last[t], block[t]
                while b < len(last) and last[b] < pivot:
                    b += 1
                if b < len(last):
                    bound += self.block_most[t][b]
                    until = min(until, last[b] + 1)
            if bound < least - 1e-9:  # no unit up to the end of these blocks can do
                to = max(until, pivot + 1)
                for t in order[: n + 1]:
                    if unit[t] < to:
                        advance(t, to)
                continue
            score = 0.0
            for t in order[: n + 1]:
                if unit[t] < pivot:
                    advance(t, pivot)
                if unit[t] == pivot:
                    score += self.impacts[t][at[t]]
            if score >= least - 1e-9:
                out.append((pivot, score))
            for t in order[: n + 1]:
                if unit[t] == pivot:
                    advance(t, pivot + 1)


def starts(n: int, unit: int) -> list[int]:
    """Where the units of n words start; the last unit reaches back to be whole."""
    if n <= unit:
        return [0] if n else []
    return sorted({*range(0, n - unit, unit), n - unit})


class Scanner:
    """A worker's view of an index: passages of documents in, verified matches out."""

    def __init__(self, index: Index, least: float, overlap: float, each: float):
        self.x, self.least, self.overlap, self.each = index, least, overlap, each
        self.sides = [tuple(shingles(words_of(p)) for p in question_and_answer(t)) for _, t in index.items]

    def candidates(self, docs: list[list[str]]) -> dict[tuple[int, int], float]:
        """(document, item): best share of a unit's self-score, of all passages."""
        x, step = self.x, self.x.unit
        get = x.terms.get
        lengths = [len(w) for w in docs]
        term = np.fromiter((get(t, -1) for w in docs for t in w), np.int64, sum(lengths))
        doc = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hit = term >= 0
        term, doc, place = term[hit], doc[hit], place[hit] // step
        # A passage is two steps long, so that every run of a step's words lies in one whole
        per = int(place.max()) + 2 if len(place) else 1
        code = (doc * per + place + 1) * len(x.terms) + term
        code = np.unique(np.concatenate([code, (code - len(x.terms))]))
        passage, term = np.divmod(code, max(1, len(x.terms)))
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(code) else np.zeros(0, int)
        bound = np.add.reduceat(x.most[term], first) if len(first) else np.zeros(0)
        ends = np.append(first[1:], len(code))
        out: dict[tuple[int, int], float] = {}
        for i in self.hopeful(term, first, ends, np.flatnonzero(bound >= self.least - 1e-9)):
            d = int(passage[first[i]]) // per
            for u, s in x.retrieve(term[first[i] : ends[i]].tolist(), self.least):
                pair = (d, x.item_of[u])
                out[pair] = max(s, out.get(pair, 0.0))
        return out

    def hopeful(self, term: np.ndarray, first: np.ndarray, ends: np.ndarray, some: np.ndarray, at_once: int = 40_000) -> Iterator[int]:
        """Those of the passages `some` whose terms' largest impacts within one span of units add up to enough."""
        sizes = ends[some] - first[some]
        part = (np.cumsum(sizes) - sizes) // at_once
        for own in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []:
            n = ends[own] - first[own]
            heads = np.cumsum(n) - n
            flat = np.arange(int(n.sum())) - np.repeat(heads, n) + np.repeat(first[own], n)
            best = np.add.reduceat(self.x.spans[term[flat]], heads, axis=0).max(1)
            yield from own[best >= self.least - 1e-4].tolist()

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) of verified matches."""
        docs = [words_of(t) for t in texts]
        held: dict[int, dict[int, set]] = {}
        for (d, i), score in sorted(self.candidates(docs).items()):
            if d not in held:
                held = {d: {}}

            def share(part: set, w: list[str] = docs[d], own: dict[int, set] = held[d]) -> tuple[int, int]:
                if not part:
                    return 0, 0
                n = len(next(iter(part)))
                if n not in own:
                    own[n] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                return len(part & own[n]), len(part)

            (q, nq), (a, na) = map(share, self.sides[i])
            if nq + na and q + a >= self.overlap * (nq + na) and q >= self.each * nq and a >= self.each * na:
                yield d, i, score, q / nq if nq else 1.0, a / na if na else 1.0


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of bounded number and size, as they come."""
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and (len(block) >= ITEMS_AT_ONCE or size + len(r["t"]) > BYTES_AT_ONCE):
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def unit_terms(items: DataFrame, unit: int) -> DataFrame:
    """(term, n): in how many units each term is; term null: the number of units and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            units = words = 0
            for t in b.column("t").to_pylist():
                w = words_of(t)
                for s in starts(len(w), unit):
                    own = w[s : s + unit]
                    n.update(set(own))
                    units, words = units + 1, words + len(own)
            yield pa.RecordBatch.from_arrays([pa.array([None, *n], pa.string()), pa.array([units, *n.values()], pa.int64()), pa.array([words, *[0] * len(n)], pa.int64())], names=["term", "n", "words"])

    return items.mapInArrow(run, "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def indexes(benchmark: DataFrame, unit: int, item_key: str, item_text: str) -> Iterator[Broadcast]:
    """An index of each block of items, sent to all workers."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    counts = unit_terms(items, unit).cache()
    whole = counts.where("term IS NULL").first()
    for block in item_blocks(items):
        own = sorted({t for _, text_ in block for t in words_of(text_)})
        terms = spark.createDataFrame(pa.table({"term": pa.array(own, pa.string())}))
        df = {r["term"]: r["n"] for r in counts.join(F.broadcast(terms), "term").collect()}
        yield spark.sparkContext.broadcast(Index(block, df, whole["n"], whole["words"] / max(1, whole["n"]), unit))
    counts.unpersist()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.8, each: float = 0.5, unit: int = 64, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and item that match.

    They match if a passage retrieves the item and the document holds `overlap` of the item's shingles and `each` of those of its question and of its answer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    shape = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
    out = spark.createDataFrame([], shape)
    for index in indexes(benchmark, unit, item_key, item_text):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], told=index) -> Iterator[pa.RecordBatch]:
            scan = Scanner(told.value, least, overlap, each)
            for all_ in batches:
                for b in cut(all_, "t"):
                    ids = b.column("k").to_pylist()
                    rows = [(ids[d], scan.x.items[i][0], s, q, a) for d, i, s, q, a in scan.matches(b.column("t").to_pylist())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        out = out.union(slim.mapInArrow(run, shape))
    return out


def leak_free_rows(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.8, each: float = 0.5, unit: int = 64, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, whole, that match no item as contaminated() counts matches."""
    small_batches(docs.sparkSession)

    def judge(index: Index):
        scan = Scanner(index, least, overlap, each)

        def keep(texts: list[str]) -> list[bool]:
            found = {d for d, *_ in scan.matches(texts)}
            return [d not in found for d in range(len(texts))]

        return keep

    for index in indexes(benchmark, unit, item_key, item_text):
        docs = rows_kept(docs, index, judge, text)
    return docs


def op1_block_max_wand(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
