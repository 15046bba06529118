"""Near copies by SimHash fingerprints of 64 bits, found with the pigeonring filter.

A fingerprint is a ring of 8 segments of 8 bits. If two differ in at most 4 bits, then some segment starts a chain whose first l segments differ in at most
floor(l * 4 / 8) bits, for every l from 1 to 8: the budgets are in proportion. The filter asks for such a chain before it counts all bits.

1. Rows get fingerprints; rows with one fingerprint are one from there on, so copies cost nothing further.
2. The first segment of a chain has a budget of none and the two after it of one bit together, so one of those is equal as well. Fingerprints meet in a shuffle by
   (start, which of the two is equal, both equal segments): 16 keys for each.
3. A key that many fingerprints have is replaced by keys of its chains' first 7 segments, of which 4 are equal, 32 bits instead of 16. What is still large
   is dealt into blocks, and every two blocks meet. So no task holds more than a bounded number of fingerprints of a key, and no pair is lost.
4. Those that meet are held to the rest of the chain's budgets, then to the full Hamming distance. In a large group a search goes out from one
   fingerprint at a time to those not reached yet, so a dense group costs about its size, and links come as a forest, at most one for each member.
5. Links give the components of the fingerprints, and the smallest doc_id in each.

Nulls: a null or empty text, or one of white space alone, has the fingerprint zero and links like any other. A null id takes part; a component's id is its smallest id that isn't null, or
null if it has none. Texts of any length are read whole. Ties: rows with equal fingerprints link; a bit that is set in exactly half the hashes is 0. Rows that
repeat an id or text are rows like others. An empty table gives no row. Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import forget, read, small_batches, tidy, written
from rubrica.llm.common import pieces as cut
from rubrica.llm.components import components
from rubrica.llm.jaccard import hinted

U = np.uint64
SEED = 42
#: Segments of the ring, and bits of one.
SEGMENTS, WIDTH = 8, 8
#: Segments of the chain that a key looks at, and of the longer one for keys that many fingerprints have.
SHORT, LONG = 3, 7
#: Fingerprints of a key in one task at most, or of a block of it.
CROWD = 20_000
#: Groups up to this size are compared pair by pair, all groups of a batch at once.
SMALL = 48


def fingerprint(text: str | None, k: int = 4) -> int:
    """The SimHash of the k-word shingles of a text, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - min(k, len(words)) + 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[len(words) - n :].tolist(), strict=True)), U, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a long."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in cut(whole, "t"):
                fps = np.fromiter((fingerprint(t, k) for t in b.column("t").to_pylist()), U, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def budget(length: int, most: int) -> int:
    """Bits in which the first `length` segments of a chain may differ."""
    return length * most // SEGMENTS


def unequal(length: int, most: int) -> list[tuple[int, ...]]:
    """The largest sets of segments of a chain, counted from its start, that may be unequal within its budgets; a chain's own are in one of them."""
    return [d for d in combinations(range(1, length), budget(length, most)) if all(sum(x < n for x in d) <= budget(n, most) for n in range(1, length + 1))]


def chain_key(start: int, length: int, which: int, out: tuple[int, ...]) -> Column:
    """A long for a start, the number `which` of a set of unequal segments, and the values of the segments that must be equal."""
    key = F.lit(start << 8 | which).cast("long")
    for x in range(length):
        if x not in out:
            seg = F.shiftrightunsigned("fp", WIDTH * ((start + x) % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
            key = F.shiftleft(key, WIDTH).bitwiseOR(seg)
    return key


def short_keys(fps: DataFrame, most: int) -> DataFrame:
    """(fp, start, out, key): out is the first of the unequal segments that the key allows."""
    each = [F.struct(F.lit(s).alias("start"), F.lit(o[0]).alias("out"), chain_key(s, SHORT, i, o).alias("key")) for s in range(SEGMENTS) for i, o in enumerate(unequal(SHORT, most))]
    return fps.select("fp", F.explode(F.array(*each)).alias("x")).select("fp", "x.*")


def long_keys(crowded: DataFrame, most: int) -> DataFrame:
    """The keys of longer chains that go on from rows of short_keys; a set without an unequal segment up to SHORT goes on from one of them."""
    sets = unequal(LONG, most)
    first = unequal(SHORT, most)[0][0]

    def goes_on(o: tuple[int, ...], x: int) -> bool:
        early = [y for y in o if y < SHORT]
        return early == [x] or (not early and x == first)

    def keys(s: int, x: int) -> Column:
        return F.array(*[F.struct(F.lit(s).alias("start"), F.lit(x).alias("out"), chain_key(s, LONG, i, o).alias("key")) for i, o in enumerate(sets) if goes_on(o, x)])

    told = None
    for s in range(SEGMENTS):
        for (x,) in unequal(SHORT, most):
            here = (F.col("start") == s) & (F.col("out") == x)
            told = F.when(here, keys(s, x)) if told is None else told.when(here, keys(s, x))
    return crowded.select("fp", F.explode(told).alias("x")).select("fp", "x.*")


def masks(start: int, length: int) -> int:
    return sum(((1 << WIDTH) - 1) << (WIDTH * ((start + x) % SEGMENTS)) for x in range(length))


class Ring:
    """The checks of a chain, each tighter than the one before: budgets of growing lengths, then the full distance."""

    def __init__(self, most: int):
        # A length with the budget of the next one asks for nothing that the next doesn't
        lengths = [n for n in range(1, SEGMENTS) if budget(n, most) < budget(n + 1, most)]
        self.steps = [(np.asarray([masks(s, n) for s in range(SEGMENTS)], U), budget(n, most)) for n in lengths]
        self.most = most

    def passed(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Places of the pairs that pass; the filter's steps drop pairs before the full check."""
        left, d = np.arange(len(a)), a ^ b
        for mask, most in self.steps:
            ok = np.bitwise_count(d & mask[start]) <= most
            left, d, start = left[ok], d[ok], start[ok]
        return left[np.bitwise_count(d) <= self.most]

    def small(self, fps: np.ndarray, group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the linked pairs within groups; fps are sorted by group."""
        ends = np.searchsorted(group, group, side="right")
        found, at, ahead = [], np.arange(len(fps)), 1
        while len(at := at[at + ahead < ends[at]]):
            ok = self.passed(fps[at], fps[at + ahead], start[at])
            found.append((at[ok], at[ok] + ahead))
            ahead += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def large(self, fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """A forest of the links of one group, as places: from each fingerprint to those that no search has reached yet."""
        left, found = np.arange(len(fps)), []
        while len(left) > 1:
            queue, left = [left[:1]], left[1:]
            while queue and len(left):
                front = queue.pop()
                if len(front) > 64:
                    queue.append(front[64:])
                    front = front[:64]
                i, j = np.divmod(np.arange(len(front) * len(left)), len(left))
                ok = self.passed(fps[front[i]], fps[left[j]], np.full(len(i), start))
                if not len(ok):
                    continue
                reached, first = np.unique(j[ok], return_index=True)
                found.append((front[i[ok]][first], left[reached]))
                queue.append(left[reached])
                left = np.delete(left, reached)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches over the pairs."""
    up = np.arange(n)
    while len(i):
        least = np.minimum(up[i], up[j])
        new = up.copy()
        for x in (i, j, up[i], up[j]):
            np.minimum.at(new, x, least)
        new = new[new]
        i, j = i[new[i] != new[j]], j[new[i] != new[j]]
        if (new == up).all() and not len(i):
            break
        up = new
    while (up[up] != up).any():
        up = up[up]
    return up


def compared(meeting: DataFrame, most: int) -> DataFrame:
    """(a, b): links between fingerprints that meet under (key, i, j), as a forest of each batch of groups."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, held, rows = Ring(most), [], 0

        def search(b: pa.Table):
            # Where a group begins
            cols = [b.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            group = np.cumsum(new) - 1
            fps, start = b.column("fp").to_numpy().view(U), b.column("start").to_numpy().astype(np.int64)
            size = np.bincount(group)
            some = np.flatnonzero((size[group] > 1) & (size[group] <= SMALL))
            i, j = ring.small(fps[some], group[some], start[some])
            pairs = [(some[i], some[j])]
            firsts = np.flatnonzero(new)
            for g in np.flatnonzero(size > SMALL):
                a = firsts[g]
                i, j = ring.large(fps[a : a + size[g]], int(start[a]))
                pairs.append((a + i, a + j))
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            # The same fingerprint has many keys, so links are told between fingerprints, not rows
            nodes, at = np.unique(np.concatenate([fps[i], fps[j]]), return_inverse=True)
            up = forest(len(nodes), at[: len(i)], at[len(i) :])
            own = np.flatnonzero(up != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[up[own]].view(np.int64)), pa.array(nodes[own].view(np.int64))], names=["a", "b"])

        def whole_groups(last: bool):
            """The held rows but for the last group, which may go on."""
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            keys = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            goes_on = np.logical_and.reduce([c == c[-1] for c in keys])
            end = t.num_rows if last else int(np.argmax(goes_on))
            held, rows = t.slice(end).combine_chunks().to_batches(), t.num_rows - end
            return t.slice(0, end)

        at_least = 1 << 18
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= at_least:
                done = whole_groups(False)
                at_least = max(1 << 18, 2 * rows)
                if done.num_rows:
                    yield from search(done)
        if rows:
            yield from search(whole_groups(True))

    return meeting.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, most: int = 4, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect all fingerprints which most bits or fewer tell apart; fps: distinct, read several times. A table in the shared folder."""
    if any(len(o) != 1 for o in unequal(SHORT, most)):
        raise ValueError(f"keys are made for distances that give {SHORT} segments a budget of one bit, not for {most}")
    keyed = short_keys(fps, most)
    none = F.lit(0).alias("i"), F.lit(0).alias("j")
    crowds = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "ring-crowds")
    n = crowds.count()
    if not n:
        out = written(compared(keyed.select("key", *none, "start", "fp"), most), "ring-links")
        forget(crowds)
        return out
    crowds = hinted(crowds, n)
    few = compared(keyed.join(crowds, "key", "left_anti").select("key", *none, "start", "fp"), most)
    longer = long_keys(keyed.join(crowds, "key"), most)
    still = written(longer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "ring-blocks")
    dealt = longer.join(hinted(still, still.count()), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("key", "start", "fp", own.alias("own"), other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "start", "fp")
    out = written(few.union(compared(tiles, most)), "ring-links")
    forget(crowds, still)
    return out


def near_copies(docs: DataFrame, k: int = 4, most: int = 4, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row, as a table in the shared folder."""
    rows = written(fingerprints(docs, k, key, text), "ring-rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("top"), F.count(F.lit(1)).alias("members")), "ring-fingerprints")
    edges = links(fps.select("fp"), most, crowd)
    labels = components(edges)
    tops = labels.join(fps, F.col("node") == F.col("fp")).groupBy("label").agg(F.min("top").alias("top"))
    linked = labels.join(tops, "label").select(F.col("node").alias("fp"), "top")
    # Written, so that the join below has a fingerprint's many rows on one side and its single row on the other, which adaptive execution may split
    alone = fps.where("members > 1").join(labels.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "top")
    told = written(linked.union(alone), "ring-told")
    out = rows.join(hinted(told, told.count()), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("top", "doc_id").alias("component_id"))
    out = written(out, "ring-components")
    forget(rows, fps, edges, labels, told)
    return out


def op13_pigeonring(spark, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents"))
