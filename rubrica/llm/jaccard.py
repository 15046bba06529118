"""Exact n-gram Jaccard join with signature trees.

1. Each text becomes the set of its hashed k-word shingles. Equal sets are one class, so copies cost nothing further.
2. Each set is cut by hash range into so many parts that sets as similar as asked differ in fewer parts than they have: they share a part
   that is equal and not empty. A set tells only as many of its parts, those of most shingles, as make sure of one in common. Equal parts meet in a shuffle of (part hash, class) pairs, packed into blobs. Only who meets whom at last
   matters, so every task keeps a forest: a map task sends one root for each part hash and an edge from each class to its root, and so
   does the task where hashes meet. Edges are at most the classes of a task, whatever groups there are. The few sets with too many empty parts all
   meet under one hash for their sizes. This loses no pair.
3. Classes that meet in a band of sizes form that band's candidate clusters (connected components), so a passage that texts of all lengths
   share makes no cluster of all of them. A cluster is one tile, a large cluster is dealt into blocks of bounded size and every two blocks are a
   tile. A pair is looked at in the band of its smaller set only.
4. In a tile, sets are the leaves of a signature tree, in order of their least shingles, so that like sets stand together: nodes hold the OR
   of their sets' bitmaps, their size range and how far a set's size exceeds its bits. Dual traversal drops two nodes unless sets below them could
   overlap enough; leaves that remain are intersected exactly. `tree_work` counts the node pairs that were seen and dropped.
5. Links give the components of the classes, and the smallest id in each.

Sets are compared by 64-bit hashes: for a corpus of 10^9 different texts, the chance that two of them count as equal is about 3 %.
Nulls: a null or empty text, or one of white space alone, has an empty set, no link, and is its own component. Null ids take part; a component's
id is its smallest id that isn't null, or null if it has none. Texts of any length are read whole. Ties: equal sets are one class, and which of its rows stands for
it doesn't show in the result. Rows that repeat an id or text are rows like others. An empty table gives no row. Extra columns are not
carried, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import forget, small_batches, tidy, written
from rubrica.llm.common import pieces as cut
from rubrica.llm.components import components

U = np.uint64
#: Odd multipliers for the words of a shingle, drawn by a rule.
STEP, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Word hashes that a task keeps; it only saves time.
WORDS_KEPT = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def shingles(text: str | None, k: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text. known: word hashes to look up and add to."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six spaces only
    if not words:
        return np.zeros(0, U)
    known = {} if known is None else known
    if len(known) > WORDS_KEPT:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = min(k, len(h))
    x = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        x = x * STEP + h[i : len(h) - n + 1 + i]
        x ^= x >> U(29)
    return np.unique(mixed(x))


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Parts:
    """How sets of each size are cut, for a similarity of num / den at least.

    Sizes fall into bands; sizes that can link are in the same band or in neighbouring ones, so a set is cut for its own band and for the one
    below. Sets that link differ in at most `differ` shingles, the least of what the band and the set's own size allow, and so in as many parts. Of its
    parts a set tells `differ` + 1, the ones of most shingles: what it leaves out comes first in an order that all sets have in common, so of the parts that
    two linked sets share, more than either leaves out, both tell the last. Parts of a shingle or two, which texts share by a common phrase, are
    nearly all left out; they made one cluster of a good part of a corpus.
    """

    #: Parts for each shingle that may differ.
    GROWTH = (13, 10)

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.last = [0]  # the largest size of each band

    def band(self, n: int) -> int:
        while self.last[-1] < n:
            self.last.append((self.last[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.last, n))

    def hashes(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(band, part hashes) of a set, for its own band and the one below."""
        own = self.band(len(s))
        told = []
        for f in {own, max(1, own - 1)}:
            most, mine = (n * (self.den - self.num) // self.num for n in (self.last[f], len(s)))
            differ = min(most, mine)
            parts = most * self.GROWTH[0] // self.GROWTH[1] + 6
            part = ((s >> U(32)) * U(parts)) >> U(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            salt = U(((f << 32) + 1) * int(STEP) % (1 << 64))
            out = mixed(np.add.reduceat(s, starts) + mixed(part[starts] + salt))
            if len(starts) <= differ:
                out = np.append(out, mixed(np.asarray([salt], U)))
            else:
                rank = np.minimum(np.diff(np.append(starts, len(s))), 255).astype(U) << U(56) | out >> U(8)
                out = out[np.argpartition(rank, len(out) - differ - 1)[len(out) - differ - 1 :]]
            told.append((f, out))
        return told


def band_mark(f: int) -> int:
    """What turns a class into its node of band f, by exclusive or."""
    return int(signed(mixed(np.asarray([f], U)))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def forest(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that share a hash are joined: (distinct hashes in order, the root of each, a (root, key) pair of each key that is no root). A root is the least key it reaches."""
    order = np.argsort(hashes, kind="stable")
    h, k = hashes[order], keys[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    nodes, at = np.unique(k, return_inverse=True)
    label = np.arange(len(nodes))
    some = np.bincount(group, minlength=1)[group] > 1
    g, n = group[some], at[some]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(g)))
    while len(g):
        new = label.copy()
        np.minimum.at(new, n, np.repeat(np.minimum.reduceat(label[n], starts), sizes))
        new = new[new]
        if (new == label).all():
            break
        label = new
    roots = nodes[label]
    moved = roots != nodes
    return h[first], roots[at][first], np.stack([roots[moved], nodes[moved]], 1)


MET = "kind int, bucket int, a long, b long, n long, t long, hashes binary, keys binary"
MET_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("t", pa.int64()), ("hashes", pa.binary()), ("keys", pa.binary())])


def met_rows(kind: int, rows: int, **cols) -> pa.RecordBatch:
    full = {f.name: cols[f.name] if f.name in cols else pa.nulls(rows, f.type) for f in MET_SCHEMA} | {"kind": pa.array(np.full(rows, kind, np.int32))}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(full.values(), MET_SCHEMA, strict=True)], schema=MET_SCHEMA)


ROW, EDGE, BLOB = 0, 1, 2
#: Part hashes that a map task gathers before it sends them.
HASHES_HELD = 1_000_000


def meet(docs: DataFrame, k: int, num: int, den: int, buckets: int, key: str, text: str) -> DataFrame:
    """Rows of kind ROW (a: id, b: class, n: set size, t: hash of the text) and EDGE (a, b: nodes that share a part, or do so by way of others; a node is a class in a band)."""

    @tidy
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words = Parts(num, den), {}
        hashes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held, seen, dealt = 0, set(), 0

        def flush():
            h, c, pairs = forest(np.concatenate(hashes), np.concatenate(keys))
            if len(pairs):
                yield met_rows(EDGE, len(pairs), bucket=(pairs[:, 0] % buckets).astype(np.int32), a=pairs[:, 0], b=pairs[:, 1])
            bounds = np.searchsorted(h, (np.arange(1, buckets).astype(object) * (1 << 64) // buckets).astype(U)) if buckets > 1 else []
            spans = [(i, x, y) for i, (x, y) in enumerate(zip([0, *bounds], [*bounds, len(h)], strict=True)) if y > x]
            yield met_rows(BLOB, len(spans), bucket=[i for i, *_ in spans], hashes=[h[x:y].tobytes() for _, x, y in spans], keys=[c[x:y].tobytes() for _, x, y in spans])

        for whole in batches:
            for b in cut(whole, "t"):
                classes, sizes = [], []
                for t in b.column("t").to_pylist():
                    s = shingles(t, k, words)
                    sizes.append(len(s))
                    if not len(s):
                        classes.append(None)
                        continue
                    c = set_key(s)
                    classes.append(c)
                    if c in seen:
                        continue
                    seen.add(c)
                    for f, x in parts.hashes(s):
                        hashes.append(x)
                        keys.append(np.full(len(x), c ^ band_mark(f), np.int64))
                        held += len(x)
                deal = ((dealt + np.arange(len(classes))) % buckets).astype(np.int32)  # in turn: nothing meets rows, so copies needn't be together
                dealt += len(classes)
                yield met_rows(ROW, len(classes), bucket=deal, a=b.column("k"), b=pa.array(classes, pa.int64()), n=sizes, t=b.column("h"))
                if held > HASHES_HELD:
                    yield from flush()
                    hashes, keys, held = [], [], 0
                    seen.clear()
        if held:
            yield from flush()

    @tidy
    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys = [], []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (kind != BLOB).any():
                yield b.filter(pa.array(kind != BLOB))
            x = b.filter(pa.array(kind == BLOB))
            hashes += [np.frombuffer(h, U) for h in x.column("hashes").to_pylist()]
            keys += [np.frombuffer(c, np.int64) for c in x.column("keys").to_pylist()]
        if hashes:
            h, c = np.concatenate(hashes), np.concatenate(keys)
            hashes.clear()
            keys.clear()
            *_, pairs = forest(h, c)
            for i in range(0, len(pairs), 100_000):
                own = pairs[i : i + 100_000]
                yield met_rows(EDGE, len(own), a=own[:, 0], b=own[:, 1])

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    return slim.mapInArrow(cut_up, MET).repartition(buckets, "bucket").mapInArrow(join_up, MET)


class Tree:
    """Nodes over sets in order of their least shingles; arrays by node. Leaves hold up to LEAF sets, inner nodes FAN nodes."""

    LEAF, FAN = 16, 4

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = np.asarray([len(s) for s in sets])
        # Like sets have the same least shingles, as a rule, and so share leaves, whose bitmaps stay thin
        self.order = np.lexsort((n, [s[min(1, len(s) - 1)] for s in sets], [s[0] for s in sets]))
        self.n = n[self.order]
        self.sets = [sets[i] for i in self.order]
        flags = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(self.sets):
            flags[i, (s & U(bits - 1)).astype(np.int64)] = True
        self.maps = np.packbits(flags, axis=1).view(U)
        self.over = self.n - flags.sum(1)
        spans = [(i, min(i + self.LEAF, len(sets))) for i in range(0, len(sets), self.LEAF)]
        self.low = [int(self.n[a:b].min()) for a, b in spans]
        self.high = [int(self.n[a:b].max()) for a, b in spans]
        self.slack = [int(self.over[a:b].max()) for a, b in spans]
        self.union = [np.bitwise_or.reduce(self.maps[a:b]) for a, b in spans]
        self.span, self.below = spans, [None] * len(spans)
        level = list(range(len(spans)))
        while len(level) > 1:
            up = []
            for i in range(0, len(level), self.FAN):
                own = level[i : i + self.FAN]
                up.append(len(self.low))
                self.low.append(min(self.low[x] for x in own))
                self.high.append(max(self.high[x] for x in own))
                self.slack.append(max(self.slack[x] for x in own))
                self.union.append(np.bitwise_or.reduce([self.union[x] for x in own]))
                self.span.append((self.span[own[0]][0], self.span[own[-1]][1]))
                self.below.append(own)
            level = up
        self.root = level[0]


def bits_for(sizes: list[int]) -> int:
    """About eight bits for each shingle of a middling set, within 512 and 32768."""
    return int(min(1 << 15, max(512, 1 << int(np.ceil(np.log2(8 * max(1.0, float(np.median(sizes)))))))))


def linked(x: Tree, y: Tree, num: int, den: int, limit: int, work: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x.order, y.order) of all linked pairs by dual traversal; for x is y, each pair once. One set of a pair has `limit` shingles at most.

    work: node pairs seen, pairs of them dropped, set pairs below those dropped, set pairs intersected; added to.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    same = x is y
    stack = [(x.root, y.root)]

    def drop(u: int, v: int) -> None:
        a, b = x.span[u][1] - x.span[u][0], y.span[v][1] - y.span[v][0]
        work[1] += 1
        work[2] += a * (a - 1) // 2 if same and u == v else a * b

    while stack:
        u, v = stack.pop()
        work[0] += 1
        if den * x.high[u] < num * y.low[v] or den * y.high[v] < num * x.low[u] or min(x.low[u], y.low[v]) > limit:
            drop(u, v)
            continue
        need = -(-num * (x.low[u] + y.low[v]) // (num + den))
        common = int(np.bitwise_count(x.union[u] & y.union[v]).sum())
        if min(x.slack[u], y.slack[v]) + common < need:
            drop(u, v)
            continue
        if x.below[u] is None and y.below[v] is None:
            i, j = leaf_pairs(x, y, u, v, num, den, same, limit, work)
            if len(i):
                out.append((i, j))
        elif y.below[v] is None or (x.below[u] is not None and x.span[u][1] - x.span[u][0] >= y.span[v][1] - y.span[v][0] and not (same and u == v)):
            stack += [(c, v) for c in x.below[u]]
        elif same and u == v:
            own = x.below[u]
            stack += [(own[i], own[j]) for i in range(len(own)) for j in range(i, len(own))]
        else:
            stack += [(u, c) for c in y.below[v]]
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def leaf_pairs(x: Tree, y: Tree, u: int, v: int, num: int, den: int, same: bool, limit: int, work: list[int]) -> tuple[np.ndarray, np.ndarray]:
    (a, b), (c, d) = x.span[u], y.span[v]
    nx, ny = x.n[a:b, None], y.n[None, c:d]
    need = -(-num * (nx + ny) // (num + den))
    common = np.bitwise_count(x.maps[a:b, None, :] & y.maps[None, c:d, :]).sum(2, dtype=np.int64)
    maybe = np.minimum(x.over[a:b, None], y.over[None, c:d]) + common >= need
    maybe &= (np.minimum(nx, ny) >= need) & (np.minimum(nx, ny) <= limit)
    if same and u == v:
        maybe &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
    i, j = np.nonzero(maybe)
    work[3] += len(i)
    if not len(i):
        return i, j
    if len(i) <= 12:
        both = np.asarray([len(np.intersect1d(x.sets[a + p], y.sets[c + q], assume_unique=True)) for p, q in zip(i, j, strict=True)])
    else:
        left, right = x.sets[a:b], y.sets[c:d]
        words, inv = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        flags = np.zeros((len(left) + len(right), len(words)), np.float32)
        flags[np.repeat(np.arange(len(flags)), [len(s) for s in (*left, *right)]), inv] = 1
        both = np.rint(flags[: len(left)] @ flags[len(left) :].T)[i, j].astype(np.int64)
    ok = den * both >= num * (x.n[a + i] + y.n[c + j] - both)
    return a + i[ok], c + j[ok]


def tile_links(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, limit: int, work: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of linked sets, the smaller of `limit` shingles at most: within the tile if it has one side, else across its sides."""
    bits = bits_for([len(s) for s in sets])
    if sides.min() == sides.max():
        t = Tree(sets, bits)
        i, j = linked(t, t, num, den, limit, work)
        return t.order[i], t.order[j]
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    x, y = Tree([sets[i] for i in left], bits), Tree([sets[i] for i in right], bits)
    i, j = linked(x, y, num, den, limit, work)
    return left[x.order[i]], right[y.order[j]]


def roots_of(n: int, i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The least key that each of n places reaches."""
    up = list(range(n))

    def find(p: int) -> int:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            if keys[p] < keys[q]:
                up[q] = p
            else:
                up[p] = q
    return np.asarray([keys[find(p)] for p in range(n)], np.int64)


FOUND = "key long, root long, links long, classes long, work array<long>"
FOUND_SCHEMA = pa.schema([("key", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("classes", pa.int64()), ("work", pa.list_(pa.int64()))])
#: Sets in a tile's side, and shingles in them, on average at most.
BLOCK, BLOCK_SHINGLES = 12_000, 5_000_000
#: Rows of a table that is sent to all executors at most; 16 to 60 bytes each.
BROADCAST_ROWS = 200_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def verify(docs: DataFrame, wanted: DataFrame, rows: int, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """(key, root, links, classes) of each class that links with another in a tile, and a row of null key with the tree's work for each task.

    wanted: (id, hash, key, members, cluster, top, block, blocks) of each candidate class; hash: of the text that stands for it; top: the
    largest size of the cluster's band. Rows are met by id and text, and a task ships a class once, so neither repeated ids nor repeated rows multiply.
    """
    names = ["cluster", "i", "j", "side", "key", "members", "top", "shingles"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    @tidy
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        sent: set[tuple[int, int]] = set()
        out, size = [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for whole in batches:
            for b in cut(whole, "t"):
                for r in b.to_pylist():
                    if (r["key"], r["cluster"]) in sent:
                        continue
                    s = shingles(r["t"], k, words)
                    if not len(s) or set_key(s) != r["key"]:
                        continue  # another text with the same id and hash
                    sent.add((r["key"], r["cluster"]))
                    data, own = s.tobytes(), r["block"]
                    for other in range(r["blocks"]):
                        out.append((r["cluster"], min(own, other), max(own, other), int(own > other), r["key"], r["members"], r["top"], data))
                        size += len(data)
                        if size > 4 << 20:
                            yield table()
                            out, size = [], 0
        if out:
            yield table()

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, done, limit, work = None, {}, [], 0, [0] * 4

        def close():
            if len(held) < 2:
                return
            keys = np.fromiter(held, np.int64, len(held))
            sides, members, sets = (list(x) for x in zip(*held.values(), strict=True))
            if tile[1] != tile[2] and len(set(sides)) < 2:
                return
            i, j = tile_links(sets, np.asarray(sides), num, den, limit, work)
            if not len(i):
                return
            m = np.asarray(members)
            links, classes = (np.zeros(len(keys), np.int64) for _ in range(2))
            for p, q in ((i, j), (j, i)):
                np.add.at(links, p, m[q])
                np.add.at(classes, p, 1)
            roots = roots_of(len(keys), i, j, keys)
            some = classes > 0
            done.append((keys[some], roots[some], links[some], classes[some]))

        def emit():
            if done:
                cols = [pa.array(np.concatenate(c)) for c in zip(*done, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.list_(pa.int64()))], schema=FOUND_SCHEMA)
                done.clear()

        for b in batches:
            for c, i, j, side, key_, m, top, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (c, i, j) != tile:
                    close()
                    tile, held, limit = (c, i, j), {}, top
                held[key_] = (side, m, np.frombuffer(s, U))
            if len(done) > 500:
                yield from emit()
        close()
        yield from emit()
        yield pa.RecordBatch.from_pylist([{"work": work}], schema=FOUND_SCHEMA)

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    match = slim["k"].eqNullSafe(wanted["id"]) & (slim["h"] == wanted["hash"])
    sent = slim.join(hinted(wanted, rows), match).select("t", "key", "members", "cluster", "top", "block", "blocks")
    tiles = sent.mapInArrow(ship, "cluster long, i int, j int, side int, key long, members long, top long, shingles binary")
    return tiles.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(compare, FOUND)


def searched(docs: DataFrame, k: int, num: int, den: int, key: str, text: str, buckets: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, found): rows (doc_id, class_id, n_shingles), classes (key, id, hash, top_id, members, n) and what verify() found."""
    spark = docs.sparkSession
    small_batches(spark)
    if buckets is None:  # about 8 MB of input each; the estimate is Catalyst's and reads nothing
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= spark._jsparkSession.sessionState().conf().defaultSizeInBytes():  # nothing is known of it
            size = docs.count() << 11
        buckets = int(min(1 << 20, max(16, size >> 23)))
    met = written(meet(docs, k, num, den, buckets, key, text), "jaccard-met")
    rows = met.where(F.col("kind") == ROW).select(F.col("a").alias("doc_id"), F.col("b").alias("class_id"), F.col("n").alias("n_shingles"))
    shown = F.min(F.struct(F.col("a").isNull().alias("none"), F.col("a").alias("id"), F.col("t").alias("hash")))
    classes = met.where((F.col("kind") == ROW) & F.col("b").isNotNull()).groupBy(F.col("b").alias("key")).agg(shown.alias("s"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n")).select("key", "s.id", "s.hash", "members", "n")
    clusters = components(met.where(F.col("kind") == EDGE).select("a", "b"))
    # The nodes of a class: itself in its own band and in the one below
    parts = Parts(num, den)
    parts.band(1 << 40)
    last = F.array(*[F.lit(x).cast("long") for x in parts.last])
    own = F.size(F.filter(last, lambda x: x < F.col("n")))
    marks = F.array(*[F.lit(band_mark(f)).cast("long") for f in range(len(parts.last))])
    bands = F.array_distinct(F.array(own, F.greatest(own - 1, F.lit(1))))
    nodes = classes.withColumn("band", F.explode(bands)).select("id", "hash", "key", "members", "n", F.get(last, F.col("band")).alias("top"), F.col("key").bitwiseXOR(F.get(marks, F.col("band"))).alias("node"))
    some = written(clusters.join(nodes, "node").select("id", "hash", "key", "members", "n", F.col("label").alias("cluster"), "top"), "jaccard-some")
    sizes = some.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_s"))
    blocks = F.ceil(F.greatest(F.col("_n") / F.lit(BLOCK), F.col("_s") / F.lit(BLOCK_SHINGLES))).cast("int")
    wanted = written(some.join(sizes, "cluster").select("id", "hash", "key", "members", "cluster", "top", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), blocks.alias("blocks")), "jaccard-wanted")
    found = written(verify(docs, wanted, wanted.count(), k, num, den, key, text), "jaccard-found")
    forget(some, wanted, clusters)
    return rows, classes, found


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of each row; texts link at a Jaccard similarity of num / den at least. The result is a table in the shared folder."""
    rows, classes, found = searched(docs, k, num, den, key, text, buckets)
    # A class may link in several tiles: its roots there are one component
    links = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("root").alias("other"))
    labels = None
    if not links.where("root <> other").isEmpty():
        labels = components(found.where("key IS NOT NULL").select(F.col("key").alias("a"), F.col("root").alias("b")))
        links = links.drop("root").join(labels.select(F.col("node").alias("key"), F.col("label").alias("root")), "key")
    links = links.drop("other")
    tops = links.join(classes, "key").groupBy("root").agg(F.min("id").alias("top"))
    # Written, so that the join below has a class's many rows on one side and its single row on the other, which adaptive execution may split
    told = written(classes.join(links.join(tops, "root"), "key", "left").where("members > 1 OR links IS NOT NULL").select("key", F.coalesce("top", "id").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links")), "jaccard-told")
    out = rows.join(hinted(told, told.count()), F.col("class_id") == F.col("key"), "left")
    out = written(out.select("doc_id", "n_shingles", F.coalesce("top", "doc_id").alias("component_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "jaccard-rows")
    forget(rows, found, told, *([labels] if labels is not None else []))
    return out


def tree_work(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> dict[str, int]:
    """What the dual traversals of a join came to: node pairs seen and dropped, set pairs below those dropped, set pairs intersected."""
    rows, _, found = searched(docs, k, num, den, key, text, None)
    total = found.where("work IS NOT NULL").agg(*[F.sum(F.get("work", F.lit(i))).alias(f"w{i}") for i in range(4)]).first()
    forget(rows, found)
    return dict(zip(("node_pairs", "node_pairs_dropped", "set_pairs_dropped", "set_pairs_intersected"), (int(x or 0) for x in total), strict=True))


def op8_signature_trees(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    return jaccard_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)
