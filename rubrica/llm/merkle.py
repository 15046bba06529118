"""Merkle dataset manifest with a proof for each row, by postorder recursive traversal of aligned blocks.

A row's leaf is the hash of its fields. The leaves of a language, in the order of doc_id, are numbered from 0 and cut into aligned blocks of 8^4. One task
traverses a block by recursion in postorder: a call returns the digest of its subtree and, while it unwinds, appends to each leaf below it the
siblings of the child that holds the leaf. The blocks' roots are the nodes of another distributed traversal, and so on until each language
has one node, its subroot; the subroots are leaves of one more tree. Then paths go down: a block gets the path of its own root as a row among its leaves,
and its leaves' paths are what the recursion appended, followed by that. No task holds more than a block, and no driver more than counts.

Leaves are numbered after a range sort by language and doc_id, so a language of any share is spread over tasks; alike rows are counted before the sort and spread out
after it.

Nulls: a null field hashes as `-`; the null language is a tree of its own, the first; a null doc_id comes before the others and isn't tampered with. Empty texts hash as `0:`. Texts of any length count
whole. Ties: rows of one language and doc_id are in the order of their leaves; alike rows have places and proofs of their own. An empty table
gives no row. Extra columns are neither hashed nor carried, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import forget, read, tidy, written
from rubrica.llm.jaccard import hinted

#: Children of a node, and levels of a block.
FAN, HEIGHT = 8, 4


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above n leaves, until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


Path = list[tuple[str, str]]  #: (siblings before, siblings after) of each level, from the leaf up


def traverse(nodes: list[str], height: int, paths: list[Path] | None = None, low: int = 0) -> str:
    """The digest of the subtree of so many levels over nodes[low:]; appends the siblings of each level to the paths of its leaves while it unwinds."""
    if not height:
        return nodes[low]
    step = FAN ** (height - 1)
    starts = range(low, min(low + FAN * step, len(nodes)), step)
    own = [traverse(nodes, height - 1, paths, s) for s in starts]
    if paths is not None:
        for i, s in enumerate(starts):
            siblings = ("".join(own[:i]), "".join(own[i + 1 :]))
            for leaf in range(s, min(s + step, len(nodes))):
                paths[leaf].append(siblings)
    return digest("".join(own))


def folded(leaf: str, path: Path) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, digest, other, copies): language, leaf and, where it is tampered with, the tampered leaf. Alike rows are one."""
    at = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    own = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*at, text).alias("digest"), F.when(tampered, leaf_of(*at, lower)).alias("other"))
    return own.groupBy("grp", "doc_id", "digest", "other").agg(F.count(F.lit(1)).alias("copies"))


NODE = "grp string, pos long, n long, digest string, doc_id long, other string"


def placed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes, the tables they are read from). Nodes: rows with their place `pos` among the `n` of their group, in the order of keys; one for each copy."""

    @tidy
    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            c = b.column("copies").to_numpy()
            ends = total + np.cumsum(c)
            total = int(ends[-1]) if len(ends) else total
            yield b.append_column("before", pa.array(ends - c, pa.int64()))

    ordered = rows.orderBy("grp", *keys).select("*", F.spark_partition_id().alias("part"))
    ordered = written(ordered.mapInArrow(count_up, "grp string, doc_id long, digest string, other string, copies long, part int, before long"), "merkle-ordered")
    # One row for each group and partition of the sort
    runs = ordered.groupBy("grp", "part").agg(F.min("before").alias("first"), F.sum("copies").alias("own"))
    ahead = F.expr("coalesce(sum(own) OVER (PARTITION BY grp ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    runs = written(runs.select(F.col("grp").alias("g"), F.col("part").alias("p"), (ahead - F.col("first")).alias("shift"), F.expr("sum(own) OVER (PARTITION BY grp)").alias("n")), "merkle-runs")
    at = F.col("before") + F.col("shift")
    nodes = ordered.join(hinted(runs, runs.count()), F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return nodes.select("grp", F.explode(F.sequence(at, at + F.col("copies") - 1)).alias("pos"), "n", "digest", "doc_id", "other"), [ordered, runs]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (grp, block), which are sorted so."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and (r["grp"], r["block"]) != (held[0]["grp"], held[0]["block"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def block_of(height: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FAN**height)).cast("long")


def rise(nodes: DataFrame, height: int) -> DataFrame:
    """The root of each aligned block, as the nodes of the next traversal."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block in by_block(batches):
            n = block[0]["n"]
            root = traverse([r["digest"] for r in block], min(height, levels(n)))
            out.append({"grp": block[0]["grp"], "pos": block[0]["block"], "n": -(-n // FAN**height), "digest": root})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    up = in_blocks(nodes.select("grp", block_of(height).alias("block"), "pos", "n", "digest")).mapInArrow(run, "grp string, pos long, n long, digest string")
    return up.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("other"))


PATHS = "grp string, pos long, digest string, other string, path array<string>, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def unwind(nodes: DataFrame, tops: DataFrame, height: int, proofs: bool) -> DataFrame:
    """The path of each node up to the root, given the paths of the blocks' roots; with proofs, rows of PROOFS instead."""
    plain = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("other", pa.string()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
    proven = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def told(r: dict, path: Path, top: dict) -> dict:
        if not proofs:
            return {"grp": r["grp"], "pos": r["pos"], "digest": r["digest"], "other": r["other"], "path": [s for pair in path for s in pair], "subroot": top["subroot"], "root": top["root"]}
        back = folded(r["other"] or r["digest"], path)
        return {"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": digest("".join(a + b for a, b in path)), "folded_root": back, "verified": back == top["root"]}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, *block in by_block(batches):  # the row of place -1 holds the path of the block's root
            above = list(zip(top["path"][::2], top["path"][1::2], strict=True))
            paths: list[Path] = [[] for _ in block]
            traverse([r["digest"] for r in block], min(height, levels(block[0]["n"])), paths)
            for i in range(0, len(block), 1000):
                out = [told(r, path + above, top) for r, path in zip(block[i : i + 1000], paths[i : i + 1000], strict=True)]
                yield pa.RecordBatch.from_pylist(out, proven if proofs else plain)

    null = lambda kind: F.lit(None).cast(kind)
    below = nodes.select("grp", block_of(height).alias("block"), "pos", "n", "digest", "doc_id", "other", null("array<string>").alias("path"), null("string").alias("subroot"), null("string").alias("root"))
    above = tops.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), null("long").alias("n"), null("string").alias("digest"), null("long").alias("doc_id"), null("string").alias("other"), "path", "subroot", "root")
    return in_blocks(below.union(above)).mapInArrow(run, PROOFS if proofs else PATHS)


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """nodes, the roots of their blocks, and so on, until each group has one node; all but the first are tables."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(written(rise(out[-1], height), "merkle-nodes"))
    return out


def descend(tables: list[DataFrame], tops: DataFrame, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """(the paths of the roots of the first table's blocks, the tables made on the way)."""
    made = []
    for nodes in tables[-2:0:-1]:
        tops = written(unwind(nodes, tops, height, False), "merkle-paths")
        made.append(tops)
    return tops, made


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Rows of PROOFS, one for each document, as a table in the shared folder. height: levels of a block."""
    leaves = written(leaves_of(docs), "merkle-leaves")
    nodes, used = placed(leaves, ["doc_id", "digest", "other"])
    trees = climb(nodes, height)
    # One row for each language; its name goes along as `other`
    subroots = trees[-1].select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("doc_id"), "digest", F.col("grp").alias("other"), F.lit(1).cast("long").alias("copies"))
    langs, more = placed(subroots, ["other"])
    top = climb(langs, height)
    root = top[-1].select("grp", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    down, made = descend(top, root, height)
    each = written(unwind(langs, down, height, False), "merkle-subroots")
    tops = each.select(F.col("other").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    tops, paths = descend(trees, tops, height)
    out = written(unwind(nodes, tops, height, True), "merkle-proofs")
    forget(leaves, *used, *more, *trees[1:], *top[1:], *made, each, *paths)
    return out


def op12_postorder_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


#: Levels are made one by one, then each row's proof is read off the table of nodes. crc32 is spelled out, bit by bit.
ORACLE_SQL = """WITH RECURSIVE
leaves AS (SELECT doc_id, lang, text, source, n_chars, coalesce(strlen(source) || ':' || source, '-') AS s, coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS c,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::UBIGINT)),
        lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc FROM documents),
rows AS (SELECT doc_id, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    sha256(d || s || l || c || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 3 = 0 THEN sha256(d || s || l || c || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM leaves),
tree AS (SELECT 0 AS level, g, pos, n, leaf AS h FROM rows
    UNION ALL SELECT any_value(level) + 1, g, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, pos // 8),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS h FROM subs
    UNION ALL SELECT any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 8),
steps AS (SELECT r.g, r.pos AS place, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < r.pos // (8 ** t.level)::BIGINT), '') AS b, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > r.pos // (8 ** t.level)::BIGINT), '') AS a
    FROM rows r JOIN tree t ON t.g = r.g AND t.n > 1 AND t.pos // 8 = r.pos // (8 ** (t.level + 1))::BIGINT GROUP BY r.g, r.pos, t.level
    UNION ALL SELECT r.g, r.pos, 1000 + t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (8 ** t.level)::BIGINT), ''), coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (8 ** t.level)::BIGINT), '')
    FROM rows r JOIN subs s USING (g) JOIN top t ON t.n > 1 AND t.pos // 8 = s.pos // (8 ** (t.level + 1))::BIGINT GROUP BY r.g, r.pos, t.level),
proofs AS (SELECT g, place, sha256(string_agg(b || a, '' ORDER BY level)) AS proof, list({'b': b, 'a': a} ORDER BY level) AS path FROM steps GROUP BY g, place),
folds AS (SELECT r.g, r.pos, coalesce(tampered, leaf) AS f, path, 1 AS i FROM rows r LEFT JOIN proofs p ON p.g = r.g AND p.place = r.pos
    UNION ALL SELECT g, pos, sha256(path[i].b || f || path[i].a), path, i + 1 FROM folds WHERE i <= len(path))
SELECT r.doc_id, leaf, subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.f AS folded_root, f.f = t.h AS verified
FROM rows r JOIN subs s USING (g) JOIN top t ON t.n = 1 LEFT JOIN proofs p ON p.g = r.g AND p.place = r.pos
JOIN folds f ON f.g = r.g AND f.pos = r.pos AND f.i = coalesce(len(f.path), 0) + 1"""
