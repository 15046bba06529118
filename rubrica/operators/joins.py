"""Joins behind rules that look at pairs: each meets rows by equal keys, then checks the pairs that met, so none looks at all pairs of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.functions.text import WORD_EDGE
from rubrica.tables import unsent

#: Names longer than this are met by their thirds, as their deletions would be many.
LONG_NAME = 40
NO_STRINGS = "array<string>"


def named_in(speakers: DataFrame, names: DataFrame) -> DataFrame:
    """(path, ord, o_ord, o_name): rows of speakers whose `said` holds a name of another row of the same path, as a word and in any case.

    speakers: path, ord, said. names: path, ord, name. A text is cut into its runs of word characters and of others. A name that matches at word edges has
    each of its own word runs among them, whole, and one without any is itself a run of others. So an index of words leads from the rarest run of each name to the
    texts that have it, and only those are searched. Work grows with the words of the texts and the names that they may hold.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9_]+"), F.lit(0)))
    keyed = names.select("path", F.col("ord").alias("o_ord"), F.col("name").alias("o_name"), F.explode(F.when(F.size(runs) > 0, runs).otherwise(F.array(F.lower("name")))).alias("run"))
    common = keyed.groupBy("path", "run").agg(F.count(F.lit(1)).alias("n"))
    rarest = keyed.join(unsent(common), ["path", "run"]).groupBy("path", "o_ord").agg(F.min(F.struct("n", "run")).alias("k"), F.first("o_name").alias("o_name")).select("path", "o_ord", "o_name", F.col("k.run").alias("run"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("said"), F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0)))
    index = speakers.select("path", "ord", F.explode(words).alias("run"))
    met = index.join(unsent(rarest), ["path", "run"]).where("ord <> o_ord").select("path", "ord", "o_ord", "o_name")
    pattern = F.concat(F.lit("(?i)" + WORD_EDGE), F.regexp_replace("o_name", r"[.*+?^${}()|\[\]\\]", r"\\$0"), F.lit(WORD_EDGE))
    found = met.join(unsent(speakers), ["path", "ord"]).where(F.contains(F.lower("said"), F.lower("o_name"))).where(F.regexp_like("said", pattern))
    return found.select("path", "ord", "o_ord", "o_name")


@F.pandas_udf(T.ArrayType(T.LongType()))
def deletion_keys(texts: pd.Series) -> pd.Series:
    """Hashes of each text and of it without one and two characters. What is left of a text is hashed from sums of its front parts, so a key costs a few additions; thousands of nested expressions on a row would take most of the join's time.

    A text's hash is the sum of its mixed characters times powers of an odd number, modulo 2^64: a character left out divides by that number what stands behind it. Texts that meet by chance only are told apart when they are measured.
    """
    base, back, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64(0xD6E8FEB86659FD93)
    out: list[np.ndarray | None] = [None] * len(texts)
    by_length: dict[int, list[int]] = {}
    for at, t in enumerate(texts):
        if t is not None:
            by_length.setdefault(len(t), []).append(at)
    for n, places in by_length.items():
        one = np.arange(n)
        i, j = np.triu_indices(n, 1)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)[:n]
        for start in range(0, len(places), 1000):
            own = places[start : start + 1000]
            c = np.frombuffer("".join(texts.iloc[at] for at in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n).astype(np.uint64)
            c = (c + np.uint64(1)) * mix
            c = (c ^ (c >> np.uint64(29))) * base
            front = np.zeros((len(own), n + 1), np.uint64)
            np.cumsum((c ^ (c >> np.uint64(32))) * powers, axis=1, dtype=np.uint64, out=front[:, 1:])
            whole = front[:, n:]
            less_one = front[:, one] + (whole - front[:, one + 1]) * back
            less_two = front[:, i] + (front[:, j] - front[:, i + 1] + (whole - front[:, j + 1]) * back) * back
            keys = np.concatenate([whole + np.uint64(n) * mix, less_one + np.uint64(max(n - 1, 0)) * mix, less_two + np.uint64(max(n - 2, 0)) * mix], axis=1).view(np.int64)
            for at, row in zip(own, keys, strict=True):
                out[at] = row
    return pd.Series(out, dtype=object)


def deletions(s: Column) -> Column:
    """Hashes of a text, and of it without one and two of its characters; texts within two edits of each other share one."""
    return F.array_distinct(deletion_keys(s))


def thirds(s: Column, length: Column) -> list[tuple[Column, Column]]:
    """(start from 1, length) of the three parts of a text of so many characters."""
    a = F.floor(length / 3)
    return [(F.lit(1), a), (a + 1, a), (2 * a + 1, length - 2 * a)]


def near_names(names: DataFrame, most: int = 2) -> DataFrame:
    """(path, a, b, distance): pairs a < b of different names of a path within two edits; names: path, name, distinct.

    Names meet by what is left of them without up to two characters: of two within two edits, one and the same remains for some such choice, and names that
    aren't near share none but by chance. Names over LONG_NAME characters meet by their thirds instead: two edits leave one third of a name whole, moved by two
    places at most. What met is measured.
    """
    if most != 2:
        raise ValueError("the keys are made for two edits")
    short = names.where(F.length("name") <= LONG_NAME)
    keyed = short.select("path", "name", F.explode(deletions(F.col("name"))).alias("h"))
    # Names of equal keys, put together first: a key that one name has needs no join. One shuffle of the keys serves the count and both sides
    some = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path", "h"))).where("n > 1").select("path", "h", "name")
    pairs = some.join(unsent(some.withColumnRenamed("name", "b")), ["path", "h"]).where("name < b").select("path", F.col("name").alias("a"), "b")
    tall = names.where(F.length("name") > LONG_NAME - most)
    n = F.length("name")
    key = lambda part, size, s, start, length: F.struct(F.lit(part).alias("part"), size.cast("int").alias("size"), F.xxhash64(F.substring(s, start.cast("int"), length.cast("int"))).alias("h"))
    own = [key(i, n, F.col("name"), start, length) for i, (start, length) in enumerate(thirds(F.col("name"), n))]
    probes = [key(i, n + d, F.col("name"), start + shift, length) for d in range(-most, most + 1) for i, (start, length) in enumerate(thirds(F.col("name"), n + d)) for shift in range(-most, most + 1)]
    index = tall.select("path", F.col("name").alias("o"), F.explode(F.array(*own)).alias("k")).select("path", "o", "k.*")
    probed = tall.select("path", "name", F.explode(F.array_distinct(F.array(*probes))).alias("k")).select("path", "name", "k.*")
    long_pairs = probed.join(unsent(index), ["path", "part", "size", "h"]).where("name <> o").select("path", F.least("name", "o").alias("a"), F.greatest("name", "o").alias("b"))
    return pairs.union(long_pairs).distinct().withColumn("distance", F.levenshtein("a", "b", most)).where(F.col("distance").between(1, most))


def alike_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(repo, path, o_path, similarity): ordered pairs of different rows of a repository whose sets' Jaccard similarity is over the threshold; sets: repo, path, w (distinct words).

    Words are put in order of how many sets of the repository have them, rarest first. Sets as similar as asked share a word among the first few of both, so only those
    meet: a word that all have is among the first of none but the smallest sets.
    """
    sets = sets.where(F.size("w") > 0)
    words = sets.select("repo", "path", F.explode("w").alias("word"))
    counts = words.groupBy("repo", "word").agg(F.count(F.lit(1)).alias("df"))
    ordered = words.join(unsent(counts), ["repo", "word"]).groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))  # one set's words
    n = F.size("w")
    first = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    heads = ordered.select("repo", "path", n.alias("n"), F.explode(F.slice("w", F.lit(1), F.least(first, n))).alias("x")).select("repo", "path", "n", F.col("x.word").alias("word"))
    other = heads.select("repo", "word", F.col("path").alias("o_path"), F.col("n").alias("o_n"))
    met = heads.join(unsent(other), ["repo", "word"]).where((F.col("path") < F.col("o_path")) & (F.least("n", "o_n") > F.greatest("n", "o_n") * F.lit(threshold) - F.lit(1e-9))).select("repo", "path", "o_path").distinct()
    pairs = met.join(unsent(sets.select("repo", "path", "w")), ["repo", "path"]).join(unsent(sets.select("repo", F.col("path").alias("o_path"), F.col("w").alias("o_w"))), ["repo", "o_path"])
    both = F.size(F.array_intersect("w", "o_w"))
    told = pairs.select("repo", "path", "o_path", (both / (F.size("w") + F.size("o_w") - both)).alias("similarity")).where(F.col("similarity") > threshold)
    return told.union(told.select("repo", F.col("o_path"), F.col("path"), "similarity"))


def opposed(claims: DataFrame) -> DataFrame:
    """(path, a, n): pairs of an "always" and a "never" claim of one path where the words of the shorter start the longer; a single word must be the whole.

    claims: path, positive (true for always), words, own (what comes out as a or n). Claims meet by a path and the words that one has and the other starts with.
    """
    n = F.size("words")
    starts = F.transform(F.filter(F.sequence(F.lit(1), n), lambda k: (k > 1) | (n == 1)), lambda k: F.struct(F.array_join(F.slice("words", F.lit(1), k), " ").alias("key"), k.alias("k")))
    keyed = claims.where(n > 0).select("path", "positive", n.alias("size"), "own", F.explode(starts).alias("s")).select("path", "positive", "own", "s.key", "s.k", (F.col("s.k") == F.col("size")).alias("whole"))
    a = keyed.where("positive").select("path", "key", "k", F.col("own").alias("a"), F.col("whole").alias("a_whole"))
    b = keyed.where("NOT positive").select("path", "key", "k", F.col("own").alias("n"), F.col("whole").alias("n_whole"))
    return a.join(unsent(b), ["path", "key", "k"]).where("a_whole OR n_whole").select("path", "a", "n")
