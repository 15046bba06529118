"""Exact integer k-means by sort-means.

Vectors become integers, centroids start as the vectors whose hashed ids are smallest, and a fixed number of rounds assigns every vector and moves the
centroids. In a round the other centroids are put in order of their distance from each centroid, once. A vector is measured against the centroid
it had before, then against the others in the order of that one, and its scan stops at the first that lies strictly beyond twice its current
distance: by the triangle inequality that one and all after it are farther than the current one. At exactly twice a centroid may still tie, so
it's measured. Squared integers are compared throughout, so no rounding decides.

Each round is one pass in which tasks see their own vectors and k centroids; a task sends k rows of sums. A table in the shared folder holds the vectors with
their last assignment, and the next replaces it, so a lost executor costs only the tasks that it ran.

Nulls and others that aren't kept: a null vector, one of another length, or one with a null or non-finite component. A null id is kept, and assigned, but never a
starting centroid, since it has no hash. Ties: the centroid of the smaller number wins; starting vectors with equal ids are in order of their components. Rows that
repeat an id or a vector are rows like others. Fewer kept vectors than k: as many centroids as vectors. An empty table gives no row. Extra columns are not carried, so
their names can't clash. A component beyond 2^27 after scaling raises ValueError: its squared distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import forget, read, tidy, written

#: Components beyond it have squared distances, over 64 of them, that a long can't hold.
LARGEST = 1 << 27


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the kept vectors, their components as floor(scale * x))."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    places = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = column.filter(right).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls come out as NaN
    x = flat.reshape(len(places), dims)
    fine = np.isfinite(x).all(1)
    x = np.floor(x[fine] * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component of {np.abs(x).max():g} after scaling is beyond {LARGEST}; squared distances would not fit a long")
    return places[fine], x.astype(np.int64)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of x, and how many distances were measured. before: the previous assignment."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(between, axis=1, kind="stable")
    now = ((x - centroids[before]) ** 2).sum(1)
    cluster, best, measured = before.copy(), now.copy(), len(x)
    for p in np.unique(before):
        live = np.flatnonzero(before == p)
        for j in order[p]:
            if j == p:
                continue
            live = live[-(-between[p, j] // 4) <= now[live]]  # D > 2d, in squares, ends a scan
            if not len(live):
                break
            d = ((x[live] - centroids[j]) ** 2).sum(1)
            measured += len(live)
            closer = (d < best[live]) | ((d == best[live]) & (j < cluster[live]))
            best[live[closer]] = d[closer]
            cluster[live[closer]] = j
    return cluster, best, measured


def quantised(vectors: DataFrame, key: str, column: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v, cluster) of the kept vectors, all of cluster 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, x = integers(b.column("v"), dims, scale)
            yield vector_rows(b.column("k").take(pa.array(places)), x, np.zeros(len(places), np.int32))

    return vectors.select(F.col(key).cast("long").alias("k"), F.col(column).alias("v")).mapInArrow(run, "vec_id long, v array<int>, cluster int")


def vector_rows(ids: pa.Array, x: np.ndarray, cluster: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    v = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32).ravel()))
    return pa.RecordBatch.from_arrays([ids, v, pa.array(cluster.astype(np.int32))], names=["vec_id", "v", "cluster"])


def components_of(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(b.num_rows, dims).astype(np.int64)


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The table with each vector's new cluster."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = components_of(b, centroids.shape[1])
            cluster, *_ = nearest(x, b.column("cluster").to_numpy().astype(np.int64), centroids)
            yield vector_rows(b.column("vec_id"), x, cluster)

    return table.mapInArrow(run, table.schema)


def measured(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of the last assignment."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, d, _ = nearest(components_of(b, centroids.shape[1]), b.column("cluster").to_numpy().astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids as the floored means of their vectors; one without vectors stays. A task sends a row of sums for each cluster."""
    k, dims = centroids.shape

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x, c = components_of(b, dims), b.column("cluster").to_numpy()
            n += np.bincount(c, minlength=k)
            for j in np.unique(c):
                sums[j] += x[c == j].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * dims rows
        out[r.cluster, r.at] = r.s // r.n
    return out


def starting(table: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    hashed = table.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return np.asarray([r.v for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64)


def sort_means(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 64, salt: str = "1:", key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept vector as a table in the shared folder, the final centroids)."""
    now = written(quantised(vectors, key, column, dims, scale), "means-vectors")
    centroids = starting(now, k, salt)
    if not len(centroids):  # no vector, or none with an id
        empty = now.where(F.lit(False)).select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"))
        return empty, centroids.reshape(0, dims)
    for _ in range(rounds):
        new = written(assigned(now, centroids), "means-vectors")
        forget(now)
        now, centroids = new, moved(new, centroids)
    out = written(measured(now, centroids), "means-clusters")
    forget(now)
    return out, centroids


def with_inertia(told: DataFrame, centroids: np.ndarray) -> DataFrame:
    """told with cluster_inertia, inertia and centroid_sha256; what joins is one row for each of k clusters."""
    sums = {r.cluster: r.s for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    each = [(j, s, sum(sums.values()), digest(centroids[j])) for j, s in sorted(sums.items())]
    clusters = told.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sort_means(spark, sf_dir: str) -> DataFrame:
    return with_inertia(*sort_means(read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same by plain k-means in SQL: every vector against every centroid."""
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = lambda c: f"SELECT vec_id, v, m.d AS distance, m.c AS cluster FROM (SELECT p.vec_id, p.v, min({{'d': {far}, 'c': c.c}}) AS m FROM kept p, {c} c GROUP BY p.vec_id, p.v)"
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds):
        mean = "(s - ((s % n) + n) % n) // n"
        steps += [
            f"a{i} AS ({near(f'c{i}')})",
            f"m{i} AS (SELECT cluster, list(({mean})::BIGINT ORDER BY place) AS v FROM (SELECT cluster, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place) GROUP BY cluster)",
            f"c{i + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.cluster = o.c)",
        ]
    return f"""WITH {", ".join(steps)}, a AS ({near(f"c{rounds}")})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.c = a.cluster"""


ORACLE_SQL = _sql()
