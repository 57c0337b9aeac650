"""Centroid clustering of integer vectors with a table of distances to fixed pivots."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.session import materialise

#: How many vectors the pivots are chosen from, and how many pivots there are.
CANDIDATES, PIVOTS = 256, 12
#: Vectors of one step of a task.
ROWS = 4096
#: Distances of integers below this size have no overflow for any number of components up to 256.
LARGEST = 1 << 26


def integer_vectors(table: DataFrame, size: int, scale: int, vector="embedding") -> DataFrame:
    """``table`` with a column ``_v`` of floor(scale * x) for each component, where the vector is whole.

    Vectors that are null, of another size, or have a null or non-finite component are left out. A
    component over ``LARGEST`` after scaling ends the job with a message, as its squared distances
    need not fit 64 bits.
    """
    v = F.col(f"`{vector}`")
    wide = F.transform(v, lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(wide, lambda x: F.floor(x * scale))
    small = F.forall(wide, lambda x: F.abs(x * scale) < LARGEST)
    checked = F.when(small, scaled).otherwise(
        F.raise_error(F.lit(f"a component is over {LARGEST} after scaling by {scale}")).cast("array<bigint>")
    )
    return table.filter(v.isNotNull() & (F.size(v) == size) & whole).withColumn("_v", checked)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def spread_pivots(candidates: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the candidate farthest from those chosen."""
    if len(candidates) == 0:
        return candidates
    chosen = [0]
    near = _squared(candidates, candidates[0])
    while len(chosen) < min(count, len(candidates)):
        far = int(near.argmax())
        if near[far] == 0:
            break
        chosen.append(far)
        near = np.minimum(near, _squared(candidates, candidates[far]))
    return candidates[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray, key: str) -> DataFrame:
    """(key, _v, _p): each vector with its distances to the pivots, computed once and written."""
    size, kind = pivots.shape[1], dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = _matrix(batch.column(1), size)
            table = np.sqrt(np.stack([_squared(v, p) for p in pivots], axis=1).astype(np.float64))
            at = pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32())
            far = pa.ListArray.from_arrays(at, pa.array(table.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, far], names=[key, "_v", "_p"])

    return materialise(vectors.select(key, "_v").mapInArrow(run, f"`{key}` {kind}, _v array<bigint>, _p array<double>"))


def nearest(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of each vector; ties to the smaller number.

    By the triangle inequality a centroid is at least as far from a vector as their distances to any
    pivot differ. The centroid of the least bound is measured first, then, in order of number, those
    whose bound is not over the best distance so far; all of these are exact integers. Bounds are
    lowered by more than rounding can have raised them.
    """
    reach = np.sqrt(np.stack([_squared(pivots, c) for c in centroids]).astype(np.float64))  # (centroid, pivot)
    bound = np.abs(far[:, None, :] - reach[None, :, :]).max(axis=2)
    bound = np.maximum(bound - 1e-9 * (1 + far.max(axis=1, keepdims=True) + reach.max()), 0.0)
    bound *= bound
    first = bound.argmin(axis=1)
    best = _squared(v, centroids[first])
    which = first.astype(np.int64)
    measured = len(v)
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (bound[:, c] <= best.astype(np.float64) * (1 + 1e-12)))
        measured += len(rows)
        d = _squared(v[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
        best[rows[better]] = d[better]
        which[rows[better]] = c
    return which, best, measured


def _steps(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            v = _matrix(part.column(1), centroids.shape[1])
            far = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(pivots))
            yield part.column(0), v, *nearest(v, far, centroids, pivots)


def gathered(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list[tuple]:
    """(cluster, vectors, sum of distances, sums of components, distances computed) of each cluster in use.

    A task adds up its own vectors first, so that it sends a row for each cluster at most; the driver
    gets a row for each cluster.
    """
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        counts, high, low = (np.zeros(k, np.int64) for _ in range(3))
        sums, measured = np.zeros((k, size), np.int64), 0
        for _, v, which, best, n in _steps(batches, centroids, pivots):
            counts += np.bincount(which, minlength=k)
            np.add.at(high, which, best >> 32)  # in two halves, so that no sum overflows
            np.add.at(low, which, best & 0xFFFFFFFF)
            measured += n
            order = np.argsort(which, kind="stable")
            heads = np.searchsorted(which[order], np.arange(k))
            used = np.flatnonzero(np.bincount(which, minlength=k))
            sums[used] += np.add.reduceat(v[order], heads[used], axis=0)
        used = np.flatnonzero(counts)
        work = np.zeros(len(used), np.int64)
        work[:1] = measured
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (used, counts[used], high[used], low[used], work)]
            + [pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "high", "low", "measured", "sums"],
        )

    parts = table.mapInArrow(run, "cluster long, n long, high long, low long, measured long, sums array<bigint>")
    added = {"high": F.col("high"), "low": F.col("low")} | {f"s{i}": F.col("sums")[i] for i in range(size)}
    rows = (
        parts.groupBy("cluster")
        .agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *(F.sum(c.cast("decimal(38,0)")).alias(a) for a, c in added.items()))
        .collect()
    )
    return [
        (r["cluster"], r["n"], (int(r["high"]) << 32) + int(r["low"]), [int(r[f"s{i}"]) for i in range(size)], r["measured"])
        for r in rows
    ]


def moved(centroids: np.ndarray, rows: list[tuple]) -> np.ndarray:
    """Each centroid in use becomes the componentwise floor of its vectors' mean; the others stay."""
    out = centroids.copy()
    for cluster, n, _, sums, _ in rows:
        out[cluster] = [s // n for s in sums]
    return out


def clustered(
    table: DataFrame, k=8, rounds=10, size=64, scale=1024, seed="3", key="vec_id", vector="embedding"
) -> tuple[DataFrame, np.ndarray, list[tuple]]:
    """Clusters of the vectors by ``rounds`` of moving centroids, all of it in exact integers.

    Returns the rows (key, cluster, distance), the final centroids and the figures of each cluster as
    ``gathered`` gives them. Centroids start as the vectors with the least SHA-256 of ``seed:key``, in
    this order; pivots are spread over the vectors that follow them, at most ``CANDIDATES``. Distances to
    pivots are stored once in a written table, from which each round is one pass; only a row for each
    cluster comes to the driver.

    Null, short, long and non-finite vectors are left out (``integer_vectors``). A null key hashes like
    an empty one; rows that share a key are vectors of their own, started from in the order of their
    components. With fewer than ``k`` vectors there are as many centroids; an empty table gives no row,
    no centroid and no figures. Other columns are left out.
    """
    kind = dict(table.dtypes)[key]
    vectors = integer_vectors(table.select(key, vector), size, scale, vector)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    drawn = vectors.select(F.sha2(name, 256).alias("h"), "_v").orderBy("h", "_v").limit(k + CANDIDATES).collect()
    starts = np.array([r["_v"] for r in drawn], np.int64).reshape(-1, size)
    if not len(starts):
        return table.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int, distance long"), starts, []
    centroids, pivots = starts[:k], spread_pivots(starts, PIVOTS)
    stored = pivot_table(vectors, pivots, key)
    for _ in range(rounds):
        centroids = moved(centroids, gathered(stored, centroids, pivots))
    figures = gathered(stored, centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]):
        for keys, _, which, best, _ in _steps(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(which.astype(np.int32)), pa.array(best)], names=[key, "cluster", "distance"]
            )

    return stored.mapInArrow(run, f"`{key}` {kind}, cluster int, distance long"), centroids, figures


def centroid_digest(centroid: np.ndarray) -> str:
    """SHA-256, in lower-case hex, of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_figures(rows: DataFrame, centroids: np.ndarray, figures: list[tuple]) -> DataFrame:
    """Rows with the inertia of their cluster and of all, and the digest of their centroid.

    A sum that does not fit 64 bits is null.
    """
    total = sum(f[2] for f in figures)
    per = {f[0]: f[2] for f in figures}

    def of_cluster(values: list, kind: str):
        if not values:
            return F.lit(None).cast(kind)
        return F.array(*[F.lit(str(v)).try_cast(kind) for v in values])[F.col("cluster")]

    return rows.select(
        "*",
        of_cluster([per.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(str(total)).try_cast("long").alias("inertia"),
        of_cluster([centroid_digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )
