"""Centroid clustering: Lloyd's rounds on integer vectors, with bounds that decide most vectors without a scan.

Every vector keeps an upper bound of its distance to its own centroid and a lower bound of that to any other. When the
centroids have moved, the upper bound grows by the own centroid's drift. The lower one falls by less than the greatest drift
of the others: the vectors of cluster a lie in the sphere around its old centroid that holds the greatest upper bound, and in
the plane of that centre and a moved centroid's old and new place p, q, with middle m, any x of the sphere has

    |x - p| - |x - q| = 2 (x - m)(q - p) / (|x - p| + |x - q|)  <=  |q - p| cos(angle of x - m to q - p)

as |x - p| + |x - q| >= 2 |x - m|. The smallest angle over the sphere is the centre's less asin(radius / |centre - m|), so a
centroid that moves sideways or away costs little or nothing. A vector whose bounds (with a margin for rounding) still part
keeps its cluster; of the others the distance to the own centroid is computed, and what stays ambiguous is scanned exactly.

Distances are exact integers, ties go to the smaller centroid, and centroids are exact floors of integer means: the result
is that of plain rounds. A round is one map over a written table that holds vectors and bounds, and hands on per task and
cluster what changed (sums and counts of the vectors that moved, the radius); those are summed in Spark, and the driver sees
one row per cluster and component. The table of the round before is dropped when the next one is written.

Defined cases: vectors that are null, have another number of components, or a null or non-finite component, are not in the
result; a component beyond ``LIMIT`` units raises an error (its squared distance would not fit a long); repeated rows and
null ids are vectors like any other, and equal hashes are ordered by the vector; fewer vectors than ``k`` give as many
centroids; an empty cluster keeps its centroid. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import dropped, record_batch
from parley.session import shared_dir

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
LIMIT = 1 << 27      # of a component: 64 squared differences of up to 2 ** 28 stay below 2 ** 62
EXACT = 1 << 22      # up to here products and sums of 64 of them are exact in doubles
SCANNED = 1 << 13    # vectors scanned at a time
MARGIN = 1e-9


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM,
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, point) of the usable vectors; ``point`` is the bytes of floor(scale * x) as 32-bit integers."""
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([("vec_id", b.schema.field(0).type), ("point", pa.binary())])
            right = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False)
            rows = b.filter(right)
            x = pc.list_flatten(rows.column(1)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            finite = np.isfinite(x).all(axis=1)  # a null component is NaN here
            x = np.floor(x[finite] * scale)
            if x.size and np.abs(x).max() > LIMIT:
                raise ValueError(f"a component lies beyond {LIMIT} units of 1/{scale}")
            yield record_batch(schema, rows.column(0).filter(pa.array(finite)), binary_rows(x.astype("<i4")))

    return src.mapInArrow(make, f"vec_id {src.schema['vec_id'].dataType.simpleString()}, point binary")


def binary_rows(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary value."""
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The rows of a binary column of 32-bit integers."""
    if not len(col):
        return np.zeros((0, dim), np.int32)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int32)[col.offset]
    return np.frombuffer(data, "<i4", len(col) * dim, int(at)).reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [vector, centroid]."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most <= EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        return d.astype(np.int64)
    x = x.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c.astype(np.int64)], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to its own centroid."""
    return ((x.astype(np.int64) - c.astype(np.int64)[cluster]) ** 2).sum(axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the distance of its vectors to any other centroid can have fallen."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    for j in range(len(old)):
        move = new[j] - old[j]
        drift = np.sqrt(move @ move)
        if not drift:
            continue
        to = old - (old[j] + new[j]) / 2
        far = np.sqrt((to * to).sum(axis=1))
        outside = far > radius * (1 + MARGIN)
        safe = np.where(outside, far, 1.0)
        angle = np.arccos(np.clip(to @ move / (safe * drift), -1, 1)) - np.arcsin(np.clip(radius / safe, 0, 1))
        fall = np.where(outside, drift * np.clip(np.cos(np.maximum(angle, 0)), 0, 1), drift)
        fall[j] = 0
        out = np.maximum(out, fall)
    return out * (1 + MARGIN)


class Round:
    """One assignment: the centroids, and what their last move does to the bounds."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None, radius: np.ndarray | None = None):
        self.centroids, self.k = centroids, len(centroids)
        self.fresh = before is None
        if not self.fresh:
            self.drift = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)
            self.fall = loosening(before, centroids, radius)
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1, initial=np.inf) / 2  # nearer than this to its centroid, a vector has no nearer one

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
        """New (cluster, upper, lower) of the vectors, and how many were scanned."""
        if self.fresh:
            doubt = np.arange(len(x))
            cluster, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
        else:
            upper, lower = upper + self.drift[cluster], lower - self.fall[cluster]
            cluster, doubt = cluster.copy(), self.doubtful(cluster, upper, lower, np.arange(len(x)))
            upper[doubt] = np.sqrt(own_squared(x[doubt], self.centroids, cluster[doubt]).astype(np.float64))
            doubt = self.doubtful(cluster, upper, lower, doubt)
        for i in range(0, len(doubt), SCANNED):
            at = doubt[i:i + SCANNED]
            d = squared(x[at], self.centroids)
            best = d.argmin(axis=1)  # the first of equals
            rows = np.arange(len(at))
            cluster[at], upper[at] = best, np.sqrt(d[rows, best].astype(np.float64))
            d[rows, best] = np.iinfo(np.int64).max
            lower[at] = np.sqrt(d.min(axis=1).astype(np.float64))
        return cluster, upper, lower, len(doubt)

    def doubtful(self, cluster, upper, lower, at) -> np.ndarray:
        bound = np.maximum(lower[at], self.half[cluster[at]])
        return at[~(upper[at] + MARGIN * (1 + upper[at]) < bound)]


STATE = "cluster int, upper double, lower double, count bigint, scanned bigint, delta array<bigint>"


def assigned(state: DataFrame, step: Round, dim: int, first: bool) -> DataFrame:
    """The vectors after ``step`` with their bounds, and a row (``delta`` not null) per task and cluster with its changes."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, schema = step.k, None
        sums, count, radius, scanned = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k), 0

        def added(x: np.ndarray, cluster: np.ndarray, sign: int) -> None:
            for c in np.unique(cluster).tolist():
                sums[c] += sign * x[cluster == c].sum(axis=0, dtype=np.int64)
            count[:] += sign * np.bincount(cluster, minlength=k)

        for b in batches:
            schema = schema or pa.schema([
                b.schema.field(0), ("point", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()),
                ("lower", pa.float64()), ("count", pa.int64()), ("scanned", pa.int64()), ("delta", pa.list_(pa.int64()))])
            x = matrix(b.column(1), dim)
            was = None if first else b.column(2).to_numpy()
            bounds = (None, None) if first else (b.column(3).to_numpy(), b.column(4).to_numpy())
            now, upper, lower, n = step.assign(x, was, *bounds)
            scanned += n
            moved = np.arange(len(x)) if first else np.flatnonzero(now != was)
            added(x[moved], now[moved], 1)
            if not first:
                added(x[moved], was[moved], -1)
            np.maximum.at(radius, now, upper)
            none = pa.nulls(len(x), pa.int64())
            yield record_batch(schema, b.column(0), b.column(1), now.astype(np.int32), upper, lower, none, none,
                               pa.nulls(len(x), pa.list_(pa.int64())))
        if schema:
            yield record_batch(schema, pa.nulls(k, schema.field(0).type), pa.nulls(k, pa.binary()), np.arange(k, dtype=np.int32),
                               radius, np.zeros(k), count, np.full(k, scanned) * (np.arange(k) == 0), list(sums))

    return state.mapInArrow(work, f"vec_id {kind}, point binary, {STATE}")


def changes(table: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int], np.ndarray, int]:
    """(sums, counts, radius, scanned) of a round, summed over its tasks; one row per cluster and component comes back."""
    rows = table.where("delta is not null").select("cluster", "upper", "count", "scanned", F.posexplode("delta").alias("at", "x"))
    exact = "decimal(38,0)"  # a long may be too short for the sum of a large corpus
    got = rows.groupBy("cluster", "at").agg(F.sum(F.col("x").cast(exact)).alias("x"), F.sum("count").alias("count"),
                                            F.max("upper").alias("radius"), F.sum("scanned").alias("scanned")).collect()
    sums, counts, radius, scanned = [[0] * dim for _ in range(k)], [0] * k, np.zeros(k), 0
    for r in got:
        sums[r["cluster"]][r["at"]] = int(r["x"])
        counts[r["cluster"]], radius[r["cluster"]] = r["count"], r["radius"]
        scanned += r["scanned"] if r["at"] == 0 else 0
    return sums, counts, radius, scanned


class Clustering:
    """The rounds of one run: ``state`` is the table after the last assignment, ``centroids`` what it was assigned to."""

    def __init__(self, points: DataFrame, k: int, rounds: int, dim: int, seed: int):
        self.spark, self.dim = points.sparkSession, dim
        self.scanned: list[int] = []  # vectors scanned against all centroids, round by round
        path = self._write(points)
        state = self.spark.read.schema(points.schema).parquet(path)
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        firsts = state.orderBy(order, "point").limit(k).collect()  # k rows
        self.centroids = np.array([np.frombuffer(r["point"], "<i4") for r in firsts], np.int64).reshape(-1, dim)
        self.k = len(firsts)
        self.state = None
        sums, counts = [[0] * dim for _ in range(self.k)], [0] * self.k
        before = radius = None
        for _ in range(rounds + 1):
            if not self.k or (before is not None and (before == self.centroids).all()):
                break  # nothing moves any more
            step = Round(self.centroids, before, radius)
            table = assigned(state, step, dim, before is None)
            new = self._write(table)
            dropped(self.spark, path)
            path, table = new, self.spark.read.schema(table.schema).parquet(new)
            delta, moved, radius, scanned = changes(table, self.k, dim)
            self.scanned.append(scanned)
            sums = [[a + b for a, b in zip(s, d)] for s, d in zip(sums, delta)]
            counts = [a + b for a, b in zip(counts, moved)]
            self.state = state = table.where("delta is null")
            before, means = self.centroids, self.centroids.copy()
            for c in range(self.k):
                if counts[c]:
                    means[c] = [s // counts[c] for s in sums[c]]
            if len(self.scanned) <= rounds:
                self.centroids = means

    def _write(self, df: DataFrame) -> str:
        path = shared_dir(self.spark, "parley-tables")
        df.write.parquet(path)
        return path


def clustered_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
                      rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    run = Clustering(integer_vectors(vectors, id_col, vector_col, dim, scale), k, rounds, dim, seed)
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    if run.state is None:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                     "inertia bigint, centroid_sha256 string")
    centroids = run.centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field(0), ("cluster", pa.int32()), ("distance", pa.int64())])
            d = own_squared(matrix(b.column(1), dim), centroids, b.column(2).to_numpy())
            yield record_batch(schema, b.column(0), b.column(2), d)

    found = run.state.select("vec_id", "point", "cluster").mapInArrow(
        measure, f"vec_id {kind}, cluster int, distance bigint")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(run.k)],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
