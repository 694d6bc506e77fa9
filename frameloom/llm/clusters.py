"""Centroid clustering (Lloyd's rounds in integers) with annulus search.

Centroids are sorted by norm. A vector finds its place among the norms by binary search; the
exact distance to the centroids beside that place bounds the distance to its nearest one from
above. Only a centroid whose norm differs from the vector's by at most that bound can be as near
(triangle inequality), so a second binary search gives the ring of centroids to compare exactly,
those on its border included. Ties go to the smaller number.

A vector's components become integers floor(scale * x), so distances and means are exact whatever
the partitions. One round is one pass over the vectors: tasks add their vectors to sums of k rows, Spark adds
the tasks' sums, and only the k centroids reach the driver. Nothing is broadcast but them.

Cases: vectors that are null, have another number of components, or hold null or non-finite ones take no part.
Rows with a null id take part but are no starting centroid before all others; rows that repeat an id are vectors of
their own, and of equal hashes the smaller id, then the smaller vector starts first. Components beyond
LIMIT are compared in Python's unbounded integers; a distance or inertia that exceeds a long is given as the largest long.
Fewer vectors than k start fewer centroids. An empty table gives an empty result. Other columns are not read.
The vectors are read once a round, so they should come from a table or a checkpoint.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Components up to which sums of float64 products are exact: 4 * 64 * LIMIT ** 2 is below 2 ** 53 for 64 components.
LIMIT = 1 << 22
#: Vectors that are compared at a time, and bits of a limb of sums that may exceed a long.
BLOCK, LIMB = 8192, 32
LARGEST = (1 << 63) - 1


@dataclass
class Annulus:
    """Centroids in the order of their norms."""

    centroids: list[list[int]]

    def __post_init__(self) -> None:
        dims = len(self.centroids[0])
        self.exact = np.array([max(map(abs, c)) <= LIMIT for c in self.centroids]) & (4 * dims * LIMIT**2 < 1 << 53)
        norms = np.array([float(sum(x * x for x in c)) ** 0.5 for c in self.centroids])
        self.order = np.lexsort([np.arange(len(norms)), norms])
        self.norms = norms[self.order]
        self.rows = np.array([c if e else [0] * dims for c, e in zip(self.centroids, self.exact, strict=True)], np.float64)
        self.squares = (self.rows**2).sum(1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """(centroid, distance, distances that a float can't hold by row) of vectors of whole numbers."""
        cluster, distance = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        slow = np.abs(vectors).max(1, initial=0) > LIMIT
        if not self.exact.any():
            slow[:] = True
        plain = np.flatnonzero(~slow)
        if len(plain):
            cluster[plain], distance[plain], far = self._ring(vectors[plain])
            slow[plain[far]] = True
        wide = {}
        for row in np.flatnonzero(slow).tolist():
            v = [int(x) for x in vectors[row].tolist()]
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, centroid, strict=True)), c) for c, centroid in enumerate(self.centroids))
            cluster[row], wide[row] = c, d
        return cluster, distance, wide

    def _ring(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of vectors within LIMIT; rows whose ring holds a centroid beyond it are told for the exact way."""
        k = len(self.norms)
        squares = (x * x).sum(1)
        norms = np.sqrt(squares)
        place = np.searchsorted(self.norms, norms)
        bound = np.full(len(x), np.inf)
        for side in (-1, 0):
            c = self.order[np.clip(place + side, 0, k - 1)]
            bound = np.minimum(bound, np.where(self.exact[c], squares - 2 * (x * self.rows[c]).sum(1) + self.squares[c], np.inf))
        # Norms are rounded; the ring is a little wider, never narrower.
        reach = np.sqrt(bound) * (1 + 1e-9) + norms * 1e-9 + 1e-6
        first, end = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        best, cluster = np.full(len(x), np.inf), np.full(len(x), k, np.int32)
        far = np.zeros(len(x), bool)
        for at, c in enumerate(self.order.tolist()):
            inside = (first <= at) & (at < end)
            if not self.exact[c]:
                far |= inside
                continue
            rows = np.flatnonzero(inside)
            if not len(rows):
                continue
            part = x if len(rows) == len(x) else x[rows]
            d = squares[rows] - 2 * (part @ self.rows[c]) + self.squares[c]
            nearer = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[nearer]], cluster[rows[nearer]] = d[nearer], c
        return cluster, best, far


def usable(column: str, dims: int) -> Column:
    """Whether a vector has exactly dims components, none null or non-finite."""
    x = F.col(column)
    return F.coalesce((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x); a power of two as scale keeps the product exact."""
    with np.errstate(over="ignore"):
        return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64) * scale)


def _limbs(sums: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(limb, values below 2 ** LIMB) that add up to sums."""
    limb = 0
    while any(sums):
        yield limb, [s & ((1 << LIMB) - 1) if s >= 0 else -((-s) & ((1 << LIMB) - 1)) for s in sums]
        sums = [s >> LIMB if s >= 0 else -((-s) >> LIMB) for s in sums]
        limb += 1


def _round(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Each non-empty centroid replaced by floor(sum / count) of its vectors."""
    search, k, dims = Annulus(centroids), len(centroids), len(centroids[0])

    def partial(batches):
        sums, count, wide = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), defaultdict(lambda: [0] * dims)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _whole(batch.column("v").slice(at, BLOCK), dims, scale)
                cluster, _, exact = search.nearest(x)
                count += np.bincount(cluster, minlength=k)
                for row in (np.abs(x).max(1) > LIMIT).nonzero()[0].tolist():
                    wide[int(cluster[row])] = [s + int(v) for s, v in zip(wide[int(cluster[row])], x[row].tolist(), strict=True)]
                    x[row] = 0
                for c in np.unique(cluster).tolist():
                    sums[c] += x[cluster == c].sum(0).astype(np.int64)
        rows = [(c, 0, int(count[c]), sums[c].tolist()) for c in range(k) if count[c]]
        rows += [(c, limb, 0, values) for c, total in wide.items() for limb, values in _limbs(total)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(a), t) for a, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["cluster", "limb", "n", "sums"])

    told = vectors.select("v").mapInArrow(partial, "cluster int, limb int, n long, sums array<long>").select("cluster", "limb", "n", F.posexplode("sums").alias("at", "part"))
    # At most k * dims rows a limb.
    total, count = defaultdict(int), defaultdict(int)
    for r in told.groupBy("cluster", "limb", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n")).collect():
        total[r["cluster"], r["at"]] += int(r["part"]) << (LIMB * r["limb"])
        count[r["cluster"], r["at"]] += r["n"]
    return [[total[c, i] // count[c, i] for i in range(dims)] if count[c, 0] else old for c, old in enumerate(centroids)]


def cluster(
    vectors: DataFrame, k: int, rounds: int, dims: int, seed: int = 0, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(one row per vector that takes part: id, cluster, distance squared; the final centroids).

    The first centroids are the k vectors with the smallest sha256 of "<seed>:<id>".
    """
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.where(usable(vector_col, dims)).select(F.col(id_col).alias("id"), v.alias("v"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    # At most k rows.
    first = kept.select(place.alias("place"), "id", "v").orderBy(F.col("place").asc_nulls_last(), "id", "v").limit(k).collect()
    schema = f"id {dict(kept.dtypes)['id']}, cluster int, distance long"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col), []
    centroids = [[int(x) for x in _whole(pa.array([r["v"]]), dims, scale)[0].tolist()] for r in first]
    for _ in range(rounds):
        centroids = _round(kept, centroids, scale)
    search = Annulus(centroids)

    def last(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                found, d, exact = search.nearest(_whole(batch.column("v").slice(at, BLOCK), dims, scale))
                distance = d.astype(np.int64)
                for row, value in exact.items():
                    distance[row] = min(value, LARGEST)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, BLOCK), pa.array(found), pa.array(distance)], ["id", "cluster", "distance"])

    return kept.mapInArrow(last, schema).withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with its cluster's and the whole inertia and the digest of its cluster's centroid."""
    rows = checkpointed(assigned)
    if not centroids:
        return rows.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    # One row for each centroid, on the driver already.
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), LARGEST)
    told = [(c, min(sums.get(c, 0), LARGEST), whole, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()) for c, centroid in enumerate(centroids)]
    table = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")
