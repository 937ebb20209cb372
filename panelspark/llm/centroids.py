"""Centroid clustering with lower bounds from Ptolemy's inequality.

Vectors become integers, so distances, sums and ties are exact. The seeds serve twice: as first
centroids and as pivots. Every vector's squared distances to the pivots are computed once and
stored beside it. For four points of a Euclidean space, |xp cs - xs cp| <= xc ps: with the cached
distances of a vector x and those of a centroid c, each pivot pair (p, s) gives a lower bound of xc
without touching a component. The pivot pairs are fixed; for a centroid those that hold its nearest
pivot are used, as their bounds are the tightest.

Rounding is on the safe side: a bound loses more than the error that its roots, products and
difference can carry. The centroid with the least bound is measured exactly; only centroids whose
bound does not exceed that distance survive and are measured too, so the assignment is that of a
full search, ties to the smaller number.

A round reads the stored vectors once. A task returns one row per centroid (count and sums), so
what reaches the driver is centroids x components numbers for any number of rows.

Left out: vectors that are null or of another length, and those with components that are null, not
finite, or beyond 2^27 as integers (their squared distances do not fit 64 bits). Rows without an id
take part but are no seeds. Equal rows each count; of equal ids the smaller vector is the earlier
seed. With fewer vectors than asked for there are fewer centroids; no vectors give an empty result.
Sums of distances beyond 64 bits are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.storage import cut_lineage

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
LARGEST = 1 << 27
ERROR = 2.0**-50  # four times the unit roundoff of a double: roots, products and difference together


def whole_numbers(df: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id`` and ``x``, the integers floor(scale * component) as an array of ints."""
    numbers = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    rows = df.filter(F.size(embedding) == dimensions).filter(F.coalesce(
        F.forall(F.col(embedding).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) <= LARGEST)), F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), numbers.cast("array<int>").alias("x"))


def seeds(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:vec_id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.filter("vec_id IS NOT NULL").select(order.alias("h"), "x").orderBy("h", "x").limit(count).collect()
    return np.array([r["x"] for r in first], np.int64)


def rows_of(column) -> np.ndarray:
    """A list column as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to one point."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Ptolemaic lower bounds of distances to ``centroids`` from cached distances to ``pivots``."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.between = np.sqrt(np.array([squared(pivots, p) for p in pivots], float))  # pivot to pivot
        self.to_pivots = np.sqrt(np.array([squared(pivots, c) for c in centroids], float))
        self.nearest = self.to_pivots.argmin(axis=1)
        self.measured = 0  # exact distances computed so far

    def lower(self, roots: np.ndarray, k: int) -> np.ndarray:
        """Lower bounds of the squared distances to centroid ``k``; ``roots`` are distances to the pivots."""
        p, best = self.nearest[k], np.zeros(len(roots))
        for s in np.flatnonzero(self.between[p] > 0):
            one, other = roots[:, p] * self.to_pivots[k, s], roots[:, s] * self.to_pivots[k, p]
            bound = (np.abs(one - other) - ERROR * (one + other)) / self.between[p, s]
            np.maximum(best, bound, out=best)
        return best * best * (1 - 16 * ERROR)

    def assign(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid."""
        roots = np.sqrt(cached.astype(float))
        low = np.stack([self.lower(roots, k) for k in range(len(self.centroids))])
        guess = low.argmin(axis=0)
        distance = np.empty(len(x), np.int64)
        for k in np.unique(guess):
            at = np.flatnonzero(guess == k)
            distance[at] = squared(x[at], self.centroids[k])
        cluster = guess.astype(np.int32)
        self.measured += len(x)
        for k, centroid in enumerate(self.centroids):
            # float(d) may round up, which keeps a survivor more, or down by less than the bound gives away
            at = np.flatnonzero((low[k] <= distance) & (guess != k))
            d = squared(x[at], centroid)
            better = (d < distance[at]) | ((d == distance[at]) & (k < cluster[at]))
            distance[at[better]], cluster[at[better]] = d[better], k
            self.measured += len(at)
        return cluster, distance


def sums(stored: DataFrame, bounds: Bounds) -> tuple[np.ndarray, list[list[int]]]:
    """Per centroid the number of its vectors and their exact componentwise sums."""
    def partial(batches):
        size = bounds.centroids.shape
        total, count = np.zeros(size, np.int64), np.zeros(size[0], np.int64)
        for batch in batches:
            x = rows_of(batch.column("x"))
            if len(x):
                cluster, _ = bounds.assign(x, rows_of(batch.column("cached")))
                np.add.at(total, cluster, x)
                count += np.bincount(cluster, minlength=size[0])
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = stored.select("x", "cached").mapInArrow(partial, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "v")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    n, k, d = np.zeros(len(bounds.centroids), np.int64), *bounds.centroids.shape
    total = [[0] * d for _ in range(k)]
    for r in each.collect():  # at most centroids x components rows
        n[r["cluster"]] = r["n"]
        total[r["cluster"]][r["at"]] = int(r["v"])
    return n, total


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (its components)."""
    rows = whole_numbers(df, vec_id, embedding, dimensions, scale)
    points = pivots = seeds(rows, centroids, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(points):
        empty = df.sparkSession.createDataFrame([], out)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))])

    def with_cache(batches):
        for batch in batches:
            x = rows_of(batch.column("x"))
            cached = np.stack([squared(x, p) for p in pivots], axis=1) if len(x) else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cached.tolist(), pa.list_(pa.int64()))],
                                             names=["vec_id", "x", "cached"])

    stored = cut_lineage(rows.mapInArrow(with_cache, "vec_id long, x array<int>, cached array<long>"), "pivots")
    for _ in range(rounds):
        n, total = sums(stored, Bounds(points, pivots))
        points = np.array([[v // int(m) for v in t] if m else c for m, t, c in zip(n, total, points.tolist(), strict=True)], np.int64)
    bounds = Bounds(points, pivots)

    def assigned(batches):
        for batch in batches:
            x = rows_of(batch.column("x"))
            found = bounds.assign(x, rows_of(batch.column("cached"))) if len(x) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *map(pa.array, found)], names=["vec_id", "cluster", "distance"])

    done = cut_lineage(stored.mapInArrow(assigned, out), "assigned")
    inertia = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # one row per centroid
    whole = sum(int(r["sum"]) for r in inertia)
    fits = lambda v: v if v < 1 << 63 else None
    of = df.sparkSession.createDataFrame(
        [(r["cluster"], fits(int(r["sum"])), fits(whole), points[r["cluster"]].tolist()) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # as many rows as centroids


def digests(df: DataFrame) -> DataFrame:
    """The query's columns: the centroid as SHA-256 of its components joined by commas."""
    done = cluster(df.select("vec_id", "embedding"))
    text = F.concat_ws(",", F.transform("centroid", lambda v: v.cast("string")))
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


def brute_force(rows: list[tuple], centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> list[tuple]:
    """The same rows from all distances in Python integers, for tests; ``rows`` are usable vectors."""
    made = [(i, [int(np.floor(scale * float(v))) for v in x]) for i, x in rows]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in made if i is not None)
    points = [x for _, x in order[:centroids]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), k) for k, p in enumerate(points))

    for _ in range(rounds):
        held = [[x for _, x in made if nearest(x)[1] == k] for k in range(len(points))]
        points = [[sum(v) // len(xs) for v in zip(*xs, strict=True)] if xs else p for xs, p in zip(held, points, strict=True)]
    found = [(i, *nearest(x)) for i, x in made]
    each = {k: sum(d for _, d, c in found if c == k) for _, _, k in found}
    return [(i, k, d, each[k], sum(each.values()), hashlib.sha256(",".join(map(str, points[k])).encode()).hexdigest()) for i, d, k in found]


def _round(n: int) -> str:
    """SQL of one assignment and update."""
    return f"""
a{n} AS MATERIALIZED (SELECT v.id, min({{'d': v.s - 2 * list_inner_product(v.x, c.x) + c.s, 'k': c.k}}) AS m FROM v CROSS JOIN c{n} c GROUP BY v.id),
u{n} AS (SELECT k, list(q ORDER BY p) AS x FROM (
    SELECT k, p, (t - ((t % n) + n) % n) // n AS q FROM (
        SELECT a.m.k AS k, e.p AS p, sum(e.y)::BIGINT AS t, count(*) AS n FROM a{n} a JOIN e ON e.id = a.id GROUP BY 1, 2)) GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT k, x, list_inner_product(x, x) AS s FROM (
    SELECT c.k, coalesce(u.x::DOUBLE[], c.x) AS x FROM c{n} c LEFT JOIN u{n} u USING (k)))"""


#: Sums of squares below 2^53 are exact in doubles. Rows are numbered, as ids may repeat.
ORACLE = f"""
WITH w AS (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda y: floor(y::DOUBLE * {SCALE})) AS x FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMENSIONS}),
v AS MATERIALIZED (SELECT id, vec_id, x, list_inner_product(x, x) AS s FROM w),
e AS MATERIALIZED (SELECT id, unnest(x)::BIGINT AS y, generate_subscripts(x, 1) AS p FROM v),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS k, x, s FROM (
        SELECT sha256('1:' || vec_id) AS h, x, s FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {CENTROIDS})),
{','.join(_round(n) for n in range(ROUNDS))},
f AS MATERIALIZED (
    SELECT v.id, v.vec_id, min({{'d': v.s - 2 * list_inner_product(v.x, c.x) + c.s, 'k': c.k}}) AS m FROM v CROSS JOIN c{ROUNDS} c GROUP BY v.id, v.vec_id)
SELECT f.vec_id, f.m.k AS cluster, f.m.d::BIGINT AS distance, sum(f.m.d::BIGINT) OVER (PARTITION BY f.m.k)::BIGINT AS cluster_inertia,
    sum(f.m.d::BIGINT) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x::BIGINT[], ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c ON c.k = f.m.k
"""
