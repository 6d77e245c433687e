"""Centroid clustering with exact integers, filtered by partition-local ball trees.

Vectors become integers, floor(scale * x). Each task builds metric trees over at most
``TREE`` of its vectors at a time: a node has its ball's centre and radius and the
count and integer sum of its vectors; nodes of at most ``LEAF`` vectors, or of equal
ones, are leaves. Trees are built once and written to the shared folder; every round
reads them, so a lost executor costs a task of one round.

A round sends the centroids (k times the dimension, whatever the number of vectors) to
the tasks. By the triangle inequality a centroid whose distance to a ball's centre less
the radius exceeds the nearest one's plus the radius can't be the nearest of any vector
inside; where one centroid is left, the whole ball is its: count and sum are added and no
vector is looked at. Other balls are descended with the centroids left, down to leaves,
which compare integers exactly. Bounds are doubles with a margin far above their
rounding, so results are those of comparing everything. Counts and sums are combined in
the task, so k rows leave it, and k rows come to the driver, which divides them exactly.

Kept are vectors of ``dim`` components, none null or non-finite; those with one of 2^21
or more in size, whose distances may not fit a long, are left out. Starting centroids are
the k kept vectors with the least sha256 of "1:<vec_id>", fewer where there are fewer;
a null vec_id starts none, repeated rows are vectors of their own. Ties go to the smaller
centroid number. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

TREE, LEAF = 4096, 16
LIMIT = 1 << 21
TREES = "ids array<bigint>, points binary, centre binary, radius binary, count binary, sum binary, bounds binary, kids binary"


def kept(vectors: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    fine = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points, and by node centre, radius, count, sum, bounds in that
    order and kids (-1 for a leaf). Node 0 is the root."""
    order, nodes, work = np.arange(len(points)), [], [(0, len(points), -1, 0)]
    while work:
        lo, hi, parent, side = work.pop()
        own = points[order[lo:hi]]
        total = own.sum(axis=0)
        centre = total / (hi - lo)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at, kids = len(nodes), [-1, -1]
        nodes.append((centre, away.max(), hi - lo, total, (lo, hi), kids))
        if parent >= 0:
            nodes[parent][5][side] = at
        if hi - lo <= leaf or (own == own[0]).all():
            continue
        a = own[away.argmax()]  # the farthest from the centre, and the farthest from that
        to_a = ((own - a) ** 2).sum(axis=1)
        left = to_a < ((own - own[to_a.argmax()]) ** 2).sum(axis=1)
        order[lo:hi] = np.r_[order[lo:hi][left], order[lo:hi][~left]]
        mid = lo + int(left.sum())
        work += [(mid, hi, at, 1), (lo, mid, at, 0)]
    names, kinds = ("centre", "radius", "count", "sum", "bounds", "kids"), (np.float64, np.float64, np.int64, np.int64, np.int32, np.int32)
    return order, {n: np.array([x[i] for x in nodes], k) for i, (n, k) in enumerate(zip(names, kinds))}


def _trees(dim: int):
    def tree(ids: list, points: np.ndarray) -> pa.RecordBatch:
        order, nodes = grow(points.astype(np.int64))
        row = {"ids": [ids[i] for i in order], "points": points[order].astype("<i4").tobytes()} | {n: x.tobytes() for n, x in nodes.items()}
        types = [pa.list_(pa.int64())] + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(row, types)], names=list(row))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = [], np.zeros((0, dim), np.int32)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            points = np.concatenate([points, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)])
            while len(ids) >= TREE:
                yield tree(ids[:TREE], points[:TREE])
                ids, points = ids[TREE:], points[TREE:]
        if ids:
            yield tree(ids, points)

    return f


class Tree:
    """One row of the trees' table."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.dim = row["ids"], dim
        self.points = np.frombuffer(row["points"], "<i4").reshape(-1, dim)
        self.centre = np.frombuffer(row["centre"]).reshape(-1, dim)
        self.radius = np.frombuffer(row["radius"])
        self.count = np.frombuffer(row["count"], np.int64)
        self.sum = np.frombuffer(row["sum"], np.int64).reshape(-1, dim)
        self.bounds = np.frombuffer(row["bounds"], np.int32).reshape(-1, 2).tolist()
        self.kids = np.frombuffer(row["kids"], np.int32).reshape(-1, 2).tolist()

    def parts(self, centroids: np.ndarray) -> Iterator[tuple[int, int | np.ndarray]]:
        """(node, number of its one centroid) of whole balls, and (leaf, the number of
        each of its vectors' centroid); each vector is in one of them."""
        work = [(0, np.arange(len(centroids)))]
        while work:
            node, left = work.pop()
            d = np.sqrt(((centroids[left] - self.centre[node]) ** 2).sum(axis=1))
            reach = 2 * self.radius[node] + 1e-6 + 1e-9 * (d.max() + self.radius[node])
            left = left[d <= d.min() + reach]
            if len(left) == 1:
                yield node, int(left[0])
            elif self.kids[node][0] < 0:
                lo, hi = self.bounds[node]
                yield node, left[((self.points[lo:hi, None, :].astype(np.int64) - centroids[left]) ** 2).sum(axis=2).argmin(axis=1)]
            else:
                work += [(k, left) for k in self.kids[node]]


def _sums(centroids: np.ndarray):
    """Each centroid's count and sum over the task's trees."""
    k, dim = centroids.shape

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree({c: batch.column(c)[i].as_py() for c in batch.schema.names}, dim)
                for node, c in tree.parts(centroids):
                    if isinstance(c, int):
                        n[c] += tree.count[node]
                        total[c] += tree.sum[node]
                    else:
                        lo, hi = tree.bounds[node]
                        n += np.bincount(c, minlength=k)
                        np.add.at(total, c, tree.points[lo:hi])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return f


def _assigned(centroids: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = centroids.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree({c: batch.column(c)[i].as_py() for c in batch.schema.names}, dim)
                cluster = np.zeros(len(tree.ids), np.int64)
                for node, c in tree.parts(centroids):
                    lo, hi = tree.bounds[node]
                    cluster[lo:hi] = c
                away = ((tree.points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    return f


def fit(trees: DataFrame, centroids: np.ndarray, rounds: int = 3) -> np.ndarray:
    """The centroids after so many rounds of assigning all vectors and averaging."""
    dim = centroids.shape[1]
    for _ in range(rounds):
        parts = trees.mapInArrow(_sums(centroids), "cluster int, n bigint, total array<bigint>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)])
        centroids = centroids.copy()
        for row in sums.collect():  # k rows
            centroids[row["cluster"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dim)]
    return centroids


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept
    vector; an inertia that doesn't fit a long is null."""
    spark, points = vectors.sparkSession, kept(vectors, dim, scale)
    seeds = points.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256), "v").limit(k)
    centroids = np.array([r.v for r in seeds.collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    trees = written(points.mapInArrow(_trees(dim), TREES), "trees")
    centroids = fit(trees, centroids, rounds)
    found = written(trees.mapInArrow(_assigned(centroids), "vec_id bigint, cluster int, distance bigint"), "clusters")
    discard(trees)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    long = lambda x: x if x < 1 << 63 else None
    about = [(c, long(s), long(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(n: int) -> str:
    near = "a{i} AS (SELECT vec_id, p, c FROM (SELECT v.vec_id, v.p, c{i}.c, row_number() OVER (PARTITION BY v.r ORDER BY list_sum(list_transform(list_zip(v.p, c{i}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c{i}.c) AS k FROM v CROSS JOIN c{i}) WHERE k = 1)"
    mean = "m{i} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS p FROM (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(p) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c), c{j} AS (SELECT c{i}.c, coalesce(m{i}.p, c{i}.p) AS p FROM c{i} LEFT JOIN m{i} USING (c))"
    return ", ".join([f"{near}, {mean}".replace("{i}", str(i)).replace("{j}", str(i + 1)) for i in range(n)] + [near.replace("{i}", str(n))])


SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p, row_number() OVER () AS r FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x) AND abs(x) < {LIMIT}, false))) = 64),
c0 AS (SELECT c, p FROM (SELECT p, CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1 AS INT) AS c FROM v WHERE vec_id IS NOT NULL) WHERE c < 16),
{_rounds(3)},
d AS (SELECT a3.vec_id, a3.c, c3.p, CAST(list_sum(list_transform(list_zip(a3.p, c3.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM a3 JOIN c3 USING (c))
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256 FROM d"""
