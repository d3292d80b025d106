"""Centroid clustering (Lloyd's rounds) by the kd-tree filtering algorithm, in whole numbers.

Each component x counts as floor(scale * x). Vectors are dealt into blocks of bounded size within their
partition; each block becomes a kd-tree, written once to the shared folder: its vectors in the order
of the tree, and for each node the box, the sums and (by its place) the count of its vectors. A round
walks all nodes of a level at once. The candidate nearest to the middle of a node's box dominates
another one if every point of the box is strictly nearer to it; dominated candidates are pruned. A node
with one candidate left is assigned whole, by its count and sums; a leaf with several is resolved
vector by vector. What leaves a task are the sums of each centroid, so a round sends k rows a task and
the driver sees k * (width + 1) whole numbers, whatever the table's size. As all is exact, results don't
depend on how the rows lie in partitions.

Ties go to the smaller number; only strict domination prunes, so pruning keeps them. Centroids
without vectors stay. Fewer vectors than k give fewer centroids; an empty table gives no rows. Vectors
that are null, of another width, or hold null or non-finite components are left out. Components beyond
2^26 / scale in size count as that, so that squared distances fit into 64 bits. Rows without an id are
assigned like others but never start a centroid. Repeated rows are vectors of their own; where an id
repeats, its vectors start centroids in the order of their components. Extra columns are ignored.
Sums of distances beyond 64 bits are null."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as c

#: Vectors of a tree, and about how many a leaf holds.
BLOCK, LEAF = 4096, 16
#: Largest whole number of a component.
MOST = 1 << 26
#: Below this, dot products of 64 components are exact in double precision.
EXACT = 1 << 21

Batches = Iterable[pa.RecordBatch]


class Tree:
    """Vectors in the order of a balanced kd-tree. Node i has the children 2i + 1 and 2i + 2; where
    its vectors lie follows from its place, as every node is cut in the middle."""

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.x, self.low, self.high, self.sums = x, low, high, sums
        self.depth = (len(low) + 1).bit_length() - 1
        self.start, self.end = _ranges(len(x), self.depth)

    @staticmethod
    def build(x: np.ndarray) -> tuple[np.ndarray, Tree]:
        """The tree, and where each of its vectors was."""
        depth = max(1, (len(x) // LEAF).bit_length())
        start, end = _ranges(len(x), depth)
        order = np.arange(len(x))
        low, high = (np.zeros((len(start), x.shape[1]), np.int64) for _ in "ab")
        sums = np.zeros_like(low)
        for i, (s, e) in enumerate(zip(start, end, strict=True)):
            if e > s:
                own = x[order[s:e]]
                low[i], high[i], sums[i] = own.min(0), own.max(0), own.sum(0)
                if 2 * i + 1 < len(start):
                    widest = int((high[i] - low[i]).argmax())
                    order[s:e] = order[s:e][np.argsort(own[:, widest], kind="stable")]
        return order, Tree(x[order], low, high, sums)

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ranges of vectors that are settled whole, as (nodes, their centroid); then, with nodes None,
        the vectors of all leaves that aren't, as (None, (places, cluster of each))."""
        node, left = np.array([0] if len(self.x) else [], np.int64), np.ones((1, len(centroids)), bool)
        leaves, several = [], []
        while len(node):
            low, high = self.low[node], self.high[node]
            middle = ((2 * centroids - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(left, middle, np.iinfo(np.int64).max).argmin(1)
            top = centroids[best]
            for j, z in enumerate(centroids):
                # Every point of the box is nearer to top than to z if its corner towards z is.
                corner = np.where(z > top, high, low)
                left[:, j] &= (((z - top) * (z + top - 2 * corner)).sum(1) <= 0) | (best == j)
            sole = left.sum(1) == 1
            if sole.any():
                yield node[sole], best[sole]
            node, left = node[~sole], left[~sole]
            if len(node) and 2 * node[0] + 1 >= len(self.low):
                leaves, several = node, left
                break
            node = np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
            left = left.repeat(2, 0)
            full = self.end[node] > self.start[node]
            node, left = node[full], left[full]
        if len(leaves):
            places = np.concatenate([np.arange(s, e) for s, e in zip(self.start[leaves], self.end[leaves], strict=True)])
            own = several.repeat(self.end[leaves] - self.start[leaves], 0)
            yield None, (places, np.where(own, squared(self.x[places], centroids), np.iinfo(np.int64).max).argmin(1))

    def totals(self, centroids: np.ndarray) -> np.ndarray:
        """Count and sums of the vectors of each centroid."""
        out = np.zeros((len(centroids), 1 + self.x.shape[1]), np.int64)
        for node, found in self.filtered(centroids):
            if node is None:
                places, cluster = found
                out[:, 0] += np.bincount(cluster, minlength=len(centroids))
                for j in np.unique(cluster):
                    out[j, 1:] += self.x[places[cluster == j]].sum(0)
            else:
                np.add.at(out[:, 0], found, self.end[node] - self.start[node])
                np.add.at(out[:, 1:], found, self.sums[node])
        return out

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector."""
        cluster = np.zeros(len(self.x), np.int64)
        for node, found in self.filtered(centroids):
            if node is None:
                cluster[found[0]] = found[1]
            else:
                for s, e, j in zip(self.start[node], self.end[node], found, strict=True):
                    cluster[s:e] = j
        return cluster, ((self.x - centroids[cluster]) ** 2).sum(1)


def _ranges(n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each node's vectors, in a tree of 2^depth - 1 nodes."""
    starts, ends = [np.array([0])], [np.array([n])]
    for _ in range(depth - 1):
        s, e = starts[-1], ends[-1]
        m = (s + e) // 2
        starts.append(np.stack([s, m], 1).ravel())
        ends.append(np.stack([m, e], 1).ravel())
    return np.concatenate(starts), np.concatenate(ends)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, exact."""
    if x.shape[1] <= 64 and max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - z) ** 2).sum(1) for z in centroids], 1)


def _plant(width: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Trees of a task's vectors, a row each."""

    def row(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, tree = Tree.build(x)
        blobs = [tree.x.astype("<i4"), tree.low.astype("<i4"), tree.high.astype("<i4"), tree.sums.astype("<i8")]
        columns = [pa.array([b.tobytes()], pa.binary()) for b in blobs]
        return pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *columns], ["ids", "x", "low", "high", "sums"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            flat = batch.column("whole").flatten().to_numpy().reshape(-1, width)
            for s in range(0, len(flat), BLOCK):
                ids.append(batch.column("id").slice(s, BLOCK))
                held.append(flat[s : s + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    yield row(pa.concat_arrays(ids), np.concatenate(held))
                    ids, held, n = [], [], 0
        if n:
            yield row(pa.concat_arrays(ids), np.concatenate(held))
        c.tidy()

    return run


def _trees(batches: Batches, width: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            x, low, high, sums = (np.frombuffer(batch.column(n)[i].as_py(), k).reshape(-1, width).astype(np.int64) for n, k in (("x", "<i4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8")))
            yield batch.column("ids")[i].values, Tree(x, low, high, sums)


def _sums(centroids: np.ndarray) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        out = sum(tree.totals(centroids) for _, tree in _trees(batches, centroids.shape[1]))
        if not isinstance(out, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


def _assign(centroids: np.ndarray) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, centroids.shape[1]):
            cluster, distance = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])
        c.tidy()

    return run


def _whole(vector: Column, scale: int) -> Column:
    kept = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST))))
    return F.transform(vector, kept)


def kd_means(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """A row for each vector of the given width: id_col, cluster, distance (squared, to its centroid),
    cluster_inertia and inertia (sums of distances in its cluster and in all), centroid_sha256 (of the
    components of its final centroid, as decimal numbers joined by commas), cluster_size.

    Centroids start as the k vectors with the least SHA-256 of seed:id and move in each of `rounds`
    rounds to the floors of their vectors' means; then vectors are assigned once more."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = c.spread(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") == width) & F.forall("vector", finite)).select("id", _whole(F.col("vector"), scale).alias("whole"))
    trees = c.stash(rows.mapInArrow(_plant(width), "ids array<long>, x binary, low binary, high binary, sums binary"))
    chosen = rows.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    centroids = np.array([r["whole"] for r in chosen.orderBy("h", "whole").limit(k).collect()], np.int64).reshape(-1, width)
    if not len(centroids):
        empty = rows.where("false").select(F.col("id").alias(id_col))
        return empty.selectExpr("*", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256", "0L as cluster_size")
    for _ in range(rounds):
        part = trees.mapInArrow(_sums(centroids), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "v"))
        total = np.zeros((len(centroids), width + 1), object)
        for r in part.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k * (width + 1) rows
            total[r["cluster"], r["i"]] = int(r["v"])
        moved = [[int(s) // int(t[0]) for s in t[1:]] if t[0] else list(z) for t, z in zip(total, centroids.tolist(), strict=True)]
        centroids = np.array(moved, np.int64)
    out = c.stash(trees.mapInArrow(_assign(centroids), "id long, cluster int, distance long"))
    of = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n")).collect()  # k rows
    total, fits = sum(int(r["d"]) for r in of), lambda x: x if x < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids.tolist()]
    about = [(r["cluster"], fits(int(r["d"])), fits(total), shas[r["cluster"]], r["n"]) for r in of]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
