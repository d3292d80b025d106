"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors of a label are one class in all of this, with a count and one of its rows. Trees are fitted on a bounded sample (`sample` classes of the least
hash, a documented parameter): a node splits at the median of a random projection, and vectors whose
projection lies between the quantiles 0.5 - spill and 0.5 + spill go to both sides, until a leaf is
expected to hold no more classes of the whole label than a leaf may: a quarter of the label's, LEAST_LEAF at
least and `leaf` at most. A label with that few is one leaf. Every vector of the table is indexed in
every tree. A leaf that still holds more than twice that, as the sample was too small for more splits,
is split again by a tree fitted on its own vectors, as long as that shrinks it; so depth follows the
table. Projections are drawn from seeds where they are used; only bounds are sent.

Vectors of a leaf are compared exactly, in double precision; nothing that passes is
below the threshold. A pair that shares several leaves counts in the first of them only, so that the
links of each vector are counted without writing pairs; links that join components are all that
leaves a leaf. More trees raise recall, which tests measure against brute force.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing and keep their row. Vectors of different lengths never link. A row without an id
links like any other; its component is the smallest id reachable, null if there is none. Repeated
rows are vectors of their own. Extra columns are ignored."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as c

#: Vectors of a block in a comparison, and rows of it that are multiplied at once.
BLOCK, ROWS = 4096, 512
#: Vectors of a task of the index; classes that no label is split for.
INDEX_ROWS, LEAST_LEAF = 20_000, 32


class Tree:
    """Random splits of vectors: low and high bound of each node; the projection of a node comes from
    the seed."""

    def __init__(self, x: np.ndarray, depth: int, spill: float, seed: list[int]) -> None:
        nodes = (1 << depth) - 1
        self.depth, self.seed, self.width = depth, seed, x.shape[1]
        self.low, self.high = np.zeros(nodes), np.zeros(nodes)
        planes, parts = self.planes(), {0: np.arange(len(x))}
        for i in range(nodes):
            own = parts.pop(i)
            p = x[own] @ planes[i]
            self.low[i], self.high[i] = np.quantile(p, [0.5 - spill, 0.5 + spill]) if len(p) else (0.0, 0.0)
            parts[2 * i + 1], parts[2 * i + 2] = own[p <= self.high[i]], own[p >= self.low[i]]

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((len(self.low), self.width))

    def leaves(self, x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that they are in (several by spill)."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[row], planes[node])
            left, right = p <= self.high[node], p >= self.low[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node


def _unit(blobs: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _plant(trees: int, spill: float, seed: int, kind: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The forest of each group of the sample, as one blob."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = 0.5 + spill
        for grp, t in c.groups(batches, "grp"):
            x, n, key = _unit(t.column("blob").to_pylist(), kind), t.column("n")[0].as_py(), int(t.column("seed")[0].as_py()) & (1 << 63) - 1
            leaf = t.column("leaf")[0].as_py()
            depth = 0
            while n * keep**depth > leaf and len(x) * keep**depth >= 8:
                depth += 1
            forest = [Tree(x, depth, spill, [seed, key, i]) for i in range(trees)]
            yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([pickle.dumps(forest)], pa.binary())], ["grp", "forest"])

    return run


def _index(kind: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells (tree and leaf) of each vector; batches come sorted by group, each group's forest in
    its first row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, forest, planes = None, [], []
        for batch in batches:
            nodes, grps, blobs, forests = (batch.column(x) for x in ("node", "grp", "blob", "forest"))
            keys = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > s and last != keys[s]:
                    last, forest = keys[s], pickle.loads(forests[int(s)].as_py())
                    planes = [t.planes() for t in forest]
                for a in range(s, e, 4096):
                    b = min(e, a + 4096)
                    x = _unit(blobs.slice(a, b - a).to_pylist(), kind)
                    found = [(r, (np.int64(k) << 32) + leaf) for k, t in enumerate(forest) for r, leaf in [t.leaves(x, planes[k])]]
                    r, cell = (np.concatenate(v) for v in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.to_numpy()[a:b][r]), grps.take(pa.array(a + r)), pa.array(cell)], ["node", "grp", "cell"])
        c.tidy()

    return run


def _blobs(kind: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(kind)
            blob = pa.array([flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("node", "grp", "copies")), blob], ["node", "grp", "copies", "blob"])

    return run


def _cells(members: DataFrame, sizes: DataFrame, n_groups: int, trees: int, spill: float, sample: int, seed: int, kind: type) -> DataFrame:
    """Cells (node, grp, cell) of members (node, grp, blob) of groups with sizes (grp, n, leaf)."""
    n = c.partitions(members.sparkSession)
    with_sizes = c.join_small(members, sizes, "grp", "inner", n_groups)
    # A bounded sample of each group: least hashes, through a threshold on the hash first.
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "node"), 11) / F.lit(float(1 << 53))
    some = with_sizes.withColumn("h", at).where(F.col("h") < F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n")))
    some = some.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy("h", "node"))).where(F.col("r") <= sample)
    some = some.select("grp", "blob", "n", "leaf", F.xxhash64("grp").alias("seed"), "node")
    forests = c.stash(some.repartition(n, "grp").sortWithinPartitions("grp", "node").mapInArrow(_plant(trees, spill, seed, kind), "grp string, forest binary"))
    # Each task of vectors meets the forest of its group once.
    part = F.concat_ws("#", "grp", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("n") / INDEX_ROWS))).cast("string"))
    spread = with_sizes.withColumn("part", part).drop("n", "leaf")
    firsts = spread.groupBy("grp", "part").agg(F.min("node").alias("node")).join(forests, "grp")
    parts, size = sizes.agg(F.sum(F.ceil(F.col("n") / INDEX_ROWS))).first()[0], forests.agg(F.max(F.length("forest"))).first()[0]
    spread = c.join_small(spread, firsts.select("part", "node", "forest"), ["part", "node"], "left", int(parts), 64 + int(size))
    spread = spread.repartition(n, "part").sortWithinPartitions("part", F.col("forest").isNull()).select("node", "grp", "blob", "part", "forest")
    return spread.mapInArrow(_index(kind), "node long, grp string, cell long")


def _earlier(cells: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Which pairs share one of their cells."""
    flat = np.concatenate([*cells, *other])
    if not len(flat):
        return np.zeros((len(cells), len(other)), bool)
    _, col = np.unique(flat, return_inverse=True)
    n = np.array([len(x) for x in [*cells, *other]])
    m = np.zeros((len(n), int(col.max()) + 1), np.float32)
    m[np.repeat(np.arange(len(n)), n), col] = 1
    return m[: len(cells)] @ m[len(cells) :].T > 0


def _compare(threshold: float, kind: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, 0) of links that join components and (a, links of a, 1) of each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in c.groups(batches, "task"):
            _, once = np.unique(t.column("node").to_numpy(), return_index=True)  # a repeated row gives its class again
            t = t.take(once)
            side, nodes, copies = (t.column(x).to_numpy() for x in ("side", "node", "copies"))
            one, two = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
            if not len(one) or (not len(two) and side[0] != 0):
                continue
            x = _unit(t.column("blob").to_pylist(), kind)
            cells = [np.array(v, np.int64) for v in t.column("earlier").to_pylist()]
            far, label, degree = two if len(two) else one, np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            for s in range(0, len(one), ROWS):
                own = one[s : s + ROWS]
                link = x[own] @ x[far].T >= threshold
                if not len(two):
                    link[np.arange(len(own)), s + np.arange(len(own))] = False
                a, b = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
                if len(a):
                    link[np.ix_(a, b)] &= ~_earlier([cells[own[i]] for i in a], [cells[far[i]] for i in b])
                a, b = np.nonzero(link)
                label = c.labels(label, own[a], far[b])
                degree[own] += link @ copies[far]
                if len(two):
                    degree[far] += copies[own] @ link
            joined, linked = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(degree)
            a, b = np.concatenate([nodes[joined], nodes[linked]]), np.concatenate([nodes[label[joined]], degree[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.repeat([0, 1], [len(joined), len(linked)]).astype(np.int32))], ["a", "b", "kind"])
        c.tidy()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, trees: int = 5, leaf: int = 2048, spill: float = 0.07, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """A row for each vector: id_col, n_links (other vectors linked directly), component_id (the
    smallest id reachable by links, itself included), kept (it is that smallest id)."""
    spark, n = vectors.sparkSession, c.partitions(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, name = (np.float32, "float") if single else (np.float64, "double")
    own = F.transform(F.col(vector_col).cast(f"array<{name}>"), lambda x: x + F.lit(0.0).cast(name))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), own.alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    grp = F.when(sound, F.concat_ws("/", F.size("vector").cast("string"), "label"))
    rows = rows.select("id", grp.alias("grp"), F.xxhash64("label", "vector").alias("p"), F.xxhash64(F.lit(seed), "vector", "label").alias("q"), "vector")

    # Classes of equal vectors (128-bit fingerprint), each with a number of its own and one of its rows.
    prints = c.stash(rows.drop("vector"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    classes = prints.where("grp is not null").groupBy("grp", "p", "q").agg(F.count("*").alias("copies"), first)
    at = F.monotonically_increasing_id()
    node = F.shiftrightunsigned(at, 33) + at.bitwiseAND((1 << 33) - 1) * n
    classes = c.stash(classes.select(node.alias("node"), "grp", "p", "q", "copies", F.col("first.id").alias("low")))
    n_classes = classes.count()
    wanted = classes.select("node", "copies", "low", F.col("p").alias("own_p"), F.col("q").alias("own_q"))
    found = c.join_small(rows.where("grp is not null"), wanted, F.col("id").eqNullSafe(F.col("low")) & (F.col("p") == F.col("own_p")) & (F.col("q") == F.col("own_q")), "inner", n_classes)
    found = found.select("node", "grp", "copies", "vector").dropDuplicates(["node"])  # repeated rows, and those without an id, come several times
    kept = c.stash(found.mapInArrow(_blobs(kind), "node long, grp string, copies long, blob binary"))

    # Cells: whole groups that are small, leaves of the trees of others, leaves of leaves.
    own_leaf = F.greatest(F.lit(LEAST_LEAF), F.least(F.lit(leaf), F.expr("n div 4"))).alias("leaf")
    sizes = c.stash(kept.groupBy("grp").agg(F.count("*").alias("n")).select("grp", "n", own_leaf).where("n > leaf"))
    n_large, turn = sizes.count(), 0
    spots = [c.join_small(kept.select("node", "grp"), sizes.select("grp"), "grp", "left_anti", n_large).select("node", F.xxhash64("grp").alias("cell"))]
    members = c.join_small(kept.select("node", "grp", "blob"), sizes.select("grp"), "grp", "left_semi", n_large)
    while n_large:
        split = c.stash(_cells(members, sizes, n_large, trees if turn == 0 else 1, spill, sample, seed + turn, kind).select("node", F.concat_ws("#", "grp", "cell").alias("cell"), "grp"))
        over = c.join_small(split.groupBy("grp", "cell").agg(F.count("*").alias("m")), sizes, "grp", "inner", n_large)
        over = c.stash(over.where("m > 2 * leaf and 4 * m <= 3 * n").select(F.col("cell").alias("grp"), F.col("m").alias("n"), "leaf"))
        n_large, turn = over.count(), turn + 1
        again = split.select("node", F.col("cell").alias("grp"))
        spots.append(c.join_small(again, over.select("grp"), "grp", "left_anti", n_large).select("node", F.xxhash64("grp").alias("cell")))
        if n_large:
            members = c.stash(c.join_small(again, over.select("grp"), "grp", "left_semi", n_large).join(kept.select("node", "blob"), "node"))
        sizes = over
    every = spots[0]
    for x in spots[1:]:
        every = every.unionByName(x)
    every = c.stash(every)

    # A cell that fits in a block is one task; larger ones are cut, and each block meets each other one.
    blocks = c.stash(every.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")).where("m > 1"))
    listed = every.groupBy("node").agg(F.collect_set("cell").alias("cells"))
    dealt = kept.drop("grp").join(listed, "node").withColumn("cell", F.explode("cells"))
    dealt = c.join_small(dealt, blocks, "cell", "left", blocks.count()).fillna({"m": 1}).withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    block, m = F.col("block"), F.col("m")
    row = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    others = F.sequence(F.lit(0), m - 1)
    tasks = F.concat(F.array(row(0, block, block)), F.transform(F.filter(others, lambda j: j > block), lambda j: row(1, block, j)), F.transform(F.filter(others, lambda j: j < block), lambda j: row(2, j, block)))
    dealt = dealt.select("node", "copies", "blob", F.filter("cells", lambda x: x < F.col("cell")).alias("earlier"), "cell", F.explode(tasks).alias("t"))
    dealt = dealt.select("node", "copies", "blob", "earlier", F.col("t.side").alias("side"), F.xxhash64("cell", "t.i", "t.j").alias("task"))
    found = c.stash(dealt.repartition(4 * n, "task").sortWithinPartitions("task", "node").mapInArrow(_compare(threshold, kind), "a long, b long, kind int"))

    links = c.components(found.where("kind = 0").select("a", "b"))
    degrees = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    of_class = c.join_small(classes.drop("grp"), links.select(F.col("a").alias("node"), F.col("b").alias("top")), "node", "left", links.count())
    of_class = c.stash(c.join_small(of_class, degrees, "node", "left", n_classes).withColumn("top", F.coalesce("top", "node")))
    tops = c.stash(of_class.where("others is not null").groupBy("top").agg(F.min("low").alias("component"), F.count("*").alias("members")))
    of_class = c.join_counted(of_class, tops, ["top"], "members", n_classes).select("p", "q", "copies", F.coalesce("component", "low").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = c.join_counted(prints.where("grp is not null").select("id", "p", "q"), c.stash(of_class), ["p", "q"], "copies", n_classes).select("id", "component", "n_links")
    alone = prints.where("grp is null").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
