"""Clustering by kd-trees against plain Lloyd's rounds."""

import hashlib
import math

import numpy as np
import pytest

from lectern.llm import kd_clusters
from lectern.llm.kd_clusters import Tree, kd_means
from lectern.llm.queries import QUERIES
from test_edges import CLASH


def plain(rows, width=64, k=8, rounds=10):
    """{row number: (cluster, distance, inertia of the cluster, of all, hash)} of (vec_id, vector) rows."""
    kept = [(n, i, [math.floor(max(-(2.0**26), min(2.0**26, 1024 * float(v)))) for v in x]) for n, (i, x) in enumerate(rows) if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for _, i, x in kept if i is not None)
    z = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        found = [near(x)[1] for _, _, x in kept]
        for j in range(len(z)):
            own = [x for (_, _, x), f in zip(kept, found, strict=True) if f == j]
            if own:
                z[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    last = [near(x) for _, _, x in kept]
    total = {j: sum(d for d, f in last if f == j) for j in range(len(z))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted((str(i), j, d, total[j], sum(total.values()), sha[j]) for (_, i, _), (d, j) in zip(kept, last, strict=True))


def found(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = QUERIES["op13_kd_clusters"](spark, small)
    assert found(got) == plain(rows)
    assert {r["cluster"]: r["cluster_size"] for r in got.collect()} == {r["cluster"]: r["count"] for r in got.groupBy("cluster").count().collect()}


@pytest.mark.parametrize("parts", [1, 5])
def test_ties_repeats_and_broken_vectors(spark, parts):
    """Few distinct vectors, so that centroids coincide and distances tie; a third of all rows is one vector."""
    pick = np.random.default_rng(1)
    rows = [(i, [float(v) for v in pick.integers(-2, 2, 64) / 1024]) for i in range(60)] + [(100 + i, [0.25] * 64) for i in range(60)]
    rows += [(7, [0.5] * 64), (7, [0.75] * 64), (7, [0.5] * 64), (None, [0.25] * 64), (None, None), (200, []), (201, [1.0] * 63), (202, [1.0] * 65), (203, [float("nan"), *[0.0] * 63]), (204, [float("-inf"), *[0.0] * 63]), (205, [None, *[0.0] * 63]), (206, [-0.0001] * 64)]
    df = spark.createDataFrame([(i, x, *["clash"] * len(CLASH)) for i, x in rows], "vec_id long, embedding array<float>, " + ", ".join(f"{n} string" for n in CLASH)).repartition(parts)
    assert found(kd_means(df)) == plain(rows)


def test_empty_few_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    assert kd_means(spark.createDataFrame([], schema)).collect() == []
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert found(kd_means(spark.createDataFrame(few, schema))) == plain(few)
    huge = [(i, [3e300 * (-1) ** (i // 2), *[float(i)] * 63]) for i in range(20)]
    assert found(kd_means(spark.createDataFrame(huge, schema))) == plain(huge)
    assert kd_means(spark.createDataFrame([(None, [0.0] * 64)], schema)).collect() == []


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 3, 5), (17, 2, 4), (500, 2, 1000), (3000, 3, 1 << 25), (900, 64, 600)])
def test_filtering_settles_every_vector_as_plain_distances_do(n, width, spread):
    pick = np.random.default_rng(n)
    x = pick.integers(-spread, spread, (n, width))
    z = pick.integers(-spread, spread, (7, width))
    z[3] = z[1]
    order, tree = Tree.build(x)
    plain_ = ((x[:, None] - z) ** 2).sum(2)
    cluster, distance = tree.assigned(z)
    assert (cluster == plain_.argmin(1)[order]).all() and (distance == plain_.min(1)[order]).all()
    totals = tree.totals(z)
    assert all(totals[j, 0] == (plain_.argmin(1) == j).sum() and (totals[j, 1:] == x[plain_.argmin(1) == j].sum(0)).all() for j in range(len(z)))


def test_whole_nodes_are_assigned():
    """Of far clusters, nodes and not vectors are looked at."""
    pick = np.random.default_rng(2)
    z = np.array([[0, 0], [100_000, 0], [0, 100_000]])
    x = z.repeat(1000, 0) + pick.integers(-50, 50, (3000, 2))
    _, tree = Tree.build(x)
    whole = sum(int((tree.end[node] - tree.start[node]).sum()) for node, _ in tree.filtered(z) if node is not None)
    assert whole > 2800  # all but the leaves in which two clusters meet
    assert kd_clusters.squared(x, z).shape == (3000, 3)
