"""A search index of vectors: cells of a sphere, for exact nearest neighbours that read few of them.

Vectors count as directions. Cell centres are fitted on a bounded sample (a parameter); every vector of the table
goes to the cell of its nearest centre and is stored there with its norm, which is computed once. A cell
knows its widest angle, so no vector of it is nearer to a question than the angle to the centre
less that one. A search first looks into the cells that promise most, until they hold k
vectors; the k-th similarity found there rules out every cell whose bound lies below it. What is left is
read, and the result is that of a search over all vectors.

Vectors that are null, empty, zero or hold null or non-finite components are found by no question and aren't
stored; questions like that find nothing. Ties go to the smaller chunk id. Rows with equal ids are
vectors of their own. A cell is dealt over many files and tasks, so that one direction may hold a
third of all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.search import QUESTION_BYTES, QUESTIONS, nearest
from lectern.plans.tables import shared_dir, written

#: Most cells; vectors of a file of a cell; what bounds and similarities may be off by.
MOST_CELLS, FILE_ROWS, SLACK = 4096, 100_000, 2e-6


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _sound(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centres(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of unit vectors by spherical k-means; empty cells keep their centre."""
    pick = np.random.default_rng(seed)
    centres = x[np.sort(pick.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        cell = np.concatenate([(x[s : s + 4096] @ centres.T).argmax(1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


class Cells:
    """An index at a path: the table rows (chunk_id, vector, norm, cell and columns to filter by), in a folder for each cell;
    the table cells (cell, centre, angle, n). read counts what the last search read: cells and vectors."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()  # MOST_CELLS rows
        self.cell, self.n = about["cell"].to_numpy(), about["n"].to_numpy()
        self.centre = np.stack(about["centre"].to_numpy()) if len(about) else np.zeros((0, 0))
        self.angle = about["angle"].to_numpy()
        self.read: dict[str, int] = {}

    def rows(self, cells: list[int]) -> DataFrame:
        """Vectors of some cells, whose folders alone are read."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, questions: DataFrame, k: int, chosen: Column | None = None, vector: str = "embedding") -> DataFrame:
        """qid, chunk_id, similarity, rank of the k nearest of the vectors that fulfil a condition. Questions
        beyond what may be broadcast are asked in parts by a hash of their qid."""
        self.read = {"cells": 0, "vectors": 0}
        own = questions.select("qid", F.col(vector).cast("array<double>").alias("v")).where(_sound("v") & (F.size("v") == self.centre.shape[1]))
        own = written(own.withColumn("q_norm", _norm(F.col("v"))))
        n = own.count()
        empty = self.spark.createDataFrame([], "qid long, chunk_id long, similarity double, rank int")
        if not len(self.cell) or not n:
            kind = self.spark.read.parquet(f"{self.path}/rows").schema["chunk_id"].dataType if len(self.cell) else "long"
            return empty.withColumn("chunk_id", F.col("chunk_id").cast(kind)).withColumn("qid", F.col("qid").cast(own.schema["qid"].dataType))
        parts = max(1, -(-n // QUESTIONS), -(-n * 8 * self.centre.shape[1] // QUESTION_BYTES), -(-n * 4 * len(self.cell) // QUESTION_BYTES))
        return reduce(DataFrame.unionByName, [self._part(own.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) if parts > 1 else own, k, chosen) for i in range(parts)])

    def _part(self, own: DataFrame, k: int, chosen: Column | None) -> DataFrame:
        bounds = written(self._bounds(own, k))
        first = bounds.where("first")
        near = written(_best(self._pairs(own, first, k, chosen), k))
        least = near.groupBy("qid").agg(F.count("*").alias("found"), F.min("similarity").alias("least"))
        more = bounds.where("not first").join(F.broadcast(least), "qid", "left").where((F.coalesce("found", F.lit(0)) < k) | (F.col("bound") >= F.col("least") - SLACK))
        return _best(near.drop("rank").unionByName(self._pairs(own, more.select("qid", "cell"), k, chosen)), k)

    def _bounds(self, own: DataFrame, k: int) -> DataFrame:
        """Each question's cells, which of them are looked into first, and how similar their vectors are at most."""
        cell, centre, angle, n = self.cell, self.centre, self.angle, self.n

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s in range(0, len(b), 256):
                    part = b.iloc[s : s + 256]
                    to = np.arccos(np.clip(_units(part["v"]) @ centre.T, -1, 1))
                    bound = np.cos(np.maximum(0, to - angle))
                    order = np.argsort(to, axis=1, kind="stable")
                    seen = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, seen < k, axis=1)
                    yield pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), len(cell)), "cell": np.tile(cell, len(part)), "bound": bound.ravel(), "first": first.ravel()})

        return own.select("qid", "v").mapInPandas(run, f"qid {own.schema['qid'].dataType.simpleString()}, cell int, bound double, first boolean")

    def _pairs(self, own: DataFrame, cells: DataFrame, k: int, chosen: Column | None) -> DataFrame:
        """Similarities of questions and the vectors of their cells: each task's k best."""
        cells = written(cells.select("qid", "cell"))
        wanted = [r["cell"] for r in cells.select("cell").distinct().collect()]  # MOST_CELLS at most
        self.read["cells"] += len(wanted)
        self.read["vectors"] += int(self.n[np.isin(self.cell, wanted)].sum())
        rows = self.rows(wanted)
        rows = rows if chosen is None else rows.where(chosen)
        return nearest(rows.select("chunk_id", "vector", "cell"), own.select("qid", F.col("v").alias("vector")), k, cells).drop("rank")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("similarity"), "chunk_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def build_cells(chunks: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), cells: int | None = None, sample: int = 10_000, rounds: int = 6, seed: int = 7, chunk_id: str = "chunk_id", vector: str = "embedding") -> Cells:
    """Indexes all vectors of the most frequent length. cells: about the root of their number if none is given.
    sample: centres are fitted on so many vectors (those of the least hash) at most. keep: columns that
    searches filter by."""
    spark = chunks.sparkSession
    path = path or shared_dir(spark)
    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("vector"), *keep).where(_sound("vector"))
    sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, n = (sizes[0]["width"], sizes[0]["count"]) if sizes else (0, 0)
    rows = rows.where(F.size("vector") == width)
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vector"), 11) / F.lit(float(1 << 53))
    some = rows.select("vector", at.alias("h")).where(F.col("h") < 2.0 * sample / max(n, 1)).orderBy("h").limit(sample).toPandas()
    centre = fit_centres(_units(some["vector"]), cells or min(MOST_CELLS, int(np.ceil(np.sqrt(n)))), rounds, seed) if n else np.zeros((0, 0))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 4096):
                part = b.iloc[s : s + 4096]
                near = _units(part["vector"]) @ centre.T
                cell = near.argmax(1)
                yield part.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(part)), cell], -1, 1)))

    placed = written(rows.mapInPandas(assign, f"{kinds}, cell int, angle double")) if n else rows.selectExpr("*", "0 as cell", "0D as angle")
    about = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
    centres = spark.createDataFrame([(i, v) for i, v in enumerate(centre.tolist())], "cell int, centre array<double>")
    about = written(about.join(centres, "cell"), f"{path}/cells")
    salt = F.pmod(F.xxhash64("chunk_id", "vector", F.monotonically_increasing_id()), F.ceil(F.col("n") / FILE_ROWS))
    dealt = placed.drop("angle").join(F.broadcast(about.select("cell", "n")), "cell").withColumn("norm", _norm(F.col("vector"))).withColumn("salt", salt)
    dealt.repartition("cell", "salt").drop("n", "salt").write.partitionBy("cell").parquet(f"{path}/rows")
    return Cells(spark, path)
