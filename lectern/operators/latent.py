"""A trained embedding: the leading singular directions of a weighted table of term counts, found by a
randomised range finder, and texts projected onto them in vectorised batches.

Words are hashed to a fixed number of features, so everything that is broadcast or sent to the driver
(the weight of each feature, directions of features) is bounded by parameters, whatever the corpus. Each pass
over the texts is one job: tasks multiply their rows with the directions and back, partial products are
added up block by block of features in two steps, ordered, so reruns on the same files agree.

A text is (1 + log of count) x log(1 + texts / texts with the feature), of length 1. Null and empty texts, and
texts of unseen words alone, have the zero vector; directions beyond the rank of the table are zero; an
empty table gives zeros. Repeated rows count as often as they come; other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.tables import spread, written

#: A word.
WORD = r"([\p{L}\p{N}_]+)"
#: Features in a block of sums; bytes of texts that are multiplied at a time; partial sums added in one task;
#: texts of a task of a pass (each shuffles size x (dimension + extra) doubles, so small ones cost more than they save).
BLOCK, DENSE, FAN_IN, TEXTS = 128, 64 << 20, 64, 1 << 14
#: Texts whose words are hashed at once.
ROWS = 512


def features(text: Column, size: int) -> Column:
    """The feature of each word of a text, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % size).cast("int"))


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of _binary, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int32) if data is not None and at[-1] > at[0] else np.zeros(0, np.int32), np.diff(at) // 4


def term_counts(texts: DataFrame, text: str = "text", size: int = 1 << 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns to keep, and of each text its features (ids, ascending, each once) and how often they come (counts), as 32-bit
    numbers. Spark leaves the words alone, a space between them; a task hashes each distinct word of a batch once."""
    found = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD.replace("[", "[^").strip("()"), " ")
    rows = texts.select(*keep, found.alias("words__"))
    kinds = "".join(f"`{c}` {kind}, " for c, kind in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):  # what is at hand at once stays small
                batch = whole.slice(s, ROWS)
                n = batch.num_rows
                words = pc.split_pattern(batch.column("words__").cast(pa.large_string()), " ")
                flat = words.flatten().dictionary_encode()
                hashed = np.array([zlib.crc32(w.encode()) % size if w else -1 for w in flat.dictionary.to_pylist()], np.int64)
                feature = hashed[flat.indices.to_numpy()]
                row = np.repeat(np.arange(n, dtype=np.int64), pc.list_value_length(words).to_numpy())
                key, count = np.unique((row * size + feature)[feature >= 0], return_counts=True)
                at = np.searchsorted(key, np.arange(n + 1) * size)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _binary(key % size, at), _binary(count, at)], [*keep, "ids", "counts"])

    return rows.mapInArrow(run, f"{kinds}ids binary, counts binary")


def weighed(row: np.ndarray, col: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzeros (row, feature, value) of counted features of n texts."""
    value = (1 + np.log(count)) * idf[col]
    known = value > 0
    row, col, value = row[known], col[known], value[known]
    return row, col, value / np.sqrt(np.bincount(row, value * value, n))[row]


def weigh(ids: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzeros (row, feature, value) of texts of features, by row and feature."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    key, count = np.unique(row * len(idf) + ids, return_counts=True)
    return weighed(key // len(idf), key % len(idf), count, n, idf)


def _nonzeros(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, n = _numbers(batch.column("ids"))
    return weighed(np.repeat(np.arange(len(n), dtype=np.int64), n), ids, _numbers(batch.column("counts"))[0], len(n), idf)


def _dense(nonzeros: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, size: int) -> Iterator[tuple[slice, np.ndarray | slice, np.ndarray]]:
    """Some texts at a time: which they are, the features that they have, and a dense table of both. A product of
    that with directions takes less time than one of gathered rows, though most of the table is zero."""
    row, col, value = nonzeros
    step = max(1, min(n, DENSE // (8 * size)))
    whole = None  # one table for all, of which only what was filled is cleared
    for s in range(0, n, step):
        texts = slice(s, min(n, s + step))
        own = slice(*np.searchsorted(row, [texts.start, texts.stop]))
        has = np.zeros(size, bool)
        has[col[own]] = True
        if 2 * has.sum() > size:
            whole = np.zeros((step, size)) if whole is None else whole
            whole[row[own] - s, col[own]] = value[own]
            yield texts, slice(None), whole[: texts.stop - s]
            whole[row[own] - s, col[own]] = 0
        else:
            table = np.zeros((texts.stop - s, int(has.sum())))
            table[row[own] - s, (np.cumsum(has) - 1)[col[own]]] = value[own]
            yield texts, np.flatnonzero(has), table


def project(nonzeros: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, directions: np.ndarray) -> np.ndarray:
    out = np.zeros((n, directions.shape[1]))
    for texts, used, table in _dense(nonzeros, n, len(directions)):
        out[texts] = table @ directions[used]
    return out


def _flat(texts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    texts = [np.asarray([] if x is None else x, np.int64) for x in texts]
    return np.concatenate([np.zeros(0, np.int64), *texts]), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("part")
    total = np.zeros(len(parts["sums"].iloc[0]) // 8)
    for x in parts["sums"]:
        total += np.frombuffer(x)
    return pd.DataFrame({"block": parts["block"].iloc[:1], "part": parts["part"].iloc[:1], "sums": [total.tobytes()]})


def _gram(texts: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A'A times directions, where A has a row for each text; one pass over the texts."""
    held = texts.sparkSession.sparkContext.broadcast((idf, directions))
    width = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, to = held.value
        out = np.zeros_like(to)
        for batch in batches:
            for _, used, table in _dense(_nonzeros(batch, weights), batch.num_rows, len(to)):
                out[used] += table.T @ (table @ to[used])
        full = [b for b in range(0, len(out), BLOCK) if out[b : b + BLOCK].any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in full], pa.int32()), pa.array([part] * len(full), pa.int32()), pa.array([out[b : b + BLOCK].tobytes() for b in full], pa.binary())], ["block", "part", "sums"])

    schema = "block int, part int, sums binary"
    sums = texts.mapInArrow(run, schema).groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(_summed, schema).groupBy("block").applyInPandas(_summed, schema)
    out = np.zeros_like(directions)
    for r in sums.collect():  # at most as many rows as there are blocks of features
        block = np.frombuffer(bytes(r["sums"])).reshape(-1, width)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(block)] = block
    held.unpersist()
    return out


@dataclass(frozen=True)
class Latent:
    """idf: weight of each feature; directions: features x dimension; values: singular values."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray

    def encode(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """Vectors of length 1 (or 0) of texts of features."""
        ids, offsets = _flat(texts)
        return self._unit(weigh(ids, offsets, self.idf), len(offsets) - 1)

    def _unit(self, nonzeros: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        out = project(nonzeros, n, self.directions)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def embed_counted(self, rows: DataFrame) -> DataFrame:
        """Rows of term_counts with the vector of each in the place of its features."""
        held = rows.sparkSession.sparkContext.broadcast((self.idf, self.directions, self.values))
        keep = [c for c in rows.columns if c not in ("ids", "counts")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Latent(*held.value)
            for batch in batches:
                found = own._unit(_nonzeros(batch, own.idf), batch.num_rows)
                at = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(at, pa.array(found.ravel()))], [*keep, "embedding"])

        return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("embedding", T.ArrayType(T.FloatType()))]))

    def embed(self, text: Column) -> Column:
        """The vector of a text: array<float>. Fits Engine(embedder=...)."""
        held = SparkSession.getActiveSession().sparkContext.broadcast((self.idf, self.directions, self.values))

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Latent(*held.value)
            for texts in batches:
                yield pd.Series(list(own.encode(texts)), dtype=object)

        return run(features(text, len(self.idf)))

    def save(self, spark: SparkSession, path: str) -> None:
        """A row for each feature, and one (-1) of the singular values."""
        rows = [(-1, 0.0, self.values.tolist()), *((i, float(w), d.tolist()) for i, (w, d) in enumerate(zip(self.idf, self.directions, strict=True)) if w)]
        spark.createDataFrame(rows, "feature int, idf double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/size={len(self.idf)}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Latent:
        rows = spark.read.parquet(path).collect()
        values = np.array(next(r["direction"] for r in rows if r["feature"] == -1))
        idf = np.zeros(rows[0]["size"])
        directions = np.zeros((len(idf), len(values)))
        for r in rows:
            if r["feature"] >= 0:
                idf[r["feature"]], directions[r["feature"]] = r["idf"], r["direction"]
        return Latent(idf, directions, values)


def fit(texts: DataFrame, text: str = "text", dimension: int = 64, size: int = 1 << 14, rounds: int = 6, extra: int = 32, seed: int = 7) -> Latent:
    """Learns from all texts. Passes over them: one for the weights, rounds + 1 for the directions (more rounds
    come closer to the singular vectors where singular values lie close together).
    Broadcast and sent to the driver: size x (dimension + extra) doubles, 12 MB by default."""
    return learn(written(term_counts(spread(texts), text, size)), dimension, size, rounds, extra, seed)


def fit_embed(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = (), dimension: int = 64, size: int = 1 << 14, rounds: int = 6, extra: int = 32, seed: int = 7) -> DataFrame:
    """Columns to keep and the vectors (embedding) of texts in what fit learns from them; their words are found once."""
    counted = written(term_counts(spread(texts), text, size, keep))
    return learn(counted, dimension, size, rounds, extra, seed).embed_counted(counted)


def _texts_with(counted: DataFrame, size: int) -> DataFrame:
    """feature, n: how many texts have it. Each task sends a row for each feature at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            out += np.bincount(_numbers(batch.column("ids"))[0], minlength=size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["feature", "n"])

    return counted.select("ids").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(counted: DataFrame, dimension: int, size: int, rounds: int, extra: int, seed: int) -> Latent:
    """fit, of a table of term_counts that is written."""
    n = counted.count()
    idf = np.zeros(size)
    for r in _texts_with(counted, size).collect():  # at most `size` rows
        idf[r["feature"]] = np.log1p(n / r["n"])
    ids = counted.select("ids", "counts").coalesce(max(1, -(-n // TEXTS)))
    width = min(dimension + extra, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)) * (idf > 0)[:, None])[0]
    for _ in range(rounds):
        q = np.linalg.qr(_gram(ids, idf, q))[0]
    small = q.T @ _gram(ids, idf, q)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value, kind="stable")[:dimension]
    value = np.maximum(value[order], 0)
    found = q @ turn[:, order]
    found *= np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1, 1)  # signs are free: the largest is positive
    found[:, value <= 1e-9 * max(value.max(initial=0), 1e-300)] = 0
    found[idf == 0] = 0
    pad = dimension - found.shape[1]
    return Latent(idf, np.pad(found, ((0, 0), (0, pad))), np.pad(np.sqrt(value), (0, pad)))
