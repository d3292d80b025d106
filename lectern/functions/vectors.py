"""Vector columns: cosine similarity, and embedding as a pluggable Arrow-batched function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """In double precision; null where lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is zero or lengths differ."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(dimension: int) -> Encoder:
    """Feature hashing of words, L2-normalised: the default where no model is installed."""
    import re
    import zlib

    word = re.compile(r"\w+")

    def encode(texts: list[str]) -> np.ndarray:
        found = [word.findall((t or "").lower()) for t in texts]
        out = np.zeros((len(texts), dimension), np.float32)
        known = {w: zlib.crc32(w.encode()) for w in set().union(*found)}  # of this batch
        h = np.array([known[w] for x in found for w in x], np.int64)
        np.add.at(out, (np.repeat(np.arange(len(texts)), [len(x) for x in found]), h % dimension), np.where(h >> 31, 1, -1).astype(np.float32))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedder(make: Callable[[], Encoder]) -> Callable[[Column], Column]:
    """Column function that embeds texts; make() loads the model once in each Python worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series(list(encode(texts.tolist())))

    return embed


def embed(dimension: int = 384) -> Callable[[Column], Column]:
    return embedder(lambda: hashed_encoder(dimension))
