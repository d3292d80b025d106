"""Byte-level BPE encoding and decoding.

Encoding: pre-tokenisation by class arrays and scans, then cached pair merging (`pieces`).
Decoding joins the bytes of tokens; the tokens' byte offsets in their text are kept.

Null and empty texts have no tokens. Texts of any length are taken whole, in one piece of work
each; nothing else depends on other rows. Extra columns of the input don't matter."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm import pieces as p


def read_ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, text.splitlines()) if t}


class Codec:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merger, self.cache = p.Merger(ranks), p.Cache()
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.pool, self.size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size
        names = [b"%d," % i for i in range(len(tokens))]
        self.names, self.name_size = np.frombuffer(b"".join(names), np.uint8), np.array([len(t) for t in names])
        self.name_start = np.cumsum(self.name_size) - self.name_size

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin (one more entry), and the byte of its text at
        which each token begins."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
        points, byte = p.code_points(raw)
        full = at[:-1][np.diff(at) > 0]
        begin = np.append(byte[p.boundaries(points, np.searchsorted(byte, full))], len(raw))
        size = np.diff(begin)
        start, count = self.cache.get(p.slice_hashes(raw, begin), lambda i: self.merger.merge(raw, begin[i], size[i]))
        ids = p.runs(self.cache.pool, start, count)
        before = np.concatenate([[0], np.cumsum(count)])
        bounds = before[np.searchsorted(begin, at)]
        offsets = np.cumsum(self.size[ids]) - self.size[ids] - np.repeat(at[:-1], np.diff(bounds))
        return ids, bounds, offsets

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return p.runs(self.pool, self.start[ids], self.size[ids])

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        return p.runs(self.names, self.name_start[ids], self.name_size[ids])


_codecs: dict[str, Codec] = {}


def _codec(held: object) -> Codec:
    """One codec for each vocabulary and Python worker."""
    text = held.value
    key = hashlib.sha1(text).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(text))
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str) -> object:
    """The vocabulary file at a path of the driver, sent to the executors (a few MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _mapped(docs: DataFrame, id_col: str, text_col: str, held: object, make: Callable, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                columns = make(codec, raw[at[s] : at[e]], at[s : e + 1] - at[s])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s, e - s), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t, _) in zip(columns, fields, strict=True))], [id_col, *(n for n, _, _ in fields)])
        c.tidy()

    rows = c.spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {rows.schema['id'].dataType.simpleString()}", *(f"{n} {t}" for n, _, t in fields)]))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, ids array<int>, offsets array<bigint> (the byte of the
    text at which each token begins)."""

    def make(codec: Codec, raw: np.ndarray, at: np.ndarray) -> list:
        ids, bounds, offsets = codec.encode(raw, at)
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (ids.astype(np.int32), offsets)]

    return _mapped(docs, id_col, text_col, vocabulary(docs.sparkSession, path), make, [("ids", pa.list_(pa.int32()), "array<int>"), ("offsets", pa.list_(pa.int64()), "array<bigint>")])


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each input row: id_col, bytes binary, of its ids (null: none)."""
    held = vocabulary(rows.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            out = pa.array([codec.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), out], [id_col, "bytes"])

    own = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, f"`{id_col}` {own.schema['id'].dataType.simpleString()}, bytes binary")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids: id_col, n_tokens, ids_sha256 (of decimal ids joined
    by commas), decoded_sha256 (of the decoded bytes). Ids don't leave the task."""

    def make(codec: Codec, raw: np.ndarray, at: np.ndarray) -> list:
        ids, bounds, _ = codec.encode(raw, at)
        text, decoded = codec.decimals(ids), codec.decode(ids)
        ends = [np.concatenate([[0], np.cumsum(x[ids])])[bounds] for x in (codec.name_size, codec.size)]
        return [
            np.diff(bounds),
            [hashlib.sha256(text[s : max(s, e - 1)]).hexdigest() for s, e in pairwise(ends[0])],
            [hashlib.sha256(decoded[s:e]).hexdigest() for s, e in pairwise(ends[1])],
        ]

    return _mapped(docs, id_col, text_col, vocabulary(docs.sparkSession, path), make, [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")])
