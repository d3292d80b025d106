"""Token ids in binary files, each document compressed alone with a shared zstandard dictionary.

A shard file holds, in ascending id order: MAGIC, the dictionary's SHA-256, a zstandard frame for
each document (its ids as little-endian unsigned 32-bit integers, byte planes apart), then the index
(ids, frame offsets with one more entry, token counts) and a tail (documents, where the index begins,
MAGIC). One document is read by two seeks: index, frame. The dictionary lies beside the shards and
readers refuse another one.

The dictionary is fitted on the ids of `sample` documents (those of the least hash of their id: a
bounded sample); all else covers every document. Encoding splits texts into the tokenizer's own
pre-tokens by class scans, and asks the tokenizers library for each distinct one; words outside
plain Latin text go to the library whole.

Null and empty texts are documents without ids (plus the end id). Null document ids sort first.
Repeated ids keep all their rows. An empty table gives no shard. Files are written under a name of
their own and moved in place, so a task that runs again replaces its file."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm import pieces as p

MAGIC, TAIL, TAIL_SIZE = b"LTOKENS1", "<QQ8s", 24
NULL_ID = -(1 << 63)
DICTIONARY = "dictionary.zdict"


# --- encoding --------------------------------------------------------------------------------


class Words:
    """The tokenizers library on distinct pre-tokens."""

    def __init__(self, text: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; its threads would only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_str(text.decode()), p.Cache()
        b, letters, other, k2, k1, white = range(6)
        step, cut = np.zeros((12, 6), np.uint8), np.ones((12, 6), bool)
        for s in range(6):
            step[0, s], cut[0, s] = other, s != other
            step[1, s], cut[1, s] = {k2: k1, k1: b}.get(s, letters), s not in (letters, k2, k1)
            step[2, s] = b
            step[3, s], cut[3, s] = white, s != white
            for k, run in ((4, k1), (5, k2)):
                step[k, s], cut[k, s] = (other, False) if s == other else (run, True)
        step[6:] = step[:6, :1]
        self.automaton, self.cut = p.Automaton(step), cut

    def _boundaries(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of code points: a piece begins; it is white space; its word goes whole."""
        n = len(points)
        begins = np.zeros(n + 3, bool)
        begins[first] = True
        begins[n:] = True
        padded = np.zeros(n + 2, np.uint32)
        padded[:n] = points
        padded[:n][(points >= 65) & (points <= 90)] += 32
        white = ((points >= 9) & (points <= 13)) | (points == 32)
        symbol = np.array([0, 1, 2, 0, 0, 0], np.uint8)[p.classes()[points]]
        symbol[white] = 3
        at = np.flatnonzero((points == 0x27) & ~begins[1 : n + 1])
        a, b = padded[at + 1], np.where(begins[at + 2], 0, padded[at + 2])
        symbol[at[np.isin(a, [ord(x) for x in "stmd"])]] = 4
        symbol[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = 5
        symbol += begins[:n].astype(np.uint8) * np.uint8(6)
        cut = self.cut[symbol, self.automaton.before(symbol)] | begins[:n]
        odd = (points > 0x24F) | ((points > 0x7E) & (points < 0xA1)) | (points == 0x130)
        odd |= (points == ord("<")) & (padded[1 : n + 1] == ord("|"))
        word = begins[:n] | white
        word[1:] |= white[:-1]
        word = np.cumsum(word) - 1
        whole = (np.bincount(word, odd) > 0)[word] if odd.any() else odd
        head = np.ones(n, bool)
        head[1:] = word[1:] != word[:-1]
        return np.where(whole, head, cut), white, whole

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more entry)."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        points, byte = p.code_points(raw)
        cut, white, whole = self._boundaries(points, np.searchsorted(byte, at[:-1][np.diff(at) > 0]))
        cut = np.flatnonzero(cut)
        begin = np.append(byte[cut], len(raw))
        folded = c._LOWER[raw]
        if whole.any():
            same = np.repeat(whole, np.diff(np.append(byte, len(raw))))
            folded[same] = raw[same]
        kept = ~white[cut]
        hashes, start, end = p.slice_hashes(folded, begin)[kept], begin[:-1][kept], begin[1:][kept]
        data = raw.tobytes()

        def make(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pieces = [str(data[s:e], "utf-8") for s, e in zip(start[i].tolist(), end[i].tolist(), strict=True)]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, int(count.sum())), count

        where, count = self.cache.get(hashes, make)
        before = np.concatenate([[0], np.cumsum(count)])
        return p.runs(self.cache.pool, where, count), before[np.searchsorted(start, at)]


_held: dict[tuple[type, str], Any] = {}


def _once(kind: type, text: bytes) -> Any:
    """One object for each kind and content in a Python worker."""
    key = (kind, hashlib.sha1(text).hexdigest())
    if key not in _held:
        _held[key] = kind(text)
    return _held[key]


class Frames:
    """Compression of ids with a dictionary (empty: none)."""

    def __init__(self, dictionary: bytes) -> None:
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.packer, self.unpacker = zstandard.ZstdCompressor(level=3, **shared), zstandard.ZstdDecompressor(**shared)
        self.hash = hashlib.sha256(dictionary).digest()

    @staticmethod
    def planes(ids: np.ndarray) -> bytes:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()

    def pack(self, ids: np.ndarray) -> bytes:
        return self.packer.compress(self.planes(ids))

    def unpack(self, frame: bytes) -> np.ndarray:
        raw = np.frombuffer(self.unpacker.decompress(frame), np.uint8)
        return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def train(spark: SparkSession, rows: DataFrame, vocabulary: Any, end_id: int, sample: int, size: int) -> bytes:
    """A dictionary of at most size bytes from the ids of sample documents of rows (id, text, h) that
    have an id: those of the least hash."""
    rows = rows.where(F.col("id") != NULL_ID)
    ids = [(r["id"], r["h"]) for r in rows.select("id", "h").orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample).collect()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _once(Words, vocabulary.value)
        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                found, bounds = own.encode(raw[at[s] : at[e]], at[s : e + 1] - at[s])
                blobs = [Frames.planes(np.append(found[x:y], end_id)) for x, y in pairwise(bounds)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s, e - s), pa.array(blobs, pa.binary())], ["id", "blob"])

    wanted = rows.join(F.broadcast(spark.createDataFrame(ids, "id long, h long")), ["id", "h"], "left_semi") if ids else rows.limit(0)
    samples = [bytes(r["blob"]) for r in wanted.mapInArrow(run, "id long, blob binary").orderBy("id", "blob").limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples for the trainer: none
        return b""


# --- files -----------------------------------------------------------------------------------


def _store(at: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(at)
    return store, path


def _put(at: str, name: str, parts: Iterable[bytes]) -> int:
    """Writes a whole file under a name of its own and moves it in place."""
    store, path = _store(at)
    store.create_dir(path, recursive=True)
    own, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
            size += len(x)
    store.move(own, f"{path}/{name}")
    return size


class Shard:
    """Reads a shard file: all of it in order, or one document."""

    def __init__(self, at: str, name: str, frames: Frames) -> None:
        store, path = _store(at)
        self.file, self.frames = store.open_input_file(f"{path}/{name}"), frames
        end = self.file.size()
        n, index, magic = struct.unpack(TAIL, self.file.read_at(TAIL_SIZE, end - TAIL_SIZE))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no token file")
        if head[len(MAGIC) :] != frames.hash:
            raise ValueError(f"{name} needs another dictionary")
        raw = self.file.read_at(index, end - TAIL_SIZE - index)
        self.ids, self.offsets = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(raw, "<u4", n, 16 * n + 8)

    def tokens(self, i: int) -> np.ndarray:
        return self.frames.unpack(self.file.read_at(int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i])))

    def document(self, doc_id: int) -> np.ndarray | None:
        i = bisect_left(self.ids, doc_id)
        return self.tokens(i) if i < len(self.ids) and self.ids[i] == doc_id else None

    def all(self, block: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + block, "right")) - 1)
            raw = self.file.read_at(int(self.offsets[j] - self.offsets[i]), int(self.offsets[i]))
            for k in range(i, j):
                s, e = (int(x - self.offsets[i]) for x in self.offsets[k : k + 2])
                yield k, self.frames.unpack(raw[s:e])
            i = j


def write_tokens(docs: DataFrame, vocabulary_path: str, at: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, sample: int = 2000, dictionary_bytes: int = 64 << 10) -> DataFrame:
    """Writes shard files below `at` (a folder that driver and executors share). Returns the
    manifest, which is written too: shard, name, n_docs, n_tokens, n_bytes."""
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = c.spread(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    dictionary = train(spark, rows, vocabulary, end_id, sample, dictionary_bytes)
    _put(at, DICTIONARY, [dictionary])
    n = shards or c.partitions(spark)
    cuts = np.sort(rows.select("id").approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []).astype(np.int64)
    keys = np.array(c.even_keys(spark, len(cuts) + 1))

    def deal(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Shards by id; rows of an id that fills several are dealt among these by the hash of their text."""
        low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
        step = ((h.view(c.U) >> c.U(32)) * np.maximum(high - low, 1).astype(c.U) >> c.U(32)).astype(np.int64)
        return np.where(high - low > 1, low + 1 + step, high)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frames = _once(Words, vocabulary.value), _once(Frames, dictionary)
        for batch in batches:
            shards_ = deal(batch.column("id").to_numpy(), batch.column("h").to_numpy())
            raw, begin = c.text_of(batch.column("text"))
            for s, e in c.pieces(begin):
                found, bounds = own.encode(raw[begin[s] : begin[e]], begin[s : e + 1] - begin[s])
                blobs = [frames.pack(np.append(found[x:y], end_id)) for x, y in pairwise(bounds)]
                who, h = (batch.column(x).slice(s, e - s) for x in ("id", "h"))
                shard = shards_[s:e]
                yield pa.RecordBatch.from_arrays([pa.array(keys[shard], pa.int32()), pa.array(shard, pa.int32()), who, h, pa.array(np.diff(bounds) + 1), pa.array(blobs, pa.binary())], ["key", "shard", "id", "h", "n", "blob"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held = iter(batches), []

        def parts(shard: int, count: dict) -> Iterator[bytes]:
            yield MAGIC + hashlib.sha256(dictionary).digest()
            where, ids, sizes, tokens = len(MAGIC) + 32, [], [], []
            while True:
                batch = held.pop() if held else next(stream, None)
                if batch is None:
                    break
                own = batch.column("shard").to_numpy()
                end = int(np.searchsorted(own, shard, "right"))
                if end < len(own):
                    held.append(batch.slice(end))
                blobs = batch.column("blob").slice(0, end).to_pylist()
                ids.append(batch.column("id").to_numpy()[:end])
                tokens.append(batch.column("n").to_numpy()[:end])
                sizes.append(np.array([len(x) for x in blobs], np.int64))
                yield b"".join(blobs)
                if held:
                    break
            offsets = where + np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            n = np.concatenate(tokens)
            index = np.concatenate(ids).astype("<i8").tobytes() + offsets.astype("<u8").tobytes() + n.astype("<u4").tobytes()
            count |= {"docs": len(n), "tokens": int(n.sum())}
            yield index + struct.pack(TAIL, len(n), len(index), MAGIC)

        while True:
            if not held:
                batch = next((b for b in stream if b.num_rows), None)
                if batch is None:
                    return
                held.append(batch)
            shard, count = held[0].column("shard")[0].as_py(), {}
            name = f"shard-{shard:06d}.tok"
            size = _put(at, name, parts(shard, count))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (name, pa.string()), (count["docs"], pa.int64()), (count["tokens"], pa.int64()), (size, pa.int64()))], ["shard", "name", "n_docs", "n_tokens", "n_bytes"])

    packed = rows.mapInArrow(pack, "key int, shard int, id long, h long, n long, blob binary")
    dealt = packed.repartition(len(keys), "key").sortWithinPartitions("shard", "id", "h")
    return c.stash(dealt.mapInArrow(write, "shard int, name string, n_docs long, n_tokens long, n_bytes long"), f"{at}/manifest")


def read_tokens(manifest: DataFrame, at: str, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of the shard files: id_col, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), and its ids."""
    spark = manifest.sparkSession
    store, path = _store(at)
    with store.open_input_stream(f"{path}/{DICTIONARY}") as f:
        dictionary = f.read()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _once(Frames, dictionary)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(at, name, frames)
                start = base + np.concatenate([[0], np.cumsum(shard.counts.astype(np.int64))])
                out: list[tuple] = []

                def rows(out: list[tuple], shard: Shard = shard, start: np.ndarray = start) -> pa.RecordBatch:
                    i = np.array([x[0] for x in out])
                    ids = pa.array(shard.ids[i], mask=shard.ids[i] == NULL_ID)
                    more = [pa.array([x[2] for x in out], pa.list_(pa.int32()))] if with_ids else []
                    return pa.RecordBatch.from_arrays([ids, pa.array(start[i]), pa.array(shard.counts[i].astype(np.int64)), pa.array([x[1] for x in out], pa.int64()), *more], [id_col, "start", "n_tokens", "ids_crc32", *["ids"][: len(more)]])

                for i, tokens in shard.all():
                    if len(tokens) != shard.counts[i]:
                        raise ValueError(f"{name}: document {i} doesn't have the tokens of the index")
                    out.append((i, zlib.crc32(tokens.astype("<u4").tobytes()), tokens.astype(np.int32) if with_ids else None))
                    if len(out) >= (500 if with_ids else 5000):
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", "name", before.alias("base"))
    files = files.repartition(c.partitions(spark), "shard")
    return files.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
