"""What the operators of this subpackage share: the cluster's shared folder, streaming of
grouped Arrow rows, vectorised words and hashes of UTF-8 text, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.tables import shared_dir, spread, written

U = np.uint64
#: Separators of words: space and tab to carriage return.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: Text bytes that are worked on at once; a longer text makes a longer piece.
PIECE_BYTES = 1_000_000


# --- the shared folder and joins ------------------------------------------------------------


#: Writes a table in the shared folder and reads it: cuts lineage, survives the loss of executors.
stash = written


#: Bytes of a table that may be broadcast, and rows of a key that one task may take in a join.
BROADCAST_BYTES, HOT_ROWS = 32 << 20, 100_000


def join_small(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str, rows: int, row_bytes: int = 64) -> DataFrame:
    """Joins; broadcasts right only when its counted rows fit in BROADCAST_BYTES."""
    return left.join(F.broadcast(right) if rows * row_bytes <= BROADCAST_BYTES else right, on, how)


#: Bits of a table of marks for each key, and at most (as many bytes as may be broadcast).
MARKS, MOST_MARKS = 16, 8 * BROADCAST_BYTES


def marked(rows: DataFrame, keys: DataFrame, on: str, n: int) -> DataFrame:
    """Rows with may__: whether their `on` (never null) may be among n keys. It is true for all that are and for few
    others: bits of the keys' hashes are broadcast, of a bounded size, and no row is shuffled to be told."""
    bits = min(MOST_MARKS, 1 << max(15, (MARKS * n).bit_length()))
    at = F.pmod(F.xxhash64(on), F.lit(bits).cast("long"))
    table = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part__")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits__"))
    found = rows.withColumn("at__", at).withColumn("part__", F.shiftright("at__", 15)).join(F.broadcast(table), "part__", "left")
    byte = F.conv(F.hex(F.expr("substring(bits__, int(shiftright(at__ & 32767, 3)) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("at__").bitwiseAND(7).cast("int")).bitwiseAND(1)
    return found.withColumn("may__", F.coalesce(bit == 1, F.lit(False))).select(*rows.columns, "may__")


def join_marked(left: DataFrame, right: DataFrame, on: str, how: str, rows: int) -> DataFrame:
    """Joins (inner, left_semi or left_anti) on a key that is never null. Where right is too large to be broadcast, only those rows
    of left are shuffled that may meet it."""
    if rows * 64 <= BROADCAST_BYTES:
        return join_small(left, right, on, how, rows)
    told = marked(left, right, on, rows)
    some = told.where("may__").drop("may__").join(right.hint("merge"), on, how)
    return some.unionByName(told.where("not may__").drop("may__")) if how == "left_anti" else some


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int) -> DataFrame:
    """Left with the columns of right, which has one row for each key (never null) and counts the rows
    of left that meet it. Keys with more than HOT_ROWS rows, of which left / HOT_ROWS exist at most, are
    broadcast, so that no key of any size is shuffled to one task; left is read twice for it."""
    if rows * 64 <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(count)), on, "left")
    hot = right.where(F.col(count) > HOT_ROWS).drop(count)
    cold = right.where(F.col(count) <= HOT_ROWS).drop(count)
    cool = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, "left")
    return left.join(F.broadcast(hot), on).unionByName(cool)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow rows ---------------------------------------------------------------------------


def text_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins (one more entry than
    texts). Null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts (first, end) of about most bytes together."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal keys of sorted batches, one at a time."""
    held: list[pa.RecordBatch] = []
    last: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and keys[s] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield last, pa.Table.from_batches(held)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the machine; at the end of a task, as
    workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- words and hashes ----------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        found = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, U)
            x[0] = 1
            found.append(np.multiply.accumulate(x))
        if n > 4 * PIECE_BYTES:  # for a very long text; not kept
            return found[0], found[1]
        _powers[:] = found
    return _powers[0][:n], _powers[1][:n]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one array: 64-bit hash of each lower-cased (A-Z) word, the index of its
    text, and the words before each text (one more entry than texts)."""
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_IS_SEP[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE_VALUES[_LOWER[raw]] * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))
    before = np.searchsorted(start, at)
    return hashes, np.repeat(np.arange(len(at) - 1), np.diff(before)), before


def fold(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k entries."""
    out = hashes[: len(hashes) - k + 1].copy()
    for j in range(1, k):
        out = mix(out * U(0xE7037ED1A0B428DB) + hashes[j : len(hashes) - k + 1 + j])
    return mix(out + U(k))


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, and where each text's
    begin. A text of fewer words has its whole sequence as its one shingle; without words,
    none."""
    hashes, _, before = words(raw, at)
    counts = np.diff(before)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(int(sizes.sum()), U)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    long = np.flatnonzero(counts >= k)
    if len(long):
        runs = fold(hashes, k)
        size = sizes[long]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin[long], size) + within] = runs[np.repeat(before[long], size) + within]
    for m in range(1, k):
        few = np.flatnonzero(counts == m)
        if len(few):
            out[begin[few]] = fold(hashes, m)[before[few]]
    for s, e in zip(begin[long], begin[long + 1], strict=True):
        out[s:e].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[begin]


# --- connected components -------------------------------------------------------------------


class Union:
    """Union-find over any integers; the root is the smallest of a component."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each node, once edges (a, b) join components with the given labels."""
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            return new
        label = new


#: Nodes of one local union-find; so many edges or fewer are one task's work.
LOCAL_NODES = 500_000


def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task as stars of their smallest node: fewer, same components.
    What a task holds is bounded by LOCAL_NODES."""
    u = Union()

    def out() -> pa.RecordBatch:
        a = np.fromiter(u.up, np.int64, len(u.up))
        b = np.fromiter(map(u.find, list(u.up)), np.int64, len(u.up))
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            u.join(a, b)
        if len(u.up) > LOCAL_NODES:
            yield out()
            u = Union()
    yield out()


def components(edges: DataFrame, contracted: bool = False, rounds: int = 60) -> DataFrame:
    """Components of the graph with the given edges (a, b): a row (a, b) for each node but
    the smallest of its component, b being that smallest node.

    Edges are contracted within each task (unless they are already), then large-star and small-star alternate until
    nothing changes; each round's edges are a table in the shared folder. As soon as the edges
    that are left are few enough (LOCAL_NODES), one task contracts them all and ends this."""
    if not contracted:
        edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInArrow(contract, "a long, b long")
    mark = [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")]
    now, was = stash(edges), None
    if now.count() > LOCAL_NODES:  # tasks repeat each other's links
        now = stash(now.distinct())
    for _ in range(rounds):
        seen = now.agg(*mark).first()
        if not seen["n"] or was == seen:
            return now
        if seen["n"] <= LOCAL_NODES:
            return stash(now.coalesce(1).mapInArrow(contract, "a long, b long"))
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        large = stash(join_counted(both, low, ["a"], "k", 2 * seen["n"]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = join_counted(large, low, ["a"], "k", seen["n"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).mapInArrow(contract, "a long, b long")
        now, was = stash(small.distinct()), seen
    raise RuntimeError("components did not settle")


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions, a value that a hash repartition to n sends there."""
    found: dict[int, int] = {}
    size = 8 * n + 64
    while len(found) < n:
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found |= {r["at"]: r["low"] for r in spark.range(size).groupBy(at.alias("at")).agg(F.min(F.col("id").cast("int")).alias("low")).collect()}
        size *= 2
    return [found[i] for i in range(n)]
