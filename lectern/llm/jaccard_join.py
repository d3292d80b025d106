"""N-gram Jaccard join by parity sketches.

A document's set is its distinct k-word shingles (hashed to 64 bits). Two documents link when
den * |A and B| >= num * |A or B|. The join loses no such pair:

* Equal sets (128-bit fingerprint) are one class, found first; only classes give keys and are compared.
* Sizes are cut into bands so that a linked pair lies in one band or in two that are next to
  each other; a pair meets in the band of its smaller set. There the symmetric difference is
  at most d (`Bands.reach`).
* In a band, hash space is cut into more than d parts, and a set's sketch is the XOR (parity)
  of its hashes in each part. Each shingle that only one set has changes one part, so the number
  of parts that differ bounds the symmetric difference from below: at most d parts of a linked
  pair differ, and if either set has over d parts that aren't empty, the two agree on a part that
  isn't empty (pigeonhole). Parts are join keys of 64 bits. A set with at most d such parts also gives
  the keys of its shingle prefix (n - ceil(num * n / den) + 1 shingles, seldom ones first, then by
  hash), as both sets of a pair without a shared part must be of this kind and then share a key of
  that prefix.
* Shingles that many documents share (passages, notices) would make keys that say little. Sketches
  leave them out, which can only lower a symmetric difference, so nothing is lost whichever they
  are. They are the most frequent ones that batches report, marked in a bitmap of fixed size.
* Classes that share a key, linked as stars, are candidate groups (connected components). A group
  that fits in a block is compared exactly in one task. A larger one is split first: its sets get keys
  anew, with another salt and without the shingles that are common in that very group, and pairs
  that no longer share a key part company, for as long as that leaves at most three quarters of a group
  together. What is still large then is compared in blocks of neighbouring bands. Links that join components and the number of links of
  each class are all that leaves a block, never its pairs.

Keys that several classes of an Arrow batch share leave it once, so a key that a third of all rows
share stays small.

Nulls, empty texts and texts without words: empty set, linked with nothing. A row without an id is
linked like any other; its component is the smallest id reachable, null if there is none. A repeated
row is a document of its own, equal to the first; so is a second text of an id. Extra columns are
ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm.common import U

#: Sets of a block in a comparison, and their shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 2_000_000
#: Keys held before they leave a task.
HELD_KEYS = 700_000
#: Shingles left out of sketches: at most so many, each in at least so many documents of a batch; and
#: the bits of their bitmap.
MOST_COMMON, IN_BATCH, MARK_BITS = 200_000, 4, 24
#: Bits of a set's fingerprint that own its keys while candidates are looked for, so that a text needs no number from
#: elsewhere for that. Classes that share them by chance are candidates of each other.
OWNER_BITS = 32
#: Shingles that a large group leaves out of the keys that split it.
GROUP_COMMON = 4096


class Bands:
    """Bands of set sizes, for a similarity of at least num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.low = num, den, [1]
        self.grow(1024)

    def grow(self, size: int) -> None:
        while self.low[-3:][0] <= size or len(self.low) < 4:
            self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * self.den // self.num + 1))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(self.low, sizes, "right") - 1

    def reach(self, band: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a linked pair whose smaller set is in band."""
        low = np.asarray(self.low)
        a = low[band + 1] - 1
        b = np.minimum(a * self.den // self.num, low[band + 2] - 1)
        return (a + b) * (self.den - self.num) // (self.num + self.den)


def mark(hashes: np.ndarray) -> np.ndarray:
    """A bitmap by the high bits of hashes; those that share them are marked too."""
    out = np.zeros(1 << MARK_BITS, bool)
    out[hashes >> U(64 - MARK_BITS)] = True
    return out


def sketch_keys(sets: np.ndarray, begin: np.ndarray, bands: Bands, common: np.ndarray | None = None, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets and the index of each key's set; common: bitmap of shingles to leave out
    of sketches, or rare: which ones stay."""
    keys, owners = [], []
    if rare is None:
        rare = ~common[sets >> U(64 - MARK_BITS)] if common is not None else np.ones(len(sets), bool)
    n = np.diff(begin)
    band = bands.of(np.maximum(n, 1))
    owner = np.repeat(np.arange(len(n)), n)
    for label in (band, band - 1):
        d = np.where((n > 0) & (label >= 0), bands.reach(np.maximum(label, 0)), 0)
        parts = np.where(d > 0, d + 1 + np.maximum(1, d // 16), 0)
        salt = c.mix(label.astype(U) * U(0x8EBC6AF09C88C6E3) + U(1))
        use = rare & (parts[owner] > 0)
        o, h = owner[use], sets[use]
        filled = np.zeros(len(n), np.int64)
        if len(o):
            part = ((h >> U(32)) * parts[o].astype(U) >> U(32)).astype(np.int64)
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            parity = np.bitwise_xor.reduceat(h, first)
            keys.append(c.mix(parity ^ c.mix(salt[o[first]] + part[first].astype(U))))
            owners.append(o[first])
            filled = np.bincount(o[first], minlength=len(n))
        few = (parts > 0) & (filled <= d)
        if few.any():
            prefix = n - -(-bands.num * n // bands.den) + 1
            own = np.flatnonzero(few[owner])
            own = own[np.lexsort((sets[own], ~rare[own], owner[own]))]
            size = n[few]
            rank = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            own = own[rank < prefix[owner[own]]]
            keys.append(c.mix(sets[own] ^ c.mix(salt[owner[own]] + U(0x5851F42D4C957F2D))))
            owners.append(owner[own])
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _once(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal keys (all arrays) only that of the least id stays. Returns the order
    of the rows that stay, and the (id, least id) of those that go."""
    order = np.lexsort((ids, *reversed(keys)))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    first = np.flatnonzero(~same)
    least = np.repeat(ids[order[first]], np.diff([*first, len(order)]))[same] if len(order) else ids
    gone = np.unique(np.stack([ids[order[same]], least], 1), axis=0) if same.any() else np.zeros((0, 2), np.int64)
    return order[first], *gone[gone[:, 0] != gone[:, 1]].T


def fingerprints(sets: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(c.mix(sets + U(salt)))])
    return c.mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(U)).view(np.int64)


def _prints(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (0, id, h, p, q, n) of documents: h as it came, the fingerprint p, q and the size of the set;
    rows (1, -, -, shingle, -, documents) of shingles that several documents of a batch have."""
    names = ["kind", "id", "h", "p", "q", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            held: list[np.ndarray] = []
            for s, e in c.pieces(at):
                sets, begin = c.shingle_sets(raw[at[s] : at[e]], at[s : e + 1] - at[s], k)
                n = np.diff(begin)
                p, q = fingerprints(sets, begin, 11), fingerprints(sets, begin, 29)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(e - s, np.int32)), *(batch.column(x).slice(s, e - s) for x in ("id", "h")), pa.array(p), pa.array(q), pa.array(n)], names)
                held.append(sets)
                if e == len(at) - 1 or sum(map(len, held)) > HELD_KEYS:
                    found, times = np.unique(np.concatenate(held), return_counts=True)
                    use, held = times >= IN_BATCH, []
                    none = pa.nulls(int(use.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(none), np.int32)), none, none, pa.array(found[use].view(np.int64)), none, pa.array(times[use])], names)
        c.tidy()

    return run


def common_shingles(prints: DataFrame) -> np.ndarray:
    """Hashes of at most MOST_COMMON shingles that many documents share."""
    counts = prints.where("kind = 1").groupBy("p").agg(F.sum("n").alias("n"))
    return np.array([r["p"] for r in counts.orderBy(F.desc("n"), "p").limit(MOST_COMMON).collect()], np.int64).view(U)


def _pack(key: np.ndarray, ids: np.ndarray) -> bytes:
    """Keys, and ids by their offset from the least."""
    least = int(ids.min())
    wide = int(ids.max()) - least >= 1 << 32
    return np.array([len(key), least], np.int64).tobytes() + key.tobytes() + (ids - least).astype(np.int64 if wide else np.uint32).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, least = np.frombuffer(blob, np.int64, 2).tolist()
    rest = blob[16 + 8 * n :]
    return np.frombuffer(blob, U, n, 16), np.frombuffer(rest, np.int64 if len(rest) == 8 * n else np.uint32).astype(np.int64) + least


def _deal(keys: list[np.ndarray], owners: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Rows (kind, bucket, blob) of keys (0) by bucket, each once, and of the (node, least node) of those
    that other owners have too (1)."""
    key, own = np.concatenate(keys), np.concatenate(owners)
    if not len(key):
        return None
    keep, a, b = _once([key], own)
    key, own = key[keep], own[keep]  # sorted by key, so buckets (by high bits) are runs
    bucket = ((key >> U(40)) * U(buckets) >> U(24)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
    rows = [(0, int(bucket[s]), _pack(key[s:e], own[s:e])) for s, e in pairwise(cuts)]
    if len(a):
        rows.append((1, int(a[0] % buckets), _pack(a.view(U), b)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "bucket", "blob"])


def _first_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each class of a task: a class's representative is told by its id and text, which
    repeated rows share, and rows without an id. Nodes are numbers, so what is held is small beside the texts."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        own = batch.column("node").to_numpy()
        _, first = np.unique(own, return_index=True)
        first = np.sort(first[~np.isin(own[first], seen)])
        seen = np.union1d(seen, own[first])
        if len(first):
            yield batch if len(first) == len(own) else batch.take(pa.array(first))


def _send(k: int, num: int, den: int, buckets: int, held_common: Any) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of the texts' sets and their owners (see OWNER_BITS); of equal sets of a task, of the first alone."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, common, seen = Bands(num, den), mark(held_common.value), np.zeros(0, np.int64)
        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            keys, owners = [], []
            for s, e in c.pieces(at):
                sets, begin = c.shingle_sets(raw[at[s] : at[e]], at[s : e + 1] - at[s], k)
                prints = fingerprints(sets, begin, 11)
                new = np.zeros(e - s, bool)
                new[np.unique(prints, return_index=True)[1]] = True
                new &= ~np.isin(prints, seen)
                seen = np.union1d(seen, prints[new])
                key, of = sketch_keys(sets, begin, bands, common)
                keys.append(key[new[of]])
                owners.append((prints.view(U) >> U(64 - OWNER_BITS)).astype(np.int64)[of[new[of]]])
                if e == len(at) - 1 or sum(map(len, keys)) > HELD_KEYS:
                    if out := _deal(keys, owners, buckets):
                        yield out
                    keys, owners = [], []
        c.tidy()

    return send


def _send_again(num: int, den: int, buckets: int, turn: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of sets that agree only within a group, without the group's common shingles."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            ids, grps = batch.column("node").to_numpy(), batch.column("grp").to_numpy()
            keys, owners = [], []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("blob")[i].as_py(), U)
                rare = ~np.isin(own, np.array(batch.column("marks")[i].as_py() or [], np.int64).view(U))
                salt = c.mix(grps[i : i + 1].view(U) * U(0xD1342543DE82EF95) + U(turn))
                own = c.mix(own ^ salt)
                order = np.argsort(own)
                own, rare = own[order], rare[order]
                key, at = sketch_keys(own, np.array([0, len(own)]), bands, rare=rare)
                keys.append(c.mix(key ^ salt))
                owners.append(np.full(len(at), ids[i]))
                if i == batch.num_rows - 1 or sum(map(len, keys)) > HELD_KEYS:
                    if out := _deal(keys, owners, buckets):
                        yield out
                    keys, owners = [], []
        c.tidy()

    return send


def _usual(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of several sets of a group in a batch, and of how many."""
    for batch in batches:
        grps, blobs = batch.column("grp").to_numpy(), batch.column("blob").to_pylist()
        for g in np.unique(grps):
            held: list[np.ndarray] = []
            mine = np.flatnonzero(grps == g)
            for i in mine:
                held.append(np.frombuffer(blobs[i], U))
                if i == mine[-1] or sum(map(len, held)) > HELD_KEYS:
                    found, n = np.unique(np.concatenate(held), return_counts=True)
                    found, n, held = found[n > 1], n[n > 1], []
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g)), pa.array(found.view(np.int64)), pa.array(n)], ["grp", "h", "n"])
    c.tidy()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of the nodes that share a key of a bucket, each once."""
    for _, table in c.groups(batches, "bucket"):
        kinds, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
        found = []
        if (kinds == 0).any():
            parts = [_unpack(blobs[i]) for i in np.flatnonzero(kinds == 0)]
            _, a, b = _once([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]))
            found.append(np.stack([a, b]))
        for i in np.flatnonzero(kinds == 1):
            a, b = _unpack(blobs[i])
            found.append(np.stack([a.view(np.int64), b]))
        stars = np.concatenate(found, 1)
        stars = stars[:, np.lexsort(stars)]
        stars = stars[:, np.append(True, (stars[:, 1:] != stars[:, :-1]).any(0))[: stars.shape[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(stars[0]), pa.array(stars[1])], ["a", "b"])
    c.tidy()


def _sets(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "grp", "copies", "n"]
        for batch in _first_rows(batches):
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                sets, begin = c.shingle_sets(raw[at[s] : at[e]], at[s : e + 1] - at[s], k)
                blob = pa.array([sets[x:y].tobytes() for x, y in pairwise(begin)], pa.binary())
                rest = batch.slice(s, e - s)
                own = pa.array(fingerprints(sets, begin, 11) == rest.column("p").to_numpy())
                yield pa.RecordBatch.from_arrays([*(rest.column(x) for x in names), blob], [*names, "blob"]).filter(own)
        c.tidy()

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Which sets (sorted hashes) of left link with which of right, or with which of left."""
    both = left + (right or [])
    n = np.array([len(x) for x in both])
    m = len(left)
    if len(both) * m <= 64:
        inter = np.zeros((len(both), len(both)))
        for i in range(m):
            for j in range(m if right is not None else i + 1, len(both)):
                if den * min(n[i], n[j]) >= num * max(n[i], n[j]):
                    inter[i, j] = len(np.intersect1d(both[i], both[j], assume_unique=True))
        inter = inter if right is not None else inter + inter.T
    else:
        row = np.repeat(np.arange(len(both)), n)
        _, col, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
        use = count[col] > 1
        row, col = row[use], np.cumsum(count > 1)[col[use]] - 1
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        inter = np.zeros((len(both), len(both)), np.float64)
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            s, e = np.searchsorted(col, [at, at + 4096])
            x = np.zeros((len(both), 4096), np.float32)
            x[row[s:e], col[s:e] - at] = 1
            inter[:m] += x[:m] @ x.T
    cols = slice(m, None) if right is not None else slice(0, m)
    out = den * inter[:m, cols] >= num * (n[:m, None] + n[None, cols] - inter[:m, cols])
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _compare(num: int, den: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in c.groups(batches, "task"):
            _, once = np.unique(t.column("node").to_numpy(), return_index=True)  # a repeated row gives its class again
            t = t.take(once)
            ids, side, copies = (t.column(x).to_numpy() for x in ("node", "side", "copies"))
            sets = [np.frombuffer(x, U) for x in t.column("blob").to_pylist()]
            one = np.flatnonzero(side != 2)
            two = np.flatnonzero(side == 2)
            if not len(one) or len(two) == 0 and side[0] != 0:
                continue
            link = linked([sets[i] for i in one], [sets[i] for i in two] if len(two) else None, num, den)
            far, label, degree = two if len(two) else one, np.arange(len(ids)), np.zeros(len(ids), np.int64)
            a, b = np.nonzero(link)
            label = c.labels(label, one[a], far[b])
            degree[one] += link @ copies[far]
            if len(two):
                degree[two] += copies[one] @ link
            joined, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(degree)
            a, b = np.concatenate([ids[joined], ids[some]]), np.concatenate([ids[label[joined]], degree[some]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.repeat([0, 1], [len(joined), len(some)]).astype(np.int32))], ["a", "b", "kind"])
        c.tidy()

    return run


def _groups(sent: DataFrame, n: int) -> DataFrame:
    """Candidate groups of dealt keys: (node, grp), grp being the least node."""
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: c.contract(_meet(batches)), "a long, b long")
    found = c.components(met, contracted=True)
    return c.stash(found.select(F.col("a").alias("node"), F.col("b").alias("grp")).union(found.select("b", "b").distinct()))


def _split(sets: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Sets (node, grp, copies, n, blob) whose groups of more than `most` sets are split by keys of their
    own, again and again as long as that leaves at most three quarters of a group together; a set
    that shares no key with another leaves."""
    n, done, turn = c.partitions(sets.sparkSession), [], 0
    sets = sets.withColumn("above", F.lit(None).cast("long"))  # size of the group that a group was split from
    while True:
        sizes = sets.groupBy("grp").agg(F.count("*").alias("m"), F.min("above").alias("above")).where(F.col("m") > most)
        sizes = c.stash(sizes.where("above is null or 4 * m <= 3 * above").select("grp", "m"))
        n_large = sizes.count()
        done.append(c.join_small(sets, sizes.select("grp"), "grp", "left_anti", n_large).drop("above"))
        if not n_large:
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out
        large = c.stash(c.join_small(sets.drop("above"), sizes.select("grp", F.col("m").alias("above")), "grp", "inner", n_large))
        usual = large.select("grp", "blob").mapInArrow(_usual, "grp long, h long, n long").groupBy("grp", "h").agg(F.sum("n").alias("n"))
        usual = c.join_small(usual, sizes, "grp", "inner", n_large).where("50 * n >= m")
        usual = usual.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "h"))).where(F.col("r") <= GROUP_COMMON)
        marks = c.stash(usual.groupBy("grp").agg(F.collect_list("h").alias("marks")))
        keyed = c.join_small(large.select("node", "grp", "blob"), marks, "grp", "left", n_large, 8 * GROUP_COMMON)
        groups = _groups(keyed.mapInArrow(_send_again(num, den, 4 * n, turn := turn + 1), "kind int, bucket int, blob binary"), n)
        sets = c.stash(c.join_small(large.drop("grp"), groups, "node", "inner", groups.count()))


def _tasks(sets: DataFrame, bands: Bands) -> DataFrame:
    """Sets as often as they are compared: a group that fits in one block is one task, a larger one is
    cut by band and block, each block meeting those of its band and the next."""
    low = [x for x in bands.low if x > 1]
    band = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in low)), lambda x: x <= F.col("n")))
    sizes = c.stash(sets.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where(f"m > {BLOCK_SETS} or s > {BLOCK_SHINGLES}").select("grp"))
    n_large = sizes.count()
    held = sets.withColumn("band", band)
    blocks = c.join_small(held.select("grp", "band", "n"), sizes, "grp", "left_semi", n_large).groupBy("grp", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("m"))
    by_band = W.partitionBy("grp").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(by_band) == F.col("band") + step, f("m").over(by_band)).otherwise(0)
    blocks = c.stash(blocks.withColumn("up", beside(F.lead, 1)).withColumn("down", beside(F.lag, -1)))
    held = c.join_small(held, blocks, ["grp", "band"], "left", blocks.count())
    held = held.withColumn("band", F.when(F.col("m").isNull(), F.lit(-5)).otherwise(F.col("band"))).fillna({"m": 1, "up": 0, "down": 0})
    held = held.withColumn("block", F.pmod(F.xxhash64("node"), "m").cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    col, block = F.col, F.col("block")
    row = lambda side, low, high, i, j: F.struct(F.lit(side).alias("side"), low.cast("int").alias("low"), high.cast("int").alias("high"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    tasks = F.concat(
        F.array(row(0, col("band"), col("band"), block, block)),
        F.transform(F.filter(upto(col("m")), lambda j: j > block), lambda j: row(1, col("band"), col("band"), block, j)),
        F.transform(F.filter(upto(col("m")), lambda j: j < block), lambda j: row(2, col("band"), col("band"), j, block)),
        F.transform(upto(col("up")), lambda j: row(1, col("band"), col("band") + 1, block, j)),
        F.transform(upto(col("down")), lambda j: row(2, col("band") - 1, col("band"), j, block)),
    )
    dealt = held.select("node", "copies", "blob", "grp", F.explode(tasks).alias("t"))
    return dealt.select("node", "copies", "blob", col("t.side").alias("side"), F.concat_ws(",", "grp", "t.low", "t.high", "t.i", "t.j").alias("task"))


def _each_once(sets: DataFrame) -> DataFrame:
    """Sets (a table) with one row of each node. Only nodes that came from several tasks are dealt again."""
    twice = c.stash(sets.groupBy("node").count().where("count > 1").select("node"))
    n = twice.count()
    if not n:
        return sets
    once = c.join_small(sets, twice, "node", "left_semi", n).dropDuplicates(["node"])
    return c.join_small(sets, twice, "node", "left_anti", n).unionByName(once)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, split_above: int = 2048) -> DataFrame:
    """A row for each document: id_col, n_shingles, component_id (the smallest id reachable by
    links, itself included), n_links (other documents linked directly). Candidate groups of more than
    split_above classes are split again before they are compared."""
    spark = docs.sparkSession
    n = c.partitions(spark)
    own_id = F.col(id_col).cast("long")
    rows = c.spread(docs).select(own_id.alias("id"), F.xxhash64(own_id, text_col).alias("h"), F.col(text_col).alias("text"))
    prints = c.stash(rows.mapInArrow(_prints(k), "kind int, id long, h long, p long, q long, n long"))
    with_words = prints.where("kind = 0 and n > 0").select("id", "p", "q", "n")

    # Classes of equal sets, each with a number of its own and one of its documents.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    classes = prints.where("kind = 0 and n > 0").groupBy("p", "q").agg(F.min("n").alias("n"), F.count("*").alias("copies"), first)
    at = F.monotonically_increasing_id()
    node = F.shiftrightunsigned(at, 33) + at.bitwiseAND((1 << 33) - 1) * n
    classes = c.stash(classes.select(node.alias("node"), F.shiftrightunsigned("p", 64 - OWNER_BITS).alias("owner"), "p", "q", "n", "copies", F.col("first.id").alias("low"), F.col("first.h").alias("h")))
    n_classes = classes.count()
    # Texts come by the hash of id and text; what shares it by chance has another fingerprint. Of texts that no class
    # or no group needs none is shuffled.
    held_common = spark.sparkContext.broadcast(common_shingles(prints))
    first_texts = rows.select("h", "text")
    if n_classes * 64 <= c.BROADCAST_BYTES:
        first_texts = c.join_small(first_texts, classes.select("h"), "h", "left_semi", n_classes)
    else:
        first_texts = c.marked(first_texts, classes, "h", n_classes).where("may__")
    sent = first_texts.select("text").mapInArrow(_send(k, num, den, 4 * n, held_common), "kind int, bucket int, blob binary")
    groups = _groups(sent, n).withColumnRenamed("node", "owner")
    twins = c.stash(classes.groupBy("owner").count().where("count > 1").select("owner"))
    groups = groups.unionByName(c.join_small(twins, groups, "owner", "left_anti", groups.count()).select("owner", F.col("owner").alias("grp")))
    n_groups = groups.count()
    some = c.stash(c.join_small(classes.select("node", "owner", "copies", "n", "p", "h"), groups, "owner", "inner", n_groups).drop("owner"))
    sets = c.join_marked(rows.drop("id"), some, "h", "inner", n_groups).select("node", "grp", "copies", "n", "p", "text").mapInArrow(_sets(k), "node long, grp long, copies long, n long, blob binary")
    bands = Bands(num, den)
    bands.grow(1 << 40)
    tasks = _tasks(_split(_each_once(c.stash(sets)), num, den, split_above), bands)
    found = c.stash(tasks.repartition(n, "task").sortWithinPartitions("task", "node").mapInArrow(_compare(num, den), "a long, b long, kind int"))
    links = c.components(found.where("kind = 0").select("a", "b"))

    n_links = links.count()
    degrees = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    of_class = c.join_small(classes.select("node", "p", "q", "copies", "low"), links.select(F.col("a").alias("node"), F.col("b").alias("top")), "node", "left", n_links)
    of_class = c.stash(c.join_small(of_class, degrees, "node", "left", n_groups).withColumn("top", F.coalesce("top", "node")))
    tops = c.stash(of_class.where("others is not null").groupBy("top").agg(F.min("low").alias("component"), F.count("*").alias("members")))
    of_class = c.join_counted(of_class, tops, ["top"], "members", n_groups).select("p", "q", "copies", F.coalesce("component", "low").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = c.join_counted(with_words, c.stash(of_class), ["p", "q"], "copies", n_classes).select("id", "n", "component", "n_links")
    empty = prints.where("kind = 0 and n = 0").select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("n_links").cast("long").alias("n_links"))
