"""Scores of texts under a hashed maximum-entropy language model.

The softmax over words is factored by classes: the words that are counted most often lie in order of
frequency and are cut into classes of equal shares of the training tokens, those into classes of their
own, and so on until each class is a word (`Tree`). At each step the history chooses among at most 8
classes by a softmax over a prior (their shares) and the weights of its features: the word before, the
word before the last (a skip) and, in the first PAIR_STEPS steps, the two words before, each hashed
together with the step's node. (Further down a pair of words is met too seldom to say more than its words.)
P(word | history) is the product of its steps, so that history chooses words, not classes alone.
All words outside the `top` most frequent ones and unseen words are one class of the first step; within
it words have their relative frequency, and unseen words together have the share of words seen once
(Good-Turing), as one event.

Training: each task walks its training documents once, with AdaGrad steps on batches, and
each row of weights is averaged by the events that touched it in each task (iterative parameter
mixing), `rounds` times. Counts of words cover all training documents; they are summed by batch,
dealt by hash and stay distributed: scoring sends each document's words outside the top to the bucket
that counts them, and gets sums back. Only `top` words and the weights are broadcast. The weights have
about a row for each counted word, up to 2**most_bits rows: beyond that features collide more.

Null and empty texts are the end token alone. A null id counts as training (its hash is null). Ids
may repeat: rows are scored each by itself. An empty table gives an empty result; without training
documents every score comes from the single unseen event. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm.common import U

END, START = U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)
#: Classes of a step, and tokens of a batch that is scored at once.
WAYS, BATCH = 8, 16_384
#: Words seen less often are never among the most frequent: they stand for words to come.
SELDOM = 5


class Table:
    """Index of each of the given keys; -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.keys = U(64 - bits), np.zeros((1 << bits) + 256, U)
        self.index = np.full(len(self.keys), -1, np.int64)
        todo, n = np.arange(len(keys)), 0
        while len(todo):
            at = (keys[todo] * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64) + n
            free = self.index[at] < 0
            self.index[at[free]] = todo[free]  # of several, one stays
            self.keys[at[free]] = keys[self.index[at[free]]]
            todo = todo[self.index[at] != todo]
            n += 1
        self.reach = n

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        at = (keys * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        for n in range(self.reach):
            spot = at[todo] + n
            hit = self.keys[spot] == keys[todo]
            full = self.index[spot] >= 0
            out[todo[hit & full]] = self.index[spot[hit & full]]
            todo = todo[~hit & full]
            if not len(todo):
                break
        return out


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end token last, and where they begin."""
    hashes, owner, before = c.words(raw, at)
    begin = before + np.arange(len(at))
    out = np.full(int(begin[-1]), END, U)
    out[np.arange(len(hashes)) + owner] = hashes
    return out, begin


def features(t: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each token's history."""
    one = np.empty_like(t)
    two = np.empty_like(t)
    one[1:], two[2:] = t[:-1], t[:-2]
    full = begin[:-1][np.diff(begin) > 0]
    one[full] = START
    two[full] = START
    second = full + 1
    second = second[second < len(t)]
    two[second] = START
    return [c.mix(one + U(1)), c.mix(one * U(0xE7037ED1A0B428DB) + two), c.mix(two + U(3))]


class Tree:
    """Words (counts, most frequent first) as leaves of steps among at most WAYS classes; the entry after
    the last word is the class of all others, `rare` tokens. nodes and children: of each step (rows) the
    node and the choice of each word, -1 where its path has ended. prior: log share of each choice."""

    def __init__(self, counts: np.ndarray, rare: float) -> None:
        n = len(counts)
        sums = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
        nodes, children, prior = [], [], []
        todo, made = [(0, 0, n)], 1
        while todo:
            at, to = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int8)
            below = []
            for node, s, e in todo:
                ways = min(WAYS - (node == 0), e - s)
                want = np.searchsorted(sums, sums[s] + (sums[e] - sums[s]) * np.arange(1, ways) / max(1, ways))
                cuts = [s]
                for j, w in enumerate(want.tolist(), 1):
                    cuts.append(min(max(w, cuts[-1] + 1), e - ways + j))
                cuts.append(e)
                shares = np.zeros(WAYS)
                at[s:e] = node
                for j, (x, y) in enumerate(pairwise(cuts)):
                    to[x:y] = j
                    shares[j] = sums[y] - sums[x]
                    if y - x > 1:
                        below.append((made, x, y))
                        made += 1
                if node == 0:
                    at[n], to[n], shares[-1] = 0, WAYS - 1, rare + 1
                prior.append(np.where(shares > 0, np.log(np.maximum(shares, 1e-300) / shares.sum()), -1e4))
            nodes.append(at)
            children.append(to)
            todo = below
        self.nodes, self.children, self.prior = np.stack(nodes), np.stack(children), np.stack(prior).astype(np.float32)

    def steps(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each step: which of the words take it, at which nodes, and their choices."""
        own = np.arange(len(words))
        for at, to in zip(self.nodes, self.children, strict=True):
            node = at[words[own]]
            if (node < 0).any():
                own, node = own[node >= 0], node[node >= 0]
            if not len(own):
                return
            yield own, node, to[words[own]].astype(np.int64)


#: Steps from the root on that look at the two words before.
PAIR_STEPS = 2


def step_features(f: list[np.ndarray], k: int) -> list[np.ndarray]:
    return f if k < PAIR_STEPS else [f[0], f[2]]


def rows_of(f: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Rows of weights of a feature at nodes."""
    return ((f + node.astype(U) * U(0x9FB21C651E98DF25)) * U(0xD6E8FEB86659FD93) >> U(64 - bits)).astype(np.int64)


_ONES = np.ones(WAYS, np.float32)


def step_logits(tree: Tree, w: np.ndarray, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    x = tree.prior.take(node, 0)
    for r in rows:
        x += w.take(r, 0)
    return x


def word_logs(tree: Tree, w: np.ndarray, f: list[np.ndarray], words: np.ndarray, bits: int) -> np.ndarray:
    """Natural logarithms of P(word | history)."""
    out = np.zeros(len(words))
    for k, (own, node, choice) in enumerate(tree.steps(words)):
        x = step_logits(tree, w, node, [rows_of(h[own], node, bits) for h in step_features(f, k)])
        out[own] += x[np.arange(len(own)), choice] - np.log(np.exp(x) @ _ONES)
    return out


class Learner:
    """AdaGrad on batches of at most `most` tokens."""

    def __init__(self, tree: Tree, w: np.ndarray, bits: int, rate: float, most: int) -> None:
        self.tree, self.w, self.bits, self.rate = tree, w, bits, np.float32(rate)
        self.g2, self.touched = np.zeros_like(w), np.zeros(len(w), np.int64)
        size = most * len(tree.nodes) * 3 * WAYS
        self.cells, self.slopes = np.empty(size, np.int64), np.empty(size)

    def step(self, f: list[np.ndarray], words: np.ndarray) -> None:
        at, used = 0, []
        for k, (own, node, choice) in enumerate(self.tree.steps(words)):
            rows = [rows_of(h[own], node, self.bits) for h in step_features(f, k)]
            p = np.exp(step_logits(self.tree, self.w, node, rows))
            p /= (p @ _ONES)[:, None]
            p[np.arange(len(own)), choice] -= 1
            for r in rows:
                end = at + p.size
                np.add((r * WAYS)[:, None], np.arange(WAYS), out=self.cells[at:end].reshape(-1, WAYS))
                self.slopes[at:end] = p.reshape(-1)
                at = end
            used += rows
        g = np.bincount(self.cells[:at], self.slopes[:at], self.w.size).astype(np.float32).reshape(self.w.shape)
        self.touched += np.bincount(np.concatenate(used), minlength=len(self.w))
        self.g2 += g * g
        g *= self.rate
        g /= np.sqrt(self.g2 + np.float32(1e-8))
        self.w -= g


@dataclass
class Model:
    vocabulary: DataFrame  # bucket, keys, counts: all words of the training documents
    buckets: int
    n: int  # tokens
    v: int  # distinct tokens
    rare: float  # tokens outside the top
    unseen: float  # share of unseen words in the last class
    top: Any  # broadcast: keys, counts, tree
    weights: Any  # broadcast: float32, a row for each feature at a node
    bits: int


def _count(buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            keys, back = np.unique(keys, return_inverse=True)
            return keys, np.bincount(back, n, len(keys)).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = total()  # sorted, so buckets (by high bits) are runs
            b = (keys >> U(40)) * U(buckets) >> U(24)
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)]
            blobs = [keys[s:e].tobytes() + n[s:e].astype(np.int64).tobytes() for s, e in pairwise(cuts) if e > s]
            return pa.RecordBatch.from_arrays([pa.array(b[[s for s, e in pairwise(cuts) if e > s]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                held.append(np.unique(tokens(raw[at[s] : at[e]], at[s : e + 1] - at[s])[0], return_counts=True))
                if sum(len(x) for x, _ in held) > 1_200_000:
                    held = [total()]
                    if len(held[0][0]) > 900_000:
                        yield out()
                        held = []
        if held:
            yield out()

    return run


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, t in c.groups(batches, "bucket"):
        parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in t.column("blob").to_pylist()]
        x = np.concatenate(parts, 1)
        keys, back = np.unique(x[0].view(U), return_inverse=True)
        n = np.bincount(back, x[1], len(keys)).astype(np.int64)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((bucket, keys.tobytes(), n.tobytes(), len(keys), int(n.sum()), int((n == 1).sum())), kinds, strict=True)], ["bucket", "keys", "counts", "types", "tokens", "once"])


def _frequent(least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, n = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n >= least]), pa.array(n[n >= least])], ["key", "n"])

    return run


def _learn(top: Any, start: Any, bits: int, rate: float, blocks: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    step = max(2048, (1 << bits) // 8)  # tokens of a step: one costs as much as its tokens and the whole table

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, tree = top.value
        table, learner = Table(keys), Learner(tree, start.value.copy(), bits, rate, step)
        held: list[tuple[np.ndarray, ...]] = []  # features and words of tokens that wait for a step

        def walk(least: int) -> None:
            if sum(len(x[-1]) for x in held) < least:
                return
            *f, x = (np.concatenate(parts) for parts in zip(*held, strict=True))
            end = len(x) // least * least
            for k in range(0, end, step):
                learner.step([h[k : k + step] for h in f], x[k : k + step])
            held[:] = [(*(h[end:] for h in f), x[end:])]

        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                t, begin = tokens(raw[at[s] : at[e]], at[s : e + 1] - at[s])
                held.append((*features(t, begin), table.find(t)))
                walk(step)
        walk(1)
        # Only the rows that this task has touched.
        touched, w = learner.touched, learner.w
        rows = np.flatnonzero(touched).astype(np.int32)
        block = rows % blocks
        found = [rows[block == b] for b in range(blocks)]
        used = [b for b in range(blocks) if len(found[b])]
        if used:
            yield _block(used, [(found[b], touched[found[b]], w[found[b]]) for b in used])
        c.tidy()

    return run


def _block(blocks: list[int], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([x[k].tobytes() for x in parts], pa.binary()) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *columns], ["block", "rows", "n", "blob"])


def _average(ways: int = WAYS) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row of weights, by the events that touched it in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in c.groups(batches, "block"):
            rows, n, x = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, ways))
            for r, k, blob in zip(*(t.column(x).to_pylist() for x in ("rows", "n", "blob")), strict=True):
                own = np.frombuffer(r, np.int32)
                every = np.union1d(rows, own)
                m, sums = np.zeros(len(every), np.int64), np.zeros((len(every), ways))
                at, here = np.searchsorted(every, rows), np.searchsorted(every, own)
                m[at], sums[at] = n, x
                count = np.frombuffer(k, np.int64)
                m[here] += count
                sums[here] += np.frombuffer(blob, np.float32).reshape(-1, ways).astype(np.float64) * count[:, None]
                rows, n, x = every, m, sums
            yield _block([block], [(rows, n, (x / n[:, None]).astype(np.float32))])

    return run


def train(docs: DataFrame, text_col: str = "text", top: int = 131_072, feature_bits: int = 15, rounds: int = 2, rate: float = 0.15, most_bits: int = 18) -> Model:
    """Learns from all of docs. The table of features has a row for each counted word, but
    2**feature_bits at least and 2**most_bits at most."""
    spark = docs.sparkSession
    n = c.partitions(spark)
    rows, buckets = c.spread(docs).select(F.col(text_col).alias("text")), 4 * n
    counted = rows.mapInArrow(_count(buckets), "bucket int, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    vocabulary = c.stash(counted.mapInArrow(_gather, "bucket int, keys binary, counts binary, types long, tokens long, once long"))
    v, total, once = vocabulary.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    # Fewer than 1 / share words have that share of all tokens, whatever the input.
    least = max(SELDOM, total // (40 * top))
    found = vocabulary.select("keys", "counts").mapInArrow(_frequent(least), "key long, n long").orderBy(F.desc("n"), "key").limit(top).collect()
    keys, counts = np.array([r["key"] for r in found], np.int64).view(U), np.array([r["n"] for r in found], np.int64)
    rare = float(total - counts.sum())
    unseen = min(0.9, max(once / rare, 1e-4)) if rare else 1.0
    held = spark.sparkContext.broadcast((keys, counts, Tree(counts, rare)))
    feature_bits = max(feature_bits, min(most_bits, int(v - 1).bit_length() if v else 0))
    weights = np.zeros((1 << feature_bits, WAYS), np.float32)
    blocks = 16
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        schema = "block int, rows binary, n binary, blob binary"
        learned = rows.mapInArrow(_learn(held, start, feature_bits, rate, blocks), schema).withColumn("order", F.xxhash64("rows", "blob"))
        summed = c.stash(learned.repartition(min(n, blocks), "block").sortWithinPartitions("block", "order").drop("order").mapInArrow(_average(), schema))
        weights = weights.copy()
        for r in summed.collect():  # rows that no token touches stay as they are
            weights[np.frombuffer(r["rows"], np.int32)] = np.frombuffer(r["blob"], np.float32).reshape(-1, WAYS)
    return Model(vocabulary, buckets, total, v, rare, unseen, held, spark.sparkContext.broadcast(weights), feature_bits)


def _score(m: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    top, weights, bits, buckets = m.top, m.weights, m.bits, m.buckets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, tree = top.value
        w, table, plain = weights.value, Table(keys), np.append(np.log10(counts + 1.0), 0.0)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names = ["kind", "bucket", "row", "id", "held_out", "n_tokens", "n_known", "base", "score", "blob"]
        for batch in batches:
            ids, held_out = batch.column("id"), batch.column("held_out")
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                t, begin = tokens(raw[at[s] : at[e]], at[s : e + 1] - at[s])
                f, i, score = features(t, begin), table.find(t), np.empty(len(t))
                for k in range(0, len(t), BATCH):
                    score[k : k + BATCH] = word_logs(tree, w, [h[k : k + BATCH] for h in f], i[k : k + BATCH], bits) / np.log(10)
                m_ = e - s
                first = begin[:-1]
                columns = [np.zeros(m_, np.int32), np.full(m_, -1, np.int32), row + np.arange(m_), ids.slice(s, m_), held_out.slice(s, m_), np.diff(begin), np.add.reduceat((i >= 0).astype(np.int64), first), np.add.reduceat(plain[i], first), np.add.reduceat(score, first), pa.nulls(m_, pa.binary())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)
                # Words outside the top, for the buckets that count them.
                far = np.flatnonzero(i < 0)
                if len(far):
                    key, own = t[far], (np.searchsorted(begin, far, "right") - 1).astype(np.int64)
                    order = np.lexsort((own, key))
                    key, own = key[order], own[order]
                    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
                    times = np.diff([*new, len(key)]).astype(np.int32)
                    key, own = key[new], own[new].astype(np.int32)
                    b = ((key >> U(40)) * U(buckets) >> U(24)).astype(np.int32)
                    cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)]
                    blobs = [np.int64(row).tobytes() + key[x:y].tobytes() + own[x:y].tobytes() + times[x:y].tobytes() for x, y in pairwise(cuts)]
                    n = len(blobs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(b[cuts[:-1]]), pa.nulls(n, pa.int64()), pa.nulls(n, ids.type), pa.nulls(n, pa.bool_()), *(pa.nulls(n, pa.int64()) for _ in range(2)), *(pa.nulls(n, pa.float64()) for _ in range(2)), pa.array(blobs, pa.binary())], names)
                row += m_

    return run


def _answer(rare: float, unseen: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the words of each request; a bucket's vocabulary comes before its requests."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            for kind, bucket, blob, n in zip(*(batch.column(x).to_pylist() for x in ("kind", "bucket", "blob", "counts")), strict=True):
                if bucket != now:
                    now, keys, counts = bucket, np.zeros(0, U), np.zeros(0, np.int64)
                if kind == 0:
                    keys, counts = np.frombuffer(blob, U), np.frombuffer(n, np.int64)
                    continue
                row, m = int(np.frombuffer(blob, np.int64, 1)[0]), (len(blob) - 8) // 16
                key, own, times = np.frombuffer(blob, U, m, 8), np.frombuffer(blob, np.int32, m, 8 + 8 * m), np.frombuffer(blob, np.int32, m, 8 + 12 * m)
                c_ = np.zeros(m, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    c_ = np.where(keys[at] == key, counts[at], 0)
                score = np.where(c_ > 0, np.log10(np.maximum((1 - unseen) * c_ / max(rare, 1.0), 1e-300)), np.log10(unseen))
                who, back = np.unique(own, return_inverse=True)
                sums = [np.bincount(back, x * times, len(who)) for x in (np.log10(c_ + 1.0), c_ > 0, score)]
                yield pa.RecordBatch.from_arrays([pa.array(row + who.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], ["row", "base", "n_known", "score"])

    return run


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Any = None) -> DataFrame:
    """A row for each document: id_col, held_out, n_tokens, n_known, train_tokens, base_score (unigram
    with one added to every count), score (log10 probability of the text)."""
    spark = docs.sparkSession
    n = c.partitions(spark)
    held_out = F.lit(False) if held_out is None else held_out
    rows = c.spread(docs).select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = c.stash(rows.mapInArrow(_score(m), f"kind int, bucket int, row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, blob binary"))
    asked = scored.where("kind = 1").select("kind", "bucket", "blob", F.lit(None).cast("binary").alias("counts"))
    known = m.vocabulary.select(F.lit(0).alias("kind"), "bucket", F.col("keys").alias("blob"), "counts")
    both = known.union(asked).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    far = both.mapInArrow(_answer(m.rare, m.unseen), "row long, base double, n_known long, score double").groupBy("row").agg(F.sum("base").alias("b"), F.sum("n_known").alias("k"), F.sum("score").alias("s"))
    out = scored.where("kind = 0").join(far, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    base = plus("base", "b") - F.col("n_tokens") * F.lit(float(np.log10(m.n + m.v + 1.0)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "k").cast("long").alias("n_known"), F.lit(m.n).cast("long").alias("train_tokens"), base.alias("base_score"), plus("score", "s").alias("score"))
