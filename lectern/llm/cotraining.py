"""Quality classifier by co-training.

Two views of a document, from columns that they don't share: its text (shares of symbols, capitals,
repeated and distinct words, lines, hashed words, ...) and its metadata (language, source, number of
characters). Each view has a logistic classifier. In each round the confident predictions of one view
on unlabelled documents become labels for the other. Labelled documents that neither has seen
calibrate each view (Platt) and the combination of both; others that nothing has seen set the threshold.

Fitting takes the `fit_rows` labelled documents of the least hash of their id (a parameter) and every
document without a label. The latter stay distributed, as features in the shared folder: bins come
from counts of their values, a round labels the surest by counts of the views' strengths, and each
step of a fit sums gradients over all of them. Scoring covers every document, each by itself and whole.

Null and empty texts have the features of an empty text; null metadata are values of their own.
Null ids and repeated rows are scored like others. Labels that are null don't count; of several
labels of a document the lowest holds. Without labels of both kinds every document is kept, with
score 1. An empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm.common import U

WORD_BITS, META_BITS, BINS = 12, 10, 12
#: Confidence that makes a label for the other view, and the share of the pool a round may label.
SURE, ROUND_SHARE = 0.97, 0.2
#: Strengths of a sure prediction: steps of its logit from that of SURE to that of certainty.
SURE_LOGIT, LEVELS = math.log(SURE / (1 - SURE)), 64
STRENGTHS = int(35 * LEVELS)
#: Bits of the fraction of a number by which its values are counted for the edges of bins.
EDGE_BITS = 9
#: The lowest threshold: a few odd documents that are called good cannot let everything pass.
LEAST = 0.2


def text_numbers(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each text (rows), and its distinct hashed words with where they begin."""
    n = len(at) - 1
    words, owner, before = c.words(raw, at)
    count = np.diff(before)
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    times = np.diff([*first, len(w)]) if len(w) else np.zeros(0, np.int64)
    distinct = np.bincount(o[first], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, o[first], times)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[at[1:]] - sums[at[:-1]]

    lower, upper = (raw >= 97) & (raw <= 122), (raw >= 65) & (raw <= 90)
    digit, high = (raw >= 48) & (raw <= 57), raw >= 128
    space, line = c._IS_SEP[raw], raw == 10
    letters = share(lower | high) + share(upper)
    size = np.maximum(np.diff(at), 1)
    marks = share(~(lower | upper | digit | high | space))
    plain = share((raw == 46) | (raw == 44))
    many = np.maximum(count, 1)
    numbers = np.stack([
        marks / size, (marks - plain) / many, plain / many, share(upper) / np.maximum(letters, 1), share(digit) / size, letters / size,
        share(space) / size, distinct / many, most / many, np.bincount(owner, again, n) / many, letters / many, share(line) / many,
        np.log1p(count), distinct / np.sqrt(many), np.log1p(np.diff(at) / (1 + share(line))),
    ], 1)
    return numbers, w[first] >> U(64 - WORD_BITS), np.concatenate([[0], np.cumsum(distinct)])


def meta_features(lang: list, source: list, chars: list) -> np.ndarray:
    """Hashed features (columns) of the metadata of each document."""
    mask = (1 << META_BITS) - 1
    out = np.zeros((len(lang), 6), np.int64)
    for i, (a, b, n) in enumerate(zip(lang, source, chars, strict=True)):
        k = int(3 * math.log2(1 + n)) if n is not None and n >= 0 else -1
        for j, f in enumerate((f"l{a}", f"s{b}", f"n{k}", f"ls{a},{b}", f"ln{a},{k}", f"sn{b},{k}")):
            out[i, j] = zlib.crc32(f.encode()) & mask
    return out


class Logistic:
    """Logistic regression on rows of (column, value), by full gradients with Adam steps."""

    def __init__(self, width: int) -> None:
        self.w = np.zeros(width + 1)

    def margin(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.w[col] * value, n) + self.w[-1]

    def fit(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.1, l2: float = 1e-4) -> None:
        a, b, total = np.zeros_like(self.w), np.zeros_like(self.w), weight.sum()
        for t in range(1, steps + 1):
            d = (sigmoid(self.margin(row, col, value, len(y))) - y) * weight / total
            g = np.append(np.bincount(col, d[row] * value, len(self.w) - 1), d.sum())
            g[:-1] += l2 * self.w[:-1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            self.w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Views:
    """Both views of documents as rows of (column, value)."""

    def __init__(self, edges: np.ndarray) -> None:
        self.edges = edges  # of the bins of each number
        self.widths = (edges.shape[0] * BINS + (1 << WORD_BITS), 1 << META_BITS)

    def text(self, numbers: np.ndarray, words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = numbers.shape
        bins = np.stack([np.searchsorted(e, numbers[:, j], "right") for j, e in enumerate(self.edges)], 1)
        size = np.diff(begin)
        each = np.arange(n, dtype=np.int32)
        row = np.concatenate([np.repeat(each, k), np.repeat(each, size)])
        col = np.concatenate([(bins + np.arange(k) * BINS).reshape(-1).astype(np.int32), k * BINS + words.astype(np.int32)])
        return row, col, np.concatenate([np.ones(n * k, np.float32), np.repeat((1 / np.sqrt(np.maximum(size, 1))).astype(np.float32), size)])

    def meta(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = features.shape
        return np.repeat(np.arange(n), k), features.reshape(-1), np.ones(n * k)


def platt(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the given margins (columns) and a bias, on labels pulled in a little."""
    x = np.column_stack([margin, np.ones(len(y))])
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-6)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge + 1e-9), x.T @ (p - target) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
    w[:-1] = np.maximum(w[:-1], 0)  # a view never speaks against itself
    return w


class Model:
    """What scoring needs; everything in it is of a fixed size."""

    def __init__(self, views: Views, text: np.ndarray, meta: np.ndarray, scales: list[np.ndarray], joint: np.ndarray, threshold: float) -> None:
        self.views, self.text, self.meta, self.scales, self.joint, self.threshold = views, text, meta, scales, joint, threshold

    def scores(self, raw: np.ndarray, at: np.ndarray, lang: list, source: list, chars: list) -> list[np.ndarray]:
        n = len(at) - 1
        row, col, value = self.views.text(*text_numbers(raw, at))
        margins = [np.bincount(row, self.text[col] * value, n) + self.text[-1], self.meta[meta_features(lang, source, chars)].sum(1) + self.meta[-1]]
        calibrated = [m * s[0] + s[1] for m, s in zip(margins, self.scales, strict=True)]
        return [sigmoid(calibrated[0]), sigmoid(calibrated[1]), sigmoid(np.column_stack(calibrated) @ self.joint[:2] + self.joint[2])]


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = c.text_of(batch.column("text"))
        for s, e in c.pieces(at):
            part, own, begin = batch.slice(s, e - s), raw[at[s] : at[e]], at[s : e + 1] - at[s]
            numbers, words, bounds = text_numbers(own, begin)
            meta = meta_features(*(part.column(x).to_pylist() for x in ("lang", "source", "n_chars"))).astype(np.uint16)
            blobs = [[numbers[i].tobytes(), words[bounds[i] : bounds[i + 1]].astype(np.uint16).tobytes(), meta[i].tobytes()] for i in range(e - s)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("h"), *(pa.array([b[k] for b in blobs], pa.binary()) for k in range(3))], ["id", "y", "h", "numbers", "words", "meta"])
    c.tidy()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all entries of a binary column, and where each begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _parts(batch: pa.RecordBatch) -> Iterator[Part]:
    """h, numbers, words, where each document's words begin, and meta of documents at once."""
    raw, at = _bytes(batch.column("words"))
    h, rows = np.asarray(batch.column("h")).view(U), batch.num_rows
    numbers, meta = _bytes(batch.column("numbers"))[0].view(np.float64).reshape(rows, -1), _bytes(batch.column("meta"))[0].view(np.uint16).reshape(rows, -1)
    for s, e in c.pieces(at):
        yield h[s:e], numbers[s:e], raw[at[s] : at[e]].view(np.uint16), (at[s : e + 1] - at[s]) // 2, meta[s:e].astype(np.int64)


def _sum(pool: DataFrame, step: Callable[[Part], np.ndarray], size: int) -> np.ndarray:
    """Sum of the vectors (of the given size) of all documents; a task sends one vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in _parts(batch):
                total += step(part)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "blob"])
        c.tidy()

    found = pool.coalesce(c.partitions(pool.sparkSession)).mapInArrow(run, "task int, blob binary").collect()
    return np.sum([np.zeros(size), *(np.frombuffer(r["blob"]) for r in sorted(found, key=lambda r: r["task"]))], axis=0)


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the values of each number, to EDGE_BITS bits of their fractions."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for _, numbers, *_ in _parts(batch):
            own = _level(numbers) + (np.arange(numbers.shape[1]) << 32)
            keys, back = np.unique(np.concatenate([keys, own.reshape(-1)]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, np.ones(own.size, np.int64)]), len(keys)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _level(numbers: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(numbers).view(U) >> U(52 - EDGE_BITS)).astype(np.int64)


def _quantiles(keys: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Quantiles of values that are counted by their levels (sorted)."""
    at = np.searchsorted(np.cumsum(n), share * (n.sum() - 1), "right")
    return (keys[at].astype(U) << U(52 - EDGE_BITS)).view(np.float64)


def _logits(history: list, views: Views, data: list, n: int) -> Iterator[tuple[list[np.ndarray], list]]:
    """Of each round: the calibrated logits of both views, and which of them make labels."""
    for models, scales, cuts in history:
        margins = [np.bincount(row, w[col] * value, n) + w[-1] for w, (row, col, value) in zip(models, data, strict=True)]
        yield [np.clip(m * s[0] + s[1], -35, 35) for m, s in zip(margins, scales, strict=True)], cuts


def _given(history: list, views: Views, data: list, h: np.ndarray) -> list[np.ndarray]:
    """Labels that the rounds so far give to unlabelled documents in each view; -1 is none."""
    out = [np.full(len(h), -1), np.full(len(h), -1)]
    chance = (h >> U(11)) * 2.0**-53
    for logits, cuts in _logits(history, views, data, len(h)):
        for view in (0, 1):
            x = logits[1 - view]
            strength = np.floor((np.abs(x) - SURE_LOGIT) * LEVELS).astype(np.int64)
            for label in (0, 1):
                least, share = cuts[view][label]
                more = (strength > least) | ((strength == least) & (chance < share))
                out[view][(out[view] < 0) & (strength >= 0) & ((x > 0) == label) & more] = label
    return out


def _sure(history: list, latest: tuple, views: Views) -> Callable[[Part], np.ndarray]:
    """Counts of the documents that the latest models could label: by view, label, strength."""

    def step(part: Part) -> np.ndarray:
        h, numbers, words, begin, meta = part
        data = [views.text(numbers, words, begin), views.meta(meta)]
        given, out = _given(history, views, data, h), np.zeros((2, 2, STRENGTHS))
        logits, _ = next(_logits([(*latest, None)], views, data, len(h)))
        for view in (0, 1):
            x = logits[1 - view]
            strength = np.floor((np.abs(x) - SURE_LOGIT) * LEVELS).astype(np.int64)
            for label in (0, 1):
                out[view, label] = np.bincount(strength[(given[view] < 0) & (strength >= 0) & ((x > 0) == label)], minlength=STRENGTHS)
        return out.reshape(-1)

    return step


def _cut(counts: np.ndarray, most: int) -> tuple[int, float]:
    """The least strength that makes a label, and the share of that strength that gets one, so that
    `most` documents do."""
    above = np.cumsum(counts[::-1])[::-1]
    if above[0] <= most:
        return 0, 1.0
    at = int(np.flatnonzero(above > most)[-1])
    return at, float((most - (above[at] - counts[at])) / counts[at])


def _slopes(data: list, given: list[np.ndarray], points: list[np.ndarray]) -> np.ndarray:
    """Count, loss and gradient of the documents of each label (0, 1) of each view, at points."""
    out = []
    for (row, col, value), y, w in zip(data, given, points, strict=True):
        n, width = len(y), len(w) - 1
        z = np.bincount(row, w[col] * value, n) + w[-1]
        d, loss, has = sigmoid(z) - y, np.logaddexp(0, z) - y * z, y >= 0
        take = has[row]
        row, col, value = row[take], col[take], value[take]
        slope = np.bincount(col + width * y[row], d[row] * value, 2 * width).reshape(2, width)
        of = lambda x: np.bincount(y[has], x[has], 2)[:, None]  # noqa: B023, E731
        out.append(np.hstack([of(np.ones(n)), of(loss), slope, of(d)]).reshape(-1))
    return np.concatenate(out)


def _pooled(history: list, views: Views, points: list[np.ndarray]) -> Callable[[Part], np.ndarray]:
    def step(part: Part) -> np.ndarray:
        h, numbers, words, begin, meta = part
        data = [views.text(numbers, words, begin), views.meta(meta)]
        return _slopes(data, _given(history, views, data, h), points)

    return step


class Descent:
    """L-BFGS: `at` is the point whose loss and gradient it waits for, w the best so far."""

    def __init__(self, w: np.ndarray) -> None:
        self.w = self.at = w
        self.loss, self.g, self.d, self.size = np.inf, np.zeros_like(w), np.zeros_like(w), 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def tell(self, loss: float, g: np.ndarray) -> None:
        if loss > self.loss + 1e-4 * self.size * (self.g @ self.d):
            self.size /= 4
            self.at = self.w + self.size * self.d
            return
        s, y = self.at - self.w, g - self.g
        if np.isfinite(self.loss) and s @ y > 1e-12:
            self.pairs = [*self.pairs[-9:], (s, y)]
        self.w, self.loss, self.g, self.size = self.at, loss, g, 1.0
        q, used = g.copy(), []
        for s, y in reversed(self.pairs):
            used.append((s @ q) / (s @ y))
            q -= used[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q *= min(1.0, 1 / max(1e-12, np.sqrt(g @ g)))
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        self.d = -q
        self.at = self.w + self.d


def _objective(own: np.ndarray, pooled: np.ndarray, points: list[np.ndarray], l2: float = 1e-4) -> Iterator[tuple[float, np.ndarray]]:
    """Loss and gradient of each view: both labels have equal weight together, a document of the
    pool half of that of a labelled one."""
    at = 0
    for w in points:
        size = 2 * (len(w) + 2)
        mine, others = own[at : at + size].reshape(2, -1), pooled[at : at + size].reshape(2, -1)
        at += size
        count = np.maximum(1, mine[:, 0] + others[:, 0])
        sums = ((mine + 0.5 * others) * (count.sum() / count)[:, None]).sum(0)
        g = sums[2:] / sums[0]
        g[:-1] += l2 * w[:-1]
        yield float(sums[1] / sums[0] + l2 / 2 * (w[:-1] @ w[:-1])), g


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, rounds: int = 3, steps: int = 12, most_bad: float = 0.005) -> Model | None:
    """docs: id, text, lang, source, n_chars; labels: id, y (1 good, 0 bad). The threshold rejects
    at most about most_bad of good documents, but lies between LEAST and a half. None without labels of both kinds."""
    spark = docs.sparkSession
    order = [F.xxhash64("id"), F.col("id")]
    labels = labels.where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    some = {r["id"]: int(r["y"]) for r in labels.orderBy(*order).limit(fit_rows).collect()}
    if len(set(some.values())) < 2:
        return None
    wanted = spark.createDataFrame([*some.items()], "id long, y int")
    schema = "id long, y int, h long, numbers binary, words binary, meta binary"
    shown = lambda rows, y: rows.select("id", y, F.xxhash64("id", "text").alias("h"), "text", "lang", "source", "n_chars").mapInArrow(_features, schema)
    found = shown(docs.join(F.broadcast(wanted), "id"), "y").dropDuplicates(["id"]).toArrow().sort_by("id").combine_chunks()
    y = found.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    # All documents without a label; those without an id have none.
    none = F.lit(None).cast("int").alias("y")
    others = c.join_small(shown(docs.where("id is not null"), none), labels.select("id"), "id", "left_anti", labels.count())
    pool = c.stash(others.union(shown(docs.where("id is null"), none)).select("h", "numbers", "words", "meta"))
    parts = [p for batch in found.to_batches() for p in _parts(batch)]
    numbers, words, meta = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 4))
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
    # Bins: half of their edges by the bad documents, which are few.
    spread = pool.coalesce(c.partitions(spark)).mapInArrow(_spread, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (spread.column(x).to_numpy() for x in ("key", "n"))
    size = int(n[keys >> 32 == 0].sum())
    edges = []
    for j in range(numbers.shape[1]):
        here, good = keys >> 32 == j, _level(numbers[y == 1, j])
        levels, back = np.unique(np.concatenate([keys[here] & 0xFFFFFFFF, good]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([n[here], np.ones(len(good))]))
        share = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
        rest = np.linspace(0, 1, BINS - len(share) + 1)[1:-1]
        edges.append(np.sort(np.concatenate([_quantiles(levels, counts, share), np.quantile(numbers[y == 0, j], rest)])))
    views = Views(np.stack(edges))
    data = [views.text(numbers, words, begin), views.meta(meta)]
    # An eighth of the labelled documents calibrates, another sets the threshold, the others train; where
    # few labels leave a kind out, all do all.
    deal = np.array([zlib.crc32(b"%d" % i) for i in found.column("id").to_pylist()]) % 8
    held, judges, train = deal == 0, deal == 4, deal % 4 != 0
    if len(set(y[held].tolist())) < 2:
        held = np.ones(len(y), bool)
        train = held.copy()
    if not (y[judges] == 1).any():
        judges = held
    own = [np.where(train, y, -1)] * 2
    good, bad = max(1, int((own[0] == 1).sum())), max(1, int((own[0] == 0).sum()))
    weight = np.where(train, np.where(y == 1, (good + bad) / good, (good + bad) / bad), 0.0)
    models = []
    for (row, col, value), width in zip(data, views.widths, strict=True):
        m, take = Logistic(width), train[row]
        m.fit(row[take], col[take], value[take], np.maximum(own[0], 0), weight)
        models.append(m.w)

    def calibrated() -> tuple[list[np.ndarray], list[np.ndarray]]:
        margins = [np.bincount(row, w[col] * value, len(y)) + w[-1] for w, (row, col, value) in zip(models, data, strict=True)]
        return margins, [platt(m[held, None], y[held]) for m in margins]

    history: list = []
    for _ in range(rounds if size else 0):
        latest = (models, calibrated()[1])
        sure = _sum(pool, _sure(history, latest, views), 4 * STRENGTHS).reshape(2, 2, STRENGTHS)
        history = [*history, (*latest, [[_cut(sure[v, k], max(1, int(ROUND_SHARE * size))) for k in (0, 1)] for v in (0, 1)])]
        descents = [Descent(w) for w in models]
        for _ in range(steps):
            points = [d.at for d in descents]
            pooled = _sum(pool, _pooled(history, views, points), sum(2 * (len(w) + 2) for w in points))
            for d, told in zip(descents, _objective(_slopes(data, own, points), pooled, points), strict=True):
                d.tell(*told)
        models = [d.w for d in descents]
    margins, scales = calibrated()
    both = np.column_stack([m * s[0] + s[1] for m, s in zip(margins, scales, strict=True)])
    joint = platt(both[held], y[held])
    p = sigmoid(both[judges & (y == 1)] @ joint[:2] + joint[2])
    threshold = float(np.clip(np.quantile(p, most_bad), LEAST, 0.5))
    return Model(views, models[0], models[1], scales, joint, threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_id: str = "doc_id", label_col: str = "quality", keep: tuple[str, ...] = (), **parameters: Any) -> DataFrame:
    """A row for each document: id_col, p_text, p_meta (calibrated views), score, kept, and the
    columns of keep."""
    rows = c.spread(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(chars_col).cast("long").alias("n_chars"), *(F.col(k).alias(f"keep_{k}") for k in keep if k != text_col))
    model = fit(rows.select("id", "text", "lang", "source", "n_chars"), labels.select(F.col(label_id).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y")), **parameters)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["text" if k == text_col else f"keep_{k}" for k in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, at = c.text_of(batch.column("text"))
            for s, e in c.pieces(at):
                part, n = batch.slice(s, e - s), e - s
                got = m.scores(raw[at[s] : at[e]], at[s : e + 1] - at[s], *(part.column(x).to_pylist() for x in ("lang", "source", "n_chars"))) if m else [np.ones(n)] * 3
                ok = got[2] >= m.threshold if m else np.ones(n, bool)
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, got), pa.array(ok), *(part.column(k) for k in kept)], [id_col, "p_text", "p_meta", "score", "kept", *keep])
        c.tidy()

    schema = ", ".join([f"`{id_col}` long, p_text double, p_meta double, score double, kept boolean", *(f"`{k}` {rows.schema[x].dataType.simpleString()}" for k, x in zip(keep, kept, strict=True))])
    return rows.mapInArrow(run, schema)
