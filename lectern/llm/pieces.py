"""Vectorised pre-tokenisation and cached pair merging.

Boundaries: each code point's class is a letter of a small automaton. An automaton step is a
function on states, and functions compose associatively, so the state before every code point
comes from a scan over composed functions (blocks in lockstep, then the blocks' own totals):
no regular expression, no loop over characters. What a class has to know about the code points
after it is looked up beforehand by shifted comparisons.

Pieces: a slice between boundaries is found by its 64-bit hash in a direct-mapped table of
slices already merged; only new slices are merged, many at once."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import regex

from lectern.llm import common as c
from lectern.llm.common import U

#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, APOSTROPHE, WHITE = range(6)


def _classes() -> np.ndarray:
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(name, points):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[WHITE_SPACE] = WHITE
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    return out


_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    if "class" not in _tables:
        _tables["class"] = _classes()
    return _tables["class"]


class Automaton:
    """steps[symbol, state] is the next state. Holds all functions that steps compose to."""

    def __init__(self, steps: np.ndarray) -> None:
        self.steps = steps
        ids: dict[tuple[int, ...], int] = {tuple(range(steps.shape[1])): 0}
        gens = [tuple(map(int, s)) for s in steps]
        todo = [*ids, *(g for g in dict.fromkeys(gens) if g not in ids)]
        for g in todo[1:]:
            ids[g] = len(ids)
        for f in todo:
            for g in dict.fromkeys(gens):
                h = tuple(g[x] for x in f)
                if h not in ids:
                    ids[h] = len(ids)
                    todo.append(h)
        f = np.array(list(ids))
        self.of = np.array([ids[g] for g in gens], np.uint16)
        self.maps = f.astype(np.uint8)
        self.then = np.array([[ids[tuple(y)] for y in f[:, x]] for x in f], np.uint16)  # [first, second]

    def _carry(self, fn: np.ndarray, start: int) -> np.ndarray:
        """State before each function, from start."""
        n, width = len(fn), 64
        if n <= width:
            out, s = np.empty(n, np.uint8), start
            for i, x in enumerate(fn):
                out[i] = s
                s = self.maps[x, s]
            return out
        rows = -(-n // width)
        x = np.zeros(rows * width, np.uint16)
        x[:n] = fn
        x = np.ascontiguousarray(x.reshape(rows, width).T)
        total = x[0].copy()
        for j in range(1, width):
            total = self.then[total, x[j]]
        state = self._carry(total, start)
        out = np.empty((width, rows), np.uint8)
        for j in range(width):
            out[j] = state
            state = self.maps[x[j], state]
        return out.T.reshape(-1)[:n]

    def before(self, symbols: np.ndarray, start: int = 0) -> np.ndarray:
        return self._carry(self.of[symbols], start)


# States and symbols of the byte-level pattern. T: the last white space before something else;
# K: an apostrophe that begins a contraction of so many letters.
_B, _L, _N, _O, _W, _P, _K2, _K1, _E = range(9)
_SYMBOLS = ("other", "letter", "number", "white", "space_t", "white_t", "contraction1", "contraction2")


def _byte_level() -> tuple[Automaton, np.ndarray]:
    step, cut = np.zeros((16, 9), np.uint8), np.ones((16, 9), bool)
    for s in range(9):
        for k, run in ((0, _O), (1, _L), (2, _N)):
            step[k, s], cut[k, s] = run, s not in (run, _P)
        if s == _K2:
            step[1, s], cut[1, s] = _K1, False
        if s == _K1:
            step[1, s], cut[1, s] = _E, False
        step[3, s], cut[3, s] = _W, s != _W
        step[4, s], step[5, s] = _P, _E
        for k, run in ((6, _K1), (7, _K2)):
            step[k, s], cut[k, s] = (_O, False) if s in (_P, _O) else (run, True)
    step[8:] = step[:8, :1]  # the first of a text: as from the beginning
    return Automaton(step), cut


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as flags of code points. first: where each text that
    isn't empty begins."""
    if "automaton" not in _tables:
        _tables["automaton"], _tables["cut"] = _byte_level()
    n = len(points)
    kind = classes()[points]
    begins = np.zeros(n + 3, bool)
    begins[first] = True
    begins[n:] = True
    padded = np.zeros(n + 2, np.uint32)
    padded[:n] = points
    one, two = padded[1 : n + 1], padded[2:]
    white = (kind == SPACE) | (kind == WHITE)
    symbol = np.array([0, 1, 2, 3, 0, 3], np.uint8)[kind]
    tail = white.copy()
    tail[:-1] &= ~white[1:]
    tail &= ~begins[1 : n + 1]  # white space at the end of a text is one piece
    symbol[tail] = np.where(kind[tail] == SPACE, 4, 5)
    at = np.flatnonzero((kind == APOSTROPHE) & ~begins[1 : n + 1])
    a, b = one[at], np.where(begins[2 : n + 2][at], 0, two[at])
    symbol[at[np.isin(a, [ord(x) for x in "stmd"])]] = 6
    symbol[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = 7
    symbol += begins[:n].astype(np.uint8) * np.uint8(8)
    return _tables["cut"][symbol, _tables["automaton"].before(symbol)] | begins[:n]


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 and the byte at which each begins."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero((raw & 0xC0) != 0x80)


def runs(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all runs, one after the other."""
    total = int(size.sum())
    end = np.cumsum(size)
    return pool[np.repeat(start - (end - size), size) + np.arange(total)]


class Cache:
    """Ids of pieces by hash: a table in which a new piece replaces the one in its slot."""

    def __init__(self, bits: int = 20, most: int = 6_000_000) -> None:
        self.mask, self.most = U((1 << bits) - 1), most
        self.keys = np.zeros(1 << bits, U)
        self.start, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def get(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids are, and how many. make(i) gives ids and counts
        of the pieces with indices i."""
        if self.used > self.most:
            self.keys[:] = 0
            self.used = 0
        slot = hashes & self.mask
        start, size = self.start[slot], self.size[slot]
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            _, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            ids, n = make(miss[at])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            new = self.used + np.cumsum(n) - n
            self.used += len(ids)
            into = slot[miss[at]]
            order = np.arange(len(into))
            self.keys[into], self.start[into], self.size[into] = hashes[miss[at]], new[order], n[order]
            start[miss], size[miss] = new[back], n[back]
        return start, size.astype(np.int64)


def slice_hashes(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of raw[begin[i] : begin[i + 1]]; zero stands for no piece."""
    up, down = c._power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(c._BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    s, e = begin[:-1], begin[1:]
    return np.maximum(c.mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xA0761D6478BD642F)), U(1))


class Merger:
    """Pair merging by the ranks of a vocabulary of byte strings: of all neighbours whose
    concatenation is in the vocabulary, those of the lowest rank merge first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        pairs = {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift = U(64 - bits)
        self.keys, self.ranks = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int64)
        self.reach = 1
        for k, r in pairs.items():
            at = (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)
            n = 0
            while self.keys[at + n] >= 0:
                n += 1
            self.keys[at + n], self.ranks[at + n] = k, r
            self.reach = max(self.reach, n + 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or width where it doesn't merge."""
        key = left * self.width + right
        at = (key.astype(U) * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = np.full(key.shape, self.width)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key, at = key.reshape(-1), at.reshape(-1)
        flat = out.reshape(-1)
        for n in range(self.reach):
            if not len(todo):
                break
            held = self.keys[at[todo] + n]
            hit = held == key[todo]
            flat[todo[hit]] = self.ranks[at[todo[hit]] + n]
            todo = todo[~hit & (held >= 0)]
        return out

    def together(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges pieces of one length, rows of bytes, in lockstep."""
        ids = self.single[x]
        rows, n = ids.shape
        out, counts = np.full((rows, n), -1, np.int64), np.zeros(rows, np.int64)
        live = np.arange(rows)
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if n > 1 else np.zeros((rows, 0), np.int64)
        while len(live):
            done = (ranks.min(1, initial=self.width) == self.width)
            if done.any():
                out[live[done], : ids.shape[1]] = ids[done]
                ids, ranks, live = ids[~done], ranks[~done], live[~done]
                if not len(live):
                    break
            at = ranks.argmin(1)
            row = np.arange(len(live))
            ids[row, at] = ranks[row, at]
            # What follows moves one to the left.
            move = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids = np.concatenate([np.where(move, ids[:, 1:], ids[:, :-1]), np.full((len(live), 1), -1)], 1)[:, :-1]
            ranks = np.where(move[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < ranks.shape[1])
                    i, j = row[ok], near[ok]
                    ranks[i, j] = self.rank(ids[i, j], ids[i, j + 1])
        counts = (out >= 0).sum(1)
        return out[out >= 0], counts

    def long(self, x: bytes) -> list[int]:
        """Merges one piece of any length with a heap, in n log n."""
        ids = [int(self.single[b]) for b in x]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] * self.width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := self.pairs.get(ids[p] * self.width + ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def merge(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices, one after the other, and how many each has."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        counts = np.zeros(len(start), np.int64)
        order = np.argsort(size, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(size[order])) + 1), len(order)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[s:e]
            n = int(size[own[0]]) if len(own) else 0
            for k in range(0, len(own), 20_000 if n <= 48 else 1):
                part = own[k : k + 20_000] if n <= 48 else own[k : k + 1]
                if n <= 48:
                    ids, counts[part] = self.together(raw[start[part][:, None] + np.arange(n)])
                else:
                    ids = np.array(self.long(raw[start[part[0]] : start[part[0]] + n].tobytes()), np.int64)
                    counts[part] = len(ids)
                found.append(ids)
        at = np.zeros(len(start), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return runs(np.concatenate(found), at, counts), counts
