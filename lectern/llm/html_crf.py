"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read leniently into leaf blocks: runs of text between block-level tags. Features of a
block are its ancestors' tags, class, id and role words, and its whole text: length, share of link text,
punctuation, words that begin with digits or capitals, its words, place in the page. Weights of features and of transitions
are trained on labelled pages by gradients from forward-backward, and pages are decoded by Viterbi,
many in lockstep.

Scripts, styles, templates, comments and the head are never text. A null or empty page, and one
without a block of main text, has the empty text. Pages of any length are read whole and each row
by itself; repeated rows give equal results. Extra columns are ignored."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm.labelled_pages import bare_pages, labelled_pages

#: Elements that end a run of text (fixed values).
BLOCKS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text, and among them those whose content isn't markup.
DROPPED = frozenset("head script style template noscript iframe svg math object canvas audio video title noframes noembed".split())
RAW = frozenset("script style iframe noembed noframes textarea title".split())
#: Elements that an opening tag ends, where they are open (fixed values).
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select body html article section div form nav aside header footer main td th".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop|aria-label)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")
_WORD = re.compile(r"\w+")


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, ancestors from the root as 'tag word word', characters of link text) of each block."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    linked, links, dropped = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            if text := " ".join("".join(run).split()):
                out.append((text, tuple(x[1] for x in stack), linked))
            run.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, dropped
        for name, _ in stack[to:]:
            links -= name == "a"
            dropped -= name in DROPPED
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        s = m.start() if m else n
        if s > at and not dropped:
            text = page[at:s]
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            linked += len(text) if links else 0
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            i = len(stack) - 1
            while i >= 0 and stack[i][0] != name:
                i -= 1
            if name in BLOCKS and not dropped:
                flush()
            if i >= 0:
                if any(x[0] in BLOCKS for x in stack[i:]) and not dropped:
                    flush()
                pop(i)
            continue
        if name == "br" and not dropped:
            run.append(" ")
        if name in DROPPED and name not in ("svg", "math", "canvas", "object", "audio", "video") and not dropped:
            flush()
        if name in BLOCKS:
            if not dropped:
                flush()
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[name]:
                        pop(i)
                        if name != "tr":
                            break
                    elif stack[i][0] in SCOPES:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            if name == "body" and stack:  # a head that was never closed ends here
                pop(next((i for i, x in enumerate(stack) if x[0] == "head"), len(stack)))
        if name in VOID or m[3].endswith("/>") and name not in BLOCKS and name not in RAW:
            continue
        words: list[str] = []
        if len(m[3]) > 1:
            for k, v in _ATTR.findall(m[3]):
                k, v = k.lower(), v.strip("\"'").lower()
                if k in ("class", "id"):
                    words += _NAME.findall(v)
                elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "none" in v and "display" in v):
                    words.append("=hidden")
                elif k in ("role", "itemprop"):
                    words += [f"={x}" for x in _NAME.findall(v)]
        stack.append((name, " ".join([name, *dict.fromkeys(words)])))
        links += name == "a"
        dropped += name in DROPPED
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            if not dropped:
                run.append(html.unescape(page[at : end.start() if end else n]))
            at = end.start() if end else n
    flush()
    return out


def _scale(n: int) -> int:
    return min(n.bit_length(), 11)


def path_features(path: tuple[str, ...]) -> list[str]:
    out: set[str] = set()
    for k, element in enumerate(path):
        tag, *words = element.split(" ")
        out.add(f"t:{tag}")
        for w in words:
            out.add(f"c:{w}")
            if w.isalpha():
                out.add(f"c:{w.rstrip('s')}~")
        if k == len(path) - 1:
            out.add(f"p:{tag}")
    tags = [x.split(" ")[0] for x in path]
    for outer in ("article", "main"):
        if outer in tags:
            at = tags.index(outer)
            out |= {f"in:{outer}>{t}" for t in tags[at + 1 :]} | {f"in:{outer}"}
    if not out & {"t:article", "t:main"}:
        out.add("outside")
    return sorted(out)


#: Elements that say what they hold (fixed values).
NAMED = frozenset("article aside footer form header main nav".split())

#: The words of a block of so many or fewer count in full. Notices are short; the more words a block has,
#: the less each says of what it is, by the square.
FULL_WORDS = 12


def page_features(path: tuple[str, ...], text: str, linked: int, longest: int, blocks: int) -> list[str]:
    """Features of a block beside the others of its page, where no name and no element says what it is."""
    if any(" " in x or x in NAMED for x in path):
        return []
    n = len(text)
    tag, share = path[-1] if path else "", min(3, 4 * linked // max(1, n))
    part = 0 if n == longest else _scale(longest // max(1, n))  # how much shorter than the page's longest block
    return ["bare", f"b:{part}", f"b:{part},{share}", f"bt:{tag},{part}", f"bs:{tag},{share}", f"bn:{_scale(n)},{share}", f"one:{blocks == 1}"]


def text_features(text: str, linked: int, tag: str, place: float) -> tuple[list[str], list[str], float]:
    """Features of the whole text of a block: names of value 1, and its distinct words with the value of each."""
    words = _WORD.findall(text)
    n, many = len(text), max(1, len(words))
    share = min(3, 4 * linked // max(1, n))
    last = text[-1]
    out = [f"n:{_scale(n)}", f"w:{_scale(len(words))}", f"l:{share}", f"nl:{min(_scale(n), 8)},{share}", f"tl:{tag},{share}", f"tn:{tag},{_scale(n) // 2}", f"place:{int(place * 5)}"]
    out.append("end:" + ("." if last in ".!?…" else "," if last in ",:;" else "w"))
    out.append(f"cap:{min(3, 4 * sum(w[0].isupper() for w in words) // many)}")
    out.append(f"dig:{min(3, 4 * sum(w[0].isdigit() for w in words) // many)}")
    if "©" in text or "(c)" in text:
        out.append("copy")
    distinct = {w.lower() for w in words}
    return out, [f"s:{w}" for w in distinct], min(1.0, (FULL_WORDS / many) ** 2)


class Crf:
    """Two labels; weights of features are those of label 1 against label 0."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.trans, self.first = weights, trans, first
        self.paths: dict[tuple[str, ...], float] = {}

    def scores(self, blocks: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
        get, out, n = self.weights.get, np.empty(len(blocks)), len(blocks)
        longest = max((len(x[0]) for x in blocks), default=0)
        for i, (text, path, linked) in enumerate(blocks):
            if (x := self.paths.get(path)) is None:
                if len(self.paths) > 200_000:
                    self.paths.clear()
                x = self.paths[path] = sum(get(f, 0.0) for f in path_features(path))
            tag = path[-1].split(" ", 1)[0] if path else ""
            plain, words, value = text_features(text, linked, tag, i / n)
            plain += page_features(path, text, linked, longest, n)
            out[i] = x + sum(get(f, 0.0) for f in plain) + value * sum(get(f, 0.0) for f in words)
        return out

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of pages, in lockstep."""
        size = np.array([len(p) for p in pages])
        if not len(pages) or not size.max():
            return [np.zeros(0, bool) for _ in pages]
        order = np.argsort(-size, kind="stable")
        longest = int(size.max())
        e = np.zeros((longest, len(pages)))
        for j, i in enumerate(order):
            e[: size[i], j] = pages[i]
        back = np.zeros((longest, 2, len(pages)), bool)
        best = np.stack([np.full(len(pages), self.first[0]), self.first[1] + e[0]])
        ended = np.sort(size)[::-1]
        for t in range(1, longest):
            w = int(np.searchsorted(-ended, -t, "left"))
            from_ = best[:, None, :w] + self.trans[:, :, None]
            back[t, :, :w] = from_[1] > from_[0]
            best[:, :w] = from_.max(0)
            best[1, :w] += e[t, :w]
        out = np.zeros((longest, len(pages)), bool)
        label = best[1] > best[0]
        for t in range(longest - 1, -1, -1):
            w = int(np.searchsorted(-ended, -t, "left"))
            out[t, :w] = label[:w]
            label[:w] = np.where(label[:w], back[t, 1, :w], back[t, 0, :w])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return [out[: size[i], rank[i]] for i in range(len(pages))]


def _marked(page: list[tuple[str, int | None]]) -> tuple[list, list[int]]:
    """Blocks of a labelled page and their labels: texts carry a mark through the parser."""
    blocks = leaf_blocks("".join(x if label is None else f"{x} {label}" for x, label in page))
    found = [(re.sub(r" ?[01]", "", t), p, k, [int(x) for x in re.findall("([01])", t)]) for t, p, k in blocks]
    found = [x for x in found if x[3] and x[0]]
    return [x[:3] for x in found], [round(sum(x[3]) / len(x[3])) for x in found]


def train(pages: list[list[tuple[str, int | None]]], steps: int = 160, rate: float = 0.3, l2: float = 4e-6) -> Crf:
    """Fits a model to labelled pages by full gradients (forward-backward) with Adam steps."""
    names: dict[str, int] = {}
    rows, cols, values, labels, sizes = [], [], [], [], []
    for page in pages:
        blocks, y = _marked(page)
        if not blocks:
            continue
        long = max(len(x[0]) for x in blocks)
        for i, (text, path, linked) in enumerate(blocks):
            plain, words, value = text_features(text, linked, path[-1].split(" ", 1)[0] if path else "", i / len(blocks))
            plain = path_features(path) + plain + page_features(path, text, linked, long, len(blocks))
            cols += [names.setdefault(x, len(names)) for x in plain + sorted(words)]
            values += [1.0] * len(plain) + [value] * len(words)
            rows += [len(labels)] * (len(plain) + len(words))
            labels.append(y[i])
        sizes.append(len(blocks))
    row, col, val, y, size = np.array(rows), np.array(cols), np.array(values), np.array(labels), np.array(sizes)
    counts = np.bincount(col)
    use = counts[col] >= 3  # names that one page alone has teach nothing about others
    row, col, val = row[use], col[use], val[use]
    blocks, by_block = np.unique(row, return_index=True)  # rows come in order
    turn = np.argsort(col, kind="stable")
    used, by_name = np.unique(col[turn], return_index=True)
    row_turned, val_turned = row[turn], val[turn]
    order = np.argsort(-size, kind="stable")
    begin = (np.cumsum(size) - size)[order]
    size = size[order]
    longest, m, n = int(size[0]), len(size), len(y)
    width = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]
    at = [begin[: width[t]] + t for t in range(longest)]
    w, trans, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans, first)]
    for step in range(1, steps + 1):
        e = np.zeros(n)
        e[blocks] = np.add.reduceat(w[col] * val, by_block)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[at[0]] = first
        alpha[at[0], 1] += e[at[0]]
        for t in range(1, longest):
            a = alpha[at[t - 1][: width[t]]][:, :, None] + trans
            a = np.logaddexp(a[:, 0], a[:, 1])
            a[:, 1] += e[at[t]]
            alpha[at[t]] = a
        pair = np.zeros((2, 2))
        z = np.zeros(m)
        last = begin + size - 1
        z = np.logaddexp(alpha[last, 0], alpha[last, 1])
        for t in range(longest - 1, 0, -1):
            b = beta[at[t]].copy()
            b[:, 1] += e[at[t]]
            x = b[:, None, :] + trans
            before = at[t - 1][: width[t]]
            beta[before] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            pair += np.exp(alpha[before][:, :, None] + x - z[: width[t], None, None]).sum(0)
            np.subtract.at(pair, (y[before], y[at[t]]), 1)
        p = alpha + beta
        p = np.exp(p[:, 1] - np.logaddexp(p[:, 0], p[:, 1]))
        gw = l2 * w * len(y) / m
        gw[used] += np.add.reduceat((p - y)[row_turned] * val_turned, by_name) / m
        g0 = np.array([((1 - p) - (1 - y))[at[0]].sum(), (p - y)[at[0]].sum()]) / m
        for x, g, (a, b) in zip((w, trans, first), (gw, pair / m, g0), moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-9)
    return Crf({k: float(w[i]) for k, i in names.items() if w[i]}, trans, first)


_models: dict[tuple[int, int], Crf] = {}


def default_model(pages: int = 1200, seed: int = 1) -> Crf:
    """The model of the built-in labelled pages, and two for each three of them without names; trained once in a process,
    in a few seconds."""
    if (pages, seed) not in _models:
        _models[pages, seed] = train(labelled_pages(pages, seed) + bare_pages(2 * pages // 3, seed))
    return _models[pages, seed]


def main_texts(pages: list[str | None], model: Crf) -> list[str]:
    blocks = [leaf_blocks(p or "") for p in pages]
    labels = model.decode([model.scores(b) for b in blocks])
    return ["\n".join(t for (t, _, _), keep in zip(b, y, strict=True) if keep) for b, y in zip(blocks, labels, strict=True)]


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: id_col, url_col, text, n_chars (code points of text)."""
    spark = pages.sparkSession
    model = model or default_model()
    held = spark.sparkContext.broadcast((model.weights, model.trans, model.first))
    state: dict[str, Crf] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.setdefault("crf", Crf(*held.value))
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum([len(x or "") for x in batch.column("html").to_pylist()])])
            cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] + 4_000_000, 4_000_000)).clip(0, batch.num_rows))
            for s, e in pairwise(sorted({0, *cuts.tolist(), batch.num_rows})):
                part = batch.slice(s, e - s)
                texts = main_texts(part.column("html").to_pylist(), own)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = c.spread(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, `{url_col}` {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
