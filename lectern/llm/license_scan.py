"""License scans: an Aho-Corasick automaton over the words of a text, and a shunting-yard parser.

A-Z are lower-cased; words are runs of digits, letters a-z and everything beyond ASCII. One pass of the
automaton finds every place where the words of a phrase stand consecutively:

- base phrases, each with its label; all their places count, overlapping ones too;
- notices, which name a licence in prose; one that lies inside a longer phrase doesn't count;
- tags ("SPDX-License-Identifier", "license", ...) before a colon or an equals sign. What follows, up to
  the end of the line, is parsed as a licence expression with the operators and, or, with (which binds
  most) and parentheses, until something comes that the grammar or the list of licences doesn't know.
  Operators without a right side are left out, open parentheses close at the end. A tag that no known
  licence follows says nothing.

An expression is evaluated twice: to its labels (those of both sides; a licence with an exception is a
label of its own), and to its permission, from 0 (all rights reserved) to 1 (permissive): the better
side of an or, the worse of an and; an exception halves what is missing. The permission of a text is
the least of all that it states, as all of it holds; null where it states nothing. The score is the
confidence that a licence is stated: 1 less the product of the doubts of all distinct phrases and
expressions; 0 without any.

Null and empty texts have no words and no labels. Repeated rows and rows without an id are rows of
their own. Extra columns are ignored. A text is worked on whole, with memory in proportion to it; rows
don't move, so hot ids don't matter."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as c

#: The agreed phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licence identifiers without version, and how freely each may be used. Identifiers of families with
#: versions keep the major one in their label; Creative Commons identifiers lose theirs.
PERMISSION = {
    "mit": 1.0, "mit-0": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "cc0": 1.0, "cc-by": 0.9, "bsl": 1.0, "python": 1.0, "psf": 1.0, "postgresql": 1.0,
    "x11": 1.0, "ncsa": 1.0, "artistic": 0.8, "public-domain": 1.0, "lgpl": 0.7, "mpl": 0.7, "epl": 0.7, "cddl": 0.7, "ms-pl": 0.7, "ofl": 0.7, "cc-by-sa": 0.6, "gfdl": 0.5, "gpl": 0.4, "agpl": 0.3, "osl": 0.4, "eupl": 0.4, "sspl": 0.2, "busl": 0.2,
    "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nd": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}
#: Permission of licences that only have a name of the document's own.
OWN_NAME = 0.3

#: Phrases that name a licence in prose.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "mit license": "mit",
    "apache license": "apache", "apache license version 2": "apache-2", "apache license version 2 0": "apache-2", "apache 2 0 license": "apache-2",
    "redistribution and use in source and binary forms": "bsd", "bsd 2 clause license": "bsd-2-clause", "bsd 3 clause license": "bsd-3-clause", "bsd license": "bsd",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu gpl v2": "gpl-2", "gnu gpl v3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu lesser general public license version 2": "lgpl-2", "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl", "gnu affero general public license version 3": "agpl-3", "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2", "eclipse public license": "epl", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl", "sil open font license": "ofl",
    "this is free and unencumbered software released into the public domain": "unlicense", "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain",
    "cc0 1 0 universal": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "creativecommons org licenses by": "cc-by", "creativecommons org licenses by sa": "cc-by-sa", "creativecommons org licenses by nd": "cc-by-nd", "creativecommons org licenses by nc": "cc-by-nc", "creativecommons org licenses by nc sa": "cc-by-nc-sa", "creativecommons org licenses by nc nd": "cc-by-nc-nd",
    "creativecommons org publicdomain zero": "cc0",
}
TAGS = ["spdx license identifier", "license expression", "license", "licence"]

#: How much a sign of each kind is trusted.
TRUST = {"tag": 0.95, "base": 0.9, "notice": 0.7}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAPS = re.compile(rb" {2,}")
_LEAD = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+-]+)")
_PARTS = re.compile(r"(?P<family>[a-z0-9-]*?[a-z0-9])(?:-v?(?P<major>\d+)(?:\.\d+)*)?(?P<later>-only|-or-later|\+)?")


# --- expressions ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Terms:
    """What an expression says: in words, which labels it names, how freely the text may be used."""

    words: str
    labels: frozenset[str]
    permission: float


@lru_cache(4096)
def licence(identifier: str) -> Terms | None:
    """Of a lower-case identifier ("gpl-2.0-or-later", "apache-2.0", "licenseref-own"); None if unknown."""
    if identifier.startswith("licenseref-") and len(identifier) > 11:
        return Terms(identifier, frozenset([identifier]), OWN_NAME)
    if identifier in PERMISSION:
        return Terms(identifier, frozenset([identifier]), PERMISSION[identifier])
    m = _PARTS.fullmatch(identifier)
    if not m or m["family"] not in PERMISSION:
        return None
    label = m["family"] if m["major"] is None or m["family"].startswith("cc") else f"{m['family']}-{m['major']}"
    label += "+" if m["later"] in ("-or-later", "+") else ""
    return Terms(label, frozenset([label]), PERMISSION[m["family"]])


STRENGTH = {"or": 1, "and": 2, "with": 3}


class _Side:
    """A part of an expression while it is parsed; joined parts share one set and one tree."""

    def __init__(self, tree: object, labels: set[str], permission: float) -> None:
        self.tree, self.labels, self.permission = tree, labels, permission


def _joined(op: str, a: _Side, b: _Side) -> _Side:
    if op == "with":
        label = f"{a.tree}-with-{b.tree}"
        return _Side(label, {label}, (1 + a.permission) / 2)
    large, few = (a.labels, b.labels) if len(a.labels) >= len(b.labels) else (b.labels, a.labels)
    large |= few
    return _Side((op, a.tree, b.tree), large, (max if op == "or" else min)(a.permission, b.permission))


def _written(tree: object) -> str:
    parts, left = [], [tree]
    while left:
        x = left.pop()
        if isinstance(x, tuple):
            left += [")", x[2], f" {x[0]} ", x[1], "("]
        else:
            parts.append(x)
    return "".join(parts)


def expression(text: bytes, at: int = 0) -> Terms | None:
    """Terms of the licence expression at a byte of a text; None if it has none.

    Shunting-yard: operands go out, operators wait until a weaker one, a closing parenthesis or the end.
    Every operator is applied when it goes out, so nothing is kept but what waits."""
    out: list[_Side] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        right, left = out.pop(), out.pop()
        out.append(_joined(op, left, right))

    wants, simple = "licence", False  # simple: the last operand is one licence, so that "with" may follow
    while m := _TOKEN.match(text, at):
        token = m[1].decode().lower()
        if wants == "licence":
            if token == "(":
                waiting.append(token)
            elif found := licence(token.rstrip(".-")):
                out.append(_Side(found.words, set(found.labels), found.permission))
                wants, simple = "operator", True
            else:
                break
        elif wants == "exception":
            token = token.rstrip(".-")
            if not re.search("exception|linking", token):
                break
            out.append(_Side(token, set(), 0.0))
            wants, simple = "operator", False
        elif token == ")":
            if "(" not in waiting:
                break
            while (op := waiting.pop()) != "(":
                apply(op)
            simple = False
        elif token in STRENGTH and (simple or token != "with"):
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[token]:
                apply(waiting.pop())
            waiting.append(token)
            wants = "exception" if token == "with" else "licence"
        else:
            break
        at = m.end()
    while waiting and wants != "operator":  # an operator without a right side, and parentheses opened after it
        if waiting.pop() != "(":
            break
    while waiting:
        if (op := waiting.pop()) != "(":
            apply(op)
    return Terms(_written(out[0].tree), frozenset(out[0].labels), out[0].permission) if out else None


# --- the automaton ----------------------------------------------------------------------------


class Phrase(NamedTuple):
    words: str
    size: int
    base: str | None
    notice: str | None
    tag: bool


class Place(NamedTuple):
    """A sign of a licence: its first word, kind, words, and terms."""

    word: int
    kind: str
    words: str
    terms: Terms


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: list[str]) -> None:
        import ahocorasick

        self.automaton, self.longest = ahocorasick.Automaton(), 0
        self.base = base
        for words in {*base, *notices, *tags}:
            size = words.count(" ") + 1
            self.longest = max(self.longest, size)
            self.automaton.add_word(f" {words} ", Phrase(words, size, base.get(words), notices.get(words), words in tags))
        self.automaton.make_automaton()
        self.terms = {x: licence(x) or Terms(x, frozenset([x]), OWN_NAME) for x in {*base.values(), *notices.values()}}

    def places(self, raw: bytes) -> tuple[int, Iterator[Place]]:
        """Number of words, and places in an order that depends on the text alone."""
        folded = raw.translate(_FOLD)
        line = _GAPS.sub(b" ", b" " + folded + b" ").decode("latin-1")
        return max(0, line.count(" ") - 1), self._found(raw, folded, line)

    def _found(self, raw: bytes, folded: bytes, line: str) -> Iterator[Place]:
        at = words = 0
        ends: np.ndarray | None = None
        open_: list[tuple[int, int, Phrase]] = []  # notices that a longer phrase may yet hold
        for end, phrase in self.automaton.iter(line):
            words += line.count(" ", at, end)
            at, first = end, words - phrase.size
            if phrase.base:
                yield Place(first, "base", phrase.words, self.terms[phrase.base])
            if phrase.base or phrase.notice:
                done = [x for x in open_ if x[1] <= words - self.longest]
                open_ = [x for x in open_ if x[1] > words - self.longest and not (first <= x[0] and x[1] <= words and x[2].size < phrase.size)]
                if not any(s <= first and words <= e and p.size > phrase.size for s, e, p in open_):
                    open_.append((first, words, phrase))
                yield from (Place(s, "notice", p.words, self.terms[p.notice]) for s, _, p in done if p.notice and not p.base)
            if phrase.tag:
                if ends is None:
                    ends = np.flatnonzero(np.diff(np.frombuffer(folded + b" ", np.uint8) == 32).astype(bool) & (np.frombuffer(folded, np.uint8) != 32)) + 1
                lead = _LEAD.match(raw, int(ends[words - 1]))
                if lead and (terms := expression(raw, lead.end())):
                    yield Place(first, "tag", phrase.words, terms)
        yield from (Place(s, "notice", p.words, self.terms[p.notice]) for s, _, p in open_ if p.notice and not p.base)


_scanners: dict[str, Scanner] = {}


def _scanner(base: dict[str, str], notices: dict[str, str], tags: list[str]) -> Scanner:
    """One automaton for each set of phrases and Python worker."""
    key = repr((base, notices, tags))
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(base, notices, tags)
    return _scanners[key]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    raw, at = c.text_of(batch.column("text"))
    for s, e in zip(at[:-1], at[1:], strict=True):
        yield raw[s:e].tobytes()


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, permission double, score double"


def _summary(n_words: int, places: Iterable[Place]) -> tuple:
    n_base, first, last, permission = 0, None, None, None
    base: set[str] = set()
    labels: set[str] = set()
    signs: set[tuple[str, str]] = set()
    for p in places:
        if p.kind == "base":
            n_base += 1
            first, last = p.word if first is None else min(first, p.word), p.word if last is None else max(last, p.word)
            base |= p.terms.labels
        labels |= p.terms.labels
        permission = p.terms.permission if permission is None else min(permission, p.terms.permission)
        signs.add((p.kind, p.terms.words if p.kind == "tag" else p.words))
    doubt = 1.0
    for kind, _ in sorted(signs):
        doubt *= 1 - TRUST[kind]
    told = "; ".join(sorted(x for kind, x in signs if kind == "tag"))
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), told, permission, 1 - doubt


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """A row for each document: id_col, n_words; n_base, first_word and last_word of the base phrases'
    places; base_labels and labels (distinct, sorted, comma-joined); expressions (those of tags, distinct,
    sorted, joined by "; "); permission; score."""
    phrases = BASE if base is None else base, NOTICES if notices is None else notices, TAGS if tags is None else tags
    rows = c.spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = [x.split() for x in FIELDS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*phrases)
        for batch in batches:
            found = [_summary(*scanner.places(raw)) for raw in _texts(batch)]
            columns = [pa.array([r[k] for r in found], types[kind]) for k, (_, kind) in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], [id_col, *(name for name, _ in schema)])
        c.tidy()

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, {FIELDS}")


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """A row for each sign of a licence: id_col, word (where it begins, from 0), kind (base, notice or
    tag), phrase, expression (as parsed), labels, permission."""
    phrases = BASE if base is None else base, NOTICES if notices is None else notices, TAGS if tags is None else tags
    rows = c.spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*phrases)
        for batch in batches:
            for i, raw in enumerate(_texts(batch)):
                held: list[Place] = []
                for p in scanner.places(raw)[1]:
                    held.append(p)
                    if len(held) == 10_000:
                        yield out(batch, i, held)
                        held = []
                if held:
                    yield out(batch, i, held)

    def out(batch: pa.RecordBatch, i: int, held: list[Place]) -> pa.RecordBatch:
        ids = batch.column("id").take(pa.array([i] * len(held)))
        columns = [pa.array([p.word for p in held], pa.int64()), pa.array([p.kind for p in held]), pa.array([p.words for p in held]), pa.array([p.terms.words for p in held]), pa.array([sorted(p.terms.labels) for p in held], pa.list_(pa.string())), pa.array([p.terms.permission for p in held])]
        return pa.RecordBatch.from_arrays([ids, *columns], [id_col, "word", "kind", "phrase", "expression", "labels", "permission"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, word long, kind string, phrase string, expression string, labels array<string>, permission double")
