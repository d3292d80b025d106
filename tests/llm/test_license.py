"""The license scan against plain regular expressions and a recursive evaluation."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.license_scan import BASE, NOTICES, Scanner, expression, license_places, scan_licenses
from lectern.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")


def base_row(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in BASE.items() for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def notices(text):
    """Labels of notices and base phrases that no longer phrase holds."""
    words = WORD.findall(lower(text))
    found = [(i, i + len(p.split()), p) for p in {*NOTICES, *BASE} for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    held = {x for x in found for y in found if x[1] - x[0] < y[1] - y[0] and y[0] <= x[0] and x[1] <= y[1]}
    return {NOTICES[x[2]] for x in found if x not in held and x[2] in NOTICES and x[2] not in BASE} | {BASE[x[2]] for x in found if x[2] in BASE}


TEXTS = [
    None, "", " \n", "Released under the MIT License.", "UNDER-THE_MIT license under the mit\tLicense", "licensed under the apache license, version 2.0 or CC BY-NC", "cc by nc cc by nc sa", "under the mit licenseX", "élan under the mit license", "Apache License", "cc by",
    "gnu general public license version 3 gnu general public license", "licenses by", "mit license 0", "x" * 100_000 + " under the mit license " * 1000,
]


def test_rows_equal_brute_force(spark, small):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        text = TEXTS[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_row(text), text
        assert r["labels"] == ",".join(sorted(notices(text))), text
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and (r["permission"] is None) == (not r["labels"])
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op11_license_scan"](spark, small).collect()
    assert len(rows) == len(whole)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_row(whole[r["doc_id"]])
        assert set(filter(None, r["labels"].split(","))) == notices(whole[r["doc_id"]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" ".join([*BASE, *NOTICES]).split(), "X", "é", "-", "\n"]), max_size=30))
def test_automaton_on_any_words(words):
    text = " ".join(words)
    n, places = Scanner(BASE, NOTICES, []).places(text.encode())
    places = list(places)
    want = base_row(text)
    at = [p.word for p in places if p.kind == "base"]
    assert (n, len(at), min(at, default=None), max(at, default=None)) == want[:4]
    assert {x for p in places for x in p.terms.labels} == notices(text)


@pytest.mark.parametrize(
    ("text", "words", "permission"),
    [
        ("MIT", "mit", 1.0), ("GPL-2.0-only OR MIT AND AGPL-3.0", "(gpl-2 or (mit and agpl-3))", 0.4), ("(GPL-2.0 OR MIT) AND AGPL-3.0", "((gpl-2 or mit) and agpl-3)", 0.3), ("gpl-2.0-or-later with classpath-exception-2.0 and mit", "(gpl-2+-with-classpath-exception-2.0 and mit)", 0.7),
        ("MIT and then some", "mit", 1.0), ("MIT AND (", "mit", 1.0), ("MIT AND (GPL-3.0 OR", "(mit and gpl-3)", 0.4), ("((CC-BY-NC-4.0", "cc-by-nc", 0.2), ("MIT) OR GPL-2.0", "mit", 1.0), ("(MIT) WITH some-exception", "mit", 1.0), ("LicenseRef-Own or MIT", "(licenseref-own or mit)", 1.0),
        ("MIT WITH MIT", "mit", 1.0), ("GPL-3.0+ OR GPL-3.0+", "(gpl-3+ or gpl-3+)", 0.4),
    ],
)
def test_expressions(text, words, permission):
    found = expression(text.encode())
    assert (found.words, found.permission) == (words, permission)


def test_no_expression():
    assert [expression(x) for x in (b"", b"nothing", b"(", b"and mit", b")mit")] == [None] * 5


def test_random_expressions():
    """Against a recursive evaluation of fully bracketed trees, written without needless brackets."""
    free = {"mit": 1.0, "gpl-2": 0.4, "agpl-3": 0.3, "lgpl-2": 0.7}
    pick = random.Random(5)

    def tree(depth):
        if depth == 0 or pick.random() < 0.3:
            return pick.choice(list(free))
        return pick.choice(["and", "or"]), tree(depth - 1), tree(depth - 1)

    def text(t, above=0):
        if isinstance(t, str):
            return t
        own = 2 if t[0] == "and" else 1
        out = f"{text(t[1], own)} {t[0].upper()} {text(t[2], own + 0.5)}"
        return f"({out})" if own < above else out

    value = lambda t: free[t] if isinstance(t, str) else (max if t[0] == "or" else min)(value(t[1]), value(t[2]))
    said = lambda t: t if isinstance(t, str) else f"({said(t[1])} {t[0]} {said(t[2])})"
    for t in [tree(5) for _ in range(300)]:
        found = expression(text(t).encode())
        assert (found.words, found.permission) == (said(t), value(t))


def test_long_expressions_are_linear():
    assert expression(b"MIT OR " * 100_000).labels == {"mit"}
    assert expression(b"(" * 100_000 + b"mit" + b")" * 100_000).words == "mit"


def test_tags_and_places(spark):
    texts = ["# SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0)\nmit", '"license" : "BSD-3-Clause",', "the license: nothing known", "License = AGPL-3.0\nLICENSE: MIT", "license MIT"]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, texts[0], "c")] * 2, "doc_id long, text string, labels string")
    rows = [(r["doc_id"], r["labels"], r["expressions"], r["permission"]) for r in scan_licenses(docs).collect()]
    first = ("apache-2,gpl-2,mit", "(mit or (apache-2 and gpl-2))", 1.0)
    assert sorted(rows, key=str) == sorted([(0, *first), (1, "bsd-3-clause", "bsd-3-clause", 1.0), (2, "", "", None), (3, "agpl-3,mit", "agpl-3; mit", 0.3), (4, "", "", None), (None, *first), (None, *first)], key=str)
    places = license_places(docs).where("doc_id = 3").orderBy("word").collect()
    assert [(p["word"], p["kind"], p["phrase"], p["expression"]) for p in places] == [(0, "tag", "license", "agpl-3"), (4, "tag", "license", "mit")]
    assert scan_licenses(docs.where("false")).count() == 0


def test_own_phrases(spark):
    docs = spark.createDataFrame([(1, "Do what you like with it")], "doc_id long, text string")
    r = scan_licenses(docs, base={"what you like": "free"}, notices={}, tags=[]).first()
    assert (r["n_base"], r["first_word"], r["labels"]) == (1, 1, "free")
