"""Queries over whole tables and texts, against brute force; the SQL of their kin covers less."""

import re

import numpy as np
import pytest

from lectern.operators import search
from lectern.queries import QUERIES, _headings

TEXTS = {1: "".join(chr(97 + i % 26) for i in range(1003)), 2: "  \u00e9\U0001f600 " * 60, 3: "", 4: None, 5: "x" * 40}


def test_lines_of_whole_texts(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text in TEXTS.items():
        lines = {}
        for i, ch in enumerate(text or "", 1):
            lines.setdefault(i // 40 * 10.0, []).append((i, ch))
        for top, chars in lines.items():
            sizes = [8.0 + i % 3 for i, _ in chars if i % 3]
            want[doc, top] = ("".join(ch for _, ch in chars).strip(), sum(sizes) / len(sizes) if sizes else 0.0, chars[0][0] * 5.0, chars[-1][0] * 5.0 + 5)
    got = {(r["book_id"], r["top"]): (r["text"], r["size"], r["x0"], r["x1"]) for r in QUERIES["line_group"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len([k for k in got if k[0] == 1]) == 26
    for k, (text, *numbers) in want.items():
        assert got[k][0] == text and got[k][1:] == pytest.approx(numbers, abs=1e-6)


@pytest.mark.parametrize("most", [10_000, 2])
def test_every_question_is_asked(spark, small, monkeypatch, most):
    monkeypatch.setattr(search, "QUESTIONS", most)
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    asked = [i for i, r in enumerate(rows) if r["vec_id"] % 100 == 0]
    assert len(asked) > 2
    for name, k, wanted in (("vector_topk", 10, lambda r: True), ("vector_topk_filtered", 5, lambda r: r["label"] == 3)):
        among = [i for i, r in enumerate(rows) if wanted(r)]
        want = {}
        for q in asked:
            best = sorted((-round(float(x[q] @ x[i]), 6), rows[i]["vec_id"]) for i in among)[:k]
            want |= {(rows[q]["vec_id"], rank): (i, pytest.approx(-s, abs=2e-6)) for rank, (s, i) in enumerate(best, 1)}
        assert {(r["qid"], r["rank"]): (r["chunk_id"], r["similarity"]) for r in QUERIES[name](spark, small).collect()} == want
    best = {}
    top = QUERIES["vector_topk"](spark, small).collect()
    for r in top:
        best[r["qid"]] = max(best.get(r["qid"], -1), r["similarity"])
    got = {(r["qid"], r["chunk_id"]): r["relevance_pct"] for r in QUERIES["relevance_pct"](spark, small).collect()}
    assert got == {(r["qid"], r["chunk_id"]): pytest.approx(r["similarity"] / best[r["qid"]] * 100, abs=0.051) for r in top}


BOOKS = {
    1: "Chapter 1: The Start\nsome plain words that go on for a while here\n  Chapter 2 Trees\n1.2 Title\nch. 7 - Leaves\nwords\nAppendix B\n3 - Foo\nPreface\n  Preface\nx\n12 Years a line\nIntroduction - why\n\nChapter 1: The Start",
    2: "no heading\n 4: Four\n 4: Four\nchapter nine\nPart of it\n2.1.3 Deep things in a book",
}
PATTERNS = [r"(?i)^(?:chapter|ch\.?)\s+(\d+)\b[:\s-]*(.*)$", r"^(\d+)[:\.\s-]+(.+)$", r"(?i)^(appendix|epilogue|introduction|preface|foreword)\b[:\s-]*(.*)$"]


def heading_level(text, size, median):
    number = next((m[1] for m in (re.search(p, text) for p in PATTERNS) if m), None) or next(iter(re.findall(r"^\d+(?:\.\d+)*", text)), None)
    if any(w in text.lower() for w in ("chapter", "appendix", "part")):
        return 1
    if number:
        return min(number.count(".") + 1, 3)
    return 1 if size > median * 1.5 else 2 if size > median * 1.2 else 3


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("books"))
    spark.createDataFrame(list(BOOKS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_all_headings_are_merged(spark, books):
    want = []
    for book, text in BOOKS.items():
        lines = text.split("\n")
        size = [10.0 + len(x) % 5 * 2 for x in lines]
        median = sorted(size)[len(size) // 2]
        chapter = lambda x: any(re.search(p, x) for p in PATTERNS)
        seen = set()
        for source in ("font", "pattern"):
            for pos, x in enumerate(lines):
                middle = len(x) % 7 * 40 + min(len(x), 80) * 5
                if source == "font":
                    ok = len(x) >= 3 and (size[pos] >= median * 1.2 or chapter(x) or (abs(middle - 600) / 600 < 0.2 and pos % 10 * 50 < 240))
                else:
                    ok, x = chapter(x.strip()), x.strip()
                key = (pos // 10, x.strip()[:50])
                if ok and key not in seen:
                    seen.add(key)
                    want.append((book, pos // 10 + 1, x, source, heading_level(x, *((size[pos], median) if source == "font" else (14.0, 12.0)))))
    got = [tuple(r)[:5] for r in QUERIES["heading_dedup"](spark, books).collect()]
    assert sorted(got) == sorted(want) and {"font", "pattern"} == {r[3] for r in got if re.match(r"(?i)\d|ch", r[2])}


def test_all_sections_know_their_ancestors(spark, books):
    def title(x):
        x = x.strip()
        if m := re.search(r"(?i)^(?:chapter|ch)\s+(\d+)\b[:\s-]*(.*)$", x):
            return (m[2] or x).strip()
        m = re.search(r"^(\d+(?:\.\d+)*)\s*[:\-\u2013\u2014]?\s*(.+)$", x)
        return m[2].strip() if m else x

    want, raw = [], []
    for book in BOOKS:
        above = {}
        for r in sorted((r for r in _headings(spark, books).collect() if r["book_id"] == book), key=lambda r: r["ord"]):
            n, name = r["level"], title(r["text"])
            want.append((book, r["ord"], name if n == 1 else above.get(1), name if n == 2 else above.get(2) if n == 3 else None, name if n == 3 else None))
            above[n] = name
            raw.append(r["text"])
    got = sorted(tuple(r) for r in QUERIES["section_ancestors"](spark, books).collect())
    assert got == sorted(want) and any(re.match(r"(?i)\d|ch", x) for x in raw)
    assert any(re.match(r"(?i)\d|ch", x or "") for r in got for x in r[2:])


def test_ask_agrees_with_brute_force(spark, small):
    """From pages to sources: nearest chunks of every document by cosine, then the heuristic score."""
    from pyspark.sql import functions as F

    from lectern.config import DEFAULT
    from lectern.functions.vectors import embed
    from lectern.plans.engine import Engine
    from lectern.queries import QUESTIONS

    made = []
    start = Engine.__init__
    try:
        Engine.__init__ = lambda self, *a, **k: (made.append(self), start(self, *a, **k))[1]
        got = {r["qid"]: r["sources"].split("|") for r in QUERIES["ask"](spark, small).collect()}
    finally:
        Engine.__init__ = start
    chunks = made[0].store.read().collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null")
    assert {c["book_id"] for c in chunks} == {r["doc_id"] for r in docs.collect()}
    x = np.array([c["embedding"] for c in chunks], np.float64)
    size = np.sqrt((x * x).sum(1))
    r = DEFAULT.retrieval
    asked = search.parse_questions(spark.createDataFrame(QUESTIONS, "qid long, raw_query string")).where("size(errors) = 0").withColumn("v", embed(DEFAULT.dimension)(F.col("raw_query"))).collect()
    assert {q["qid"] for q in asked} == set(got) and len(got) > 8
    for q in asked:
        v = np.array(q["v"], np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = np.round(x @ v / (size * np.sqrt(v @ v)), 6)
        near = sorted((-s, c["chunk_id"], c) for s, c in zip(sims.tolist(), chunks, strict=True) if s == s)[: r.top_k]
        scored = []
        for rank, (s, _, c) in enumerate(near):
            text = c["text"].lower()
            score = r.similarity * -s + r.topic * sum(w in text for w in q["topics"]) + r.keyword * sum(w in text for w in q["keywords"])
            score += r.code * (q["intent"] == "code_request" and c["contains_code"]) + r.text * (q["intent"] == "conceptual" and not c["contains_code"])
            scored.append((-round(min(score, 1.0), 6), rank, c["chunk_id"]))
        assert got[q["qid"]] == [c for _, _, c in sorted(scored)[: r.rerank_k]][: DEFAULT.answers.sources]
