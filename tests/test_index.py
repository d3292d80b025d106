"""Cells and postings against scans of everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import hashed_encoder
from lectern.operators import postings, search
from lectern.operators.cells import build_cells

VECTORS = "chunk_id long, embedding array<float>, label int"


def plain(rows, questions, k, keep=lambda label: True):
    out = []
    for q, v in questions:
        v = np.array(v, np.float64)
        sims = []
        for i, x, label in rows:
            if x and v.size and keep(label) and None not in x and np.isfinite(x).all() and np.any(x) and len(x) == len(v) and np.isfinite(v).all() and v.any():
                x = np.array(x, np.float32).astype(np.float64)
                sims.append((-round(float(v @ x / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), 6), i))
        out += [(q, i, r) for r, (_, i) in enumerate(sorted(sims)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["qid"], r["chunk_id"], r["rank"]) for r in df.collect())


def clustered(n, seed):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((20, 16))
    return [(i, (centres[i % 20] + 0.05 * pick.standard_normal(16)).astype(np.float32).tolist(), i % 3) for i in range(n)]


def test_cells_find_what_a_scan_finds_and_read_few(spark):
    rows = clustered(2000, 1) + [(3000 + i, [1.0] * 16, 0) for i in range(700)]
    questions = [(q, rows[q * 31][1]) for q in range(10)] + [(50, [1.0] * 16)]
    index = build_cells(spark.createDataFrame(rows, VECTORS).repartition(3), keep=("label",))
    asked = spark.createDataFrame(questions, "qid long, embedding array<float>")
    assert found(index.search(asked, 5)) == plain(rows, [(q, np.array(v, np.float32)) for q, v in questions], 5)
    assert 0 < index.read["cells"] < 0.7 * len(index.cell)
    index.search(asked.where("qid = 3"), 5)
    assert index.read["vectors"] < 0.25 * len(rows)
    assert found(index.search(asked, 7, F.col("label") == 1)) == plain(rows, [(q, np.array(v, np.float32)) for q, v in questions], 7, lambda x: x == 1)


def test_cells_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [float("nan"), 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 0), (None, [3.0, 0.0], 0), (10, [-1e30, 1e-30], 0)]
    index = build_cells(spark.createDataFrame(rows, VECTORS))
    asked = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "qid long, embedding array<float>")
    assert [(r["chunk_id"], r["similarity"]) for r in index.search(asked, 20).orderBy("rank").collect()] == [(None, 1.0), (1, 1.0), (9, 1.0), (9, 1.0), (2, 0.0), (10, -1.0)]
    none = build_cells(spark.createDataFrame([], VECTORS))
    assert none.search(asked, 3).collect() == []


def test_cells_agree_with_the_exact_search(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    one = build_cells(rows, chunk_id="vec_id").search(asked, 10)
    two = search.top_k(rows, asked, 10, "vec_id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_postings_count_what_a_scan_counts(spark, parts):
    r = random.Random(parts)
    letters = ["ab", "bc", "a", " ", "é", "A", "\n", "\U0001f600", "x.y"]
    texts = [(i, r.choice([None, "", "ab", "".join(r.choice(letters) for _ in range(r.randint(0, 60)))])) for i in range(300)]
    asked = [(q, r.choice([None, [], ["".join(r.choice(letters) for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 6))] + ["ab", "AB", None, "", "é", "nowhere"]])) for q in range(25)]
    docs = spark.createDataFrame(texts, "chunk_id long, text string").repartition(parts)
    questions = spark.createDataFrame(asked, "qid long, keywords array<string>")
    got = postings.keyword_counts(postings.build_postings(docs), docs, questions)
    want = {}
    for q, words in asked:
        for i, x in texts:
            n = sum(w.lower() in x.lower() for w in words or [] if w is not None) if x is not None else 0
            if n:
                want[q, i] = n
    assert {(x["qid"], x["chunk_id"]): x["n"] for x in got.collect()} == want


@pytest.mark.parametrize("small_parts", [False, True])
def test_keyword_counts_send_no_pairs(spark, monkeypatch, small_parts):
    """Pairs of questions and texts are made in the last step, and nothing of their number is shuffled; texts of equal
    ids add up, runs longer than those whose parts are listed are looked into, and no index is needed."""
    if small_parts:
        for name, value in (("ENTRIES", 7), ("ROWS", 3), ("TERM", 4)):
            monkeypatch.setattr(postings, name, value)
    texts = [(1, "Harbour and sail"), (1, "harbours"), (2, None), (3, ""), (4, "x" * 100 + "harbour sail_1"), (5, "a.b c"), *((i, f"sail word{i}") for i in range(6, 40))]
    asked = [(q, ["harbour", "Sail", f"word{q}", f"word{q}", "a.b", "our", "or"][: q % 8]) for q in range(30)] + [(99, ["nowhere"])]
    got = postings.keyword_counts(None, spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(asked, "qid long, keywords array<string>"))
    want = {}
    for q, words in asked:
        for i, x in texts:
            n = sum(w.lower() in x.lower() for w in words) if x is not None else 0
            if n:
                want[q, i] = want.get((q, i), 0) + n
    assert sorted(map(tuple, got.collect())) == sorted((*k, n) for k, n in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.partition("Exchange")[0]


def test_postings_meet_few_texts(spark, small):
    """Of all pairs of words and documents, the candidates are few, and most of them are hits."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = spark.createDataFrame([("license",), ("apache",), ("zzzzqq",), ("version",)], "word string")
    index = postings.build_postings(docs, id_col="doc_id")
    met = postings.candidates(index, words).count()
    hits = postings.containing(index, docs, words, "doc_id").count()
    want = sum(w in (r["text"] or "").lower() for r in docs.collect() for w in ("license", "apache", "zzzzqq", "version"))
    assert hits == want <= met < 0.7 * 4 * docs.count()


def test_encoder_is_the_loop():
    import re
    import zlib

    texts = ["One two, two THREE", "", None, "é ß 日本 one", "one " * 50]
    out = np.zeros((5, 32), np.float32)
    for i, x in enumerate(texts):
        for w in re.findall(r"\w+", (x or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % 32] += 1 if h >> 31 else -1
    want = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    assert (hashed_encoder(32)(texts) == want).all() and hashed_encoder(32)([]).shape == (0, 32)
