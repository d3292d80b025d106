"""The trained embedding against numpy's singular value decomposition."""

import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from lectern.config import DEFAULT
from lectern.operators import latent
from lectern.plans.engine import Engine
from lectern.queries import QUERIES


def dense(texts, size):
    counts = [Counter(zlib.crc32(w.encode()) % size for w in re.findall(r"[^\W_]+|_+", (t or "").lower()) if w) for t in texts]
    seen = Counter(f for x in counts for f in x)
    out = np.zeros((len(texts), size))
    for i, x in enumerate(counts):
        for f, n in x.items():
            out[i, f] = (1 + np.log(n)) * np.log1p(len(texts) / seen[f])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")


def test_directions_are_those_of_numpy(documents):
    a = dense([r["text"] for r in documents.collect()], 1 << 11)
    want = np.linalg.svd(a, full_matrices=False)
    got = latent.fit(documents, dimension=6, size=1 << 11, rounds=20)
    assert np.allclose(got.values, want.S[:6], rtol=1e-6)
    assert np.allclose(got.directions.T @ got.directions, np.eye(6), atol=1e-9)
    leading = int(np.flatnonzero(want.S[:6] / want.S[1:7] > 1.01).max()) + 1  # a subspace is one only where a gap ends it
    assert np.allclose(np.linalg.svd(want.Vh[:leading] @ got.directions[:, :leading])[1], 1, atol=1e-4)


def test_query_holds_what_the_best_directions_hold(spark, small, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    a = dense(list(rows.values()), 1 << 14)
    s = np.linalg.svd(a, compute_uv=False)
    model = latent.fit(documents)
    kept = ((a @ model.directions) ** 2).sum()
    assert 0.99 * (s[:64] ** 2).sum() <= kept <= (s[:64] ** 2).sum() * (1 + 1e-9)
    want = a @ model.directions
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = {r["doc_id"]: r["embedding"] for r in QUERIES["latent_embeddings"](spark, small).collect()}
    assert list(got) and set(got) == set(rows)
    assert np.allclose([got[k] for k in rows], want, atol=1e-4)


def test_words_of_one_subject_are_near(spark, tmp_path):
    """boat and ship never share a text; both come with harbour and sail."""
    sea, land = ["harbour", "sail", "captain", "wave"], ["tractor", "field", "plough", "barn"]
    r = np.random.default_rng(3)
    texts = [" ".join([*r.choice(words, 6), *([first] * 2)]) for words, firsts in ((sea, ["boat", "ship"]), (land, ["cow", "horse"])) for first in firsts for _ in range(40)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "boat " * 100_000])], "id long, text string")
    model = latent.fit(table, dimension=2, size=4096)
    v = model.encode([np.array([zlib.crc32(w.encode()) % 4096]) for w in ("boat", "ship", "cow", "horse", "never")])
    assert v[0] @ v[1] > 0.95 and v[2] @ v[3] > 0.95 and abs(v[0] @ v[2]) < 0.3 and not v[4].any()
    model.save(spark, str(tmp_path / "m"))
    again = latent.Latent.load(spark, str(tmp_path / "m"))
    assert all(np.array_equal(getattr(again, k), getattr(model, k)) for k in ("idf", "directions", "values"))
    got = {x["id"]: x["e"] for x in table.select("id", again.embed(table["text"]).alias("e")).collect()}
    assert not any(got[len(texts)]) and not any(got[len(texts) + 1]) and np.linalg.norm(got[len(texts) + 2]) == pytest.approx(1)
    assert np.array_equal(latent.fit(table, dimension=2, size=4096).directions, model.directions)


@pytest.mark.parametrize("dense", [1, 64 << 20])
def test_words_of_texts_are_found_once(spark, monkeypatch, dense):
    """Texts that are learned from and embedded are read once, as counted features, whatever stands between their words."""
    monkeypatch.setattr(latent, "DENSE", dense)
    texts = [None, "", "  ", "--", "a", "A b_1 a\tb", " é É\u00a0日本 x² ", "\n\U0001d7d8 c a!", "İstanbul ΑΣ", *(f"word{i} word{i % 7} a" for i in range(40))]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r["id"]: Counter(r["f"]) for r in table.select("id", latent.features(table["text"], 256).alias("f")).collect()}
    counted = latent.term_counts(table, size=256, keep=("id",))
    got = {r["id"]: dict(zip(np.frombuffer(bytes(r["ids"]), np.int32).tolist(), np.frombuffer(bytes(r["counts"]), np.int32).tolist(), strict=True)) for r in counted.collect()}
    assert got == want
    found = latent.fit_embed(table, keep=("id",), dimension=4, size=256, rounds=2)
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    other = latent.fit(table, dimension=4, size=256, rounds=2)
    again = {r["id"]: r["e"] for r in table.select("id", other.embed(table["text"]).alias("e")).collect()}
    assert all(np.allclose(r["embedding"], again[r["id"]], atol=1e-6) for r in found.collect()) and found.dtypes == [("id", "bigint"), ("embedding", "array<float>")]


def test_empty_table_and_more_directions_than_rank(spark):
    empty = spark.createDataFrame([], "id long, text string, ids int, feature string, block int")
    assert not latent.fit(empty, dimension=3, size=256, rounds=1).directions.any()
    one = latent.fit(spark.createDataFrame([("a b",), ("a b",)], "text string"), dimension=300, size=256, rounds=2)
    assert one.directions.shape == (256, 300) and (one.values > 1e-6).sum() == 1 and np.count_nonzero(np.abs(one.directions).max(0) > 0) == 1


def test_engine_learns(spark, tmp_path):
    pages = spark.createDataFrame([(b, 1, t, 600.0, 800.0) for b, t in ((1, "The boat left the harbour under sail."), (2, "The tractor left the field by the barn."))], "book_id long, page int, text string, width double, height double")
    engine = Engine(spark, str(tmp_path / "store"), replace(DEFAULT, dimension=16))
    engine.learn(pages, path=str(tmp_path / "model"))
    engine.ingest(pages, spark.createDataFrame([(1, "Sea", "x"), (2, "Farm", "y")], "book_id long, book_title string, author string"))
    got = engine.ask(spark.createDataFrame([(1, "Where is the harbour for a boat?")], "qid long, raw_query string")).select("response.answer").collect()
    assert "harbour" in got[0][0]
