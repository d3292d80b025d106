"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, cotraining, flac, html_crf, jaccard_join, maxent_lm, mixing, sharding, token_files, vector_forest
from lectern.llm import common as c
from lectern.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words here " * 20_000
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, "same text for two", "en", "a", 17), (4, "same text for two", "en", "b", 17), (5, LONG, "en", None, len(LONG)),
    (6, "x", "de", "b", 1), (7, " \t\n ", "de", "a", 4), (8, "é" * 3000, "fr", "c", 3000), (8, "é" * 3000, "fr", "c", 3000), (None, "no id here", "en", "a", 10), (9, "one two three four five six", "en", "a", 27),
]
CLASH = ["id", "grp", "row", "kind", "bucket", "blob", "size", "n", "k", "key", "shard", "task", "score", "kept", "taken", "label", "y", "h", "range", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (9, 1, 0), (6, 0, 1), (None, 1, 0), (5, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_jaccard(docs, empty):
    found = jaccard_join.jaccard_join(docs).collect()
    rows = {r["doc_id"]: r for r in found}
    assert len(found) == len(ROWS) and set(rows) == {*range(1, 10), None}
    assert [(r["component_id"], r["n_links"]) for r in found if r["doc_id"] == 8] == [(8, 1)] * 2 and rows[None]["component_id"] is None
    assert [rows[i]["n_shingles"] for i in (1, 2, 7, 6, 9)] == [0, 0, 0, 1, 4]
    assert rows[4]["component_id"] == 3 and rows[3]["n_links"] == 1 and rows[1]["component_id"] == 1
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_without_ids(spark):
    """Rows without an id link like others; two texts of an id are two documents."""
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "A b c d"), (9, "x y z"), (9, "p q r s"), (None, "p q r s"), (None, "only here it is"), (None, "only here it is")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("7", 2, "7", 2), ("9", 1, "9", 0), ("9", 2, "9", 1), ("None", 2, "7", 2), ("None", 2, "7", 2), ("None", 2, "9", 1), ("None", 2, "None", 1), ("None", 2, "None", 1)]


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).docs.collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 7)} == {0}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).docs.collect()))
    assert mixing.mix_sources(empty).docs.count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(ROWS) and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert len({r["shard"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert sharding.shard(empty).count() == 0


def test_bpe(docs, empty):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = bpe.bpe_round_trip(docs, path).collect()
    assert len(rows) == len(ROWS) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe.bpe_round_trip(empty, path).count() == 0 and bpe.bpe_encode(docs, path).where("size(ids) = 0").count() == 2


def test_token_files(spark, docs, empty):
    for table, n in ((docs, len(ROWS)), (empty, 0)):
        at = shared_dir(spark)
        rows = token_files.read_tokens(token_files.write_tokens(table, vocabulary("word_bpe_49k.json"), at), at).collect()
        assert len(rows) == n
        if n:
            assert min(rows, key=lambda r: r["start"])["doc_id"] is None and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1}


def test_flac(docs, empty):
    rows = flac.digests(flac.encode_column(docs)).collect()
    assert len(rows) == len(ROWS) and {r["payload_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {64} and all(r["error"] is None for r in rows)
    assert flac.digests(flac.encode_column(empty)).count() == 0


def test_maxent(docs, empty):
    model = maxent_lm.train(docs)
    rows = maxent_lm.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r["score"] < 0 for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1}
    assert maxent_lm.score(empty, model).count() == 0
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in maxent_lm.score(docs, maxent_lm.train(empty)).collect())


def test_maxent_rows_are_averaged_by_the_events_that_touched_them():
    parts = [([0, 2], [10, 1], [[1, 1], [4, 4]]), ([1, 2], [30, 3], [[3, 5], [8, 0]])]
    batches = [maxent_lm._block([7], [(np.array(r, np.int32), np.array(n), np.array(w, np.float32))]) for r, n, w in parts]
    (got,) = maxent_lm._average(2)(batches)
    read = lambda name, kind: np.frombuffer(got.column(name)[0].as_py(), kind).tolist()
    assert read("rows", np.int32) == [0, 1, 2] and read("n", np.int64) == [10, 30, 4] and read("blob", np.float32) == [1, 1, 3, 5, 7, 1]


def test_maxent_table_grows_with_the_words(spark):
    words = spark.range(700).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string")))).alias("text"))
    model = maxent_lm.train(words)
    assert model.v == 70_001 and model.bits == 17 and len(model.weights.value) == 1 << 17
    assert maxent_lm.train(words.limit(3)).bits == 15 and maxent_lm.train(words, most_bits=16).bits == 16


def test_cotraining(docs, empty, labels):
    rows = cotraining.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert cotraining.classify(empty, labels).count() == 0
    assert all(r["kept"] and r["score"] == 1 for r in cotraining.classify(docs, labels.where("quality = 1")).collect())
    assert all(r["kept"] for r in cotraining.classify(docs, labels.where("false")).collect())


def test_cotraining_learns_from_every_unlabelled_document(spark):
    n = 7600
    rows = spark.range(n).withColumn("at", F.expr("row_number() over (order by xxhash64(id), id)"))
    bad = (F.col("id") % 4 == 0) | (F.col("at") > 7400)
    docs = rows.select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("at") > 7400, "## $$ ## lateword").when(bad, "## $$ ## !! junk ??").otherwise("some plain words of a text"), F.lit(" "), F.col("id") % 7).alias("text"), F.when(bad, "xx").otherwise("en").alias("lang"), F.when(bad, "dump").otherwise("book").alias("source"), F.lit(30).alias("n_chars"), "at", bad.alias("bad"))
    labels = docs.where("at <= 1200").select("doc_id", (~F.col("bad")).cast("int").alias("quality"))
    fitted = cotraining.fit(docs.withColumnRenamed("doc_id", "id"), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")))
    _, words, _ = cotraining.text_numbers(*c.text_of(pa.array(["lateword"])))
    assert fitted.text[cotraining.BINS * fitted.views.edges.shape[0] + int(words[0])] < 0


def test_cotraining_gradient_is_that_of_all_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(None).cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("h"), "text", "lang", "source", "n_chars")
    pool = rows.repartition(3).mapInArrow(cotraining._features, "id long, y int, h long, numbers binary, words binary, meta binary").drop("id", "y").cache()
    r = np.random.default_rng(3)
    views = cotraining.Views(np.sort(r.random((15, 10)), 1))
    models, points = ([r.standard_normal(w + 1) for w in views.widths] for _ in range(2))
    history = [(models, [np.array([3.0, 0.0])] * 2, [[(0, 1.0), (40, 0.5)], [(10, 0.3), (0, 1.0)]])]
    got = cotraining._sum(pool, cotraining._pooled(history, views, points), sum(2 * (len(w) + 2) for w in points))
    parts = [p for batch in pool.toArrow().combine_chunks().to_batches() for p in cotraining._parts(batch)]
    assert got == pytest.approx(sum(cotraining._pooled(history, views, points)(p) for p in parts), abs=1e-9)
    assert got[0] + got[len(points[0]) + 2] > 0
    # The slope of the loss along a direction, by differences.
    step = 1e-5 * r.standard_normal(len(points[0]))
    loss = [cotraining._sum(pool, cotraining._pooled(history, views, [points[0] + k * step, points[1]]), len(got))[1] for k in (-1, 1)]
    assert loss[1] - loss[0] == pytest.approx(2 * float(got[2 : len(points[0]) + 2] @ step), rel=1e-4)


def test_cotraining_rounds_label_the_surest(spark, small):
    """One exchange against a plain version: each view labels, of either kind, the documents that the other
    is surest of."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(None).cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("h"), "text", "lang", "source", "n_chars")
    pool = rows.repartition(3).mapInArrow(cotraining._features, "id long, y int, h long, numbers binary, words binary, meta binary").drop("id", "y").cache()
    r = np.random.default_rng(4)
    views = cotraining.Views(np.sort(r.random((15, 10)), 1))
    models, scales = [r.standard_normal(w + 1) for w in views.widths], [np.array([2.0, 0.1]), np.array([3.0, -0.2])]
    sure = cotraining._sum(pool, cotraining._sure([], (models, scales), views), 4 * cotraining.STRENGTHS).reshape(2, 2, cotraining.STRENGTHS)
    most = 25
    cuts = [[cotraining._cut(sure[v, k], most) for k in (0, 1)] for v in (0, 1)]
    for batch in pool.toArrow().combine_chunks().to_batches():
        given, logits = [[], []], [[], []]
        for h, numbers, words, begin, meta in cotraining._parts(batch):
            for i in range(len(h)):  # document by document, view by view
                w = words[begin[i] : begin[i + 1]]
                bins = [int((edge <= x).sum()) for edge, x in zip(views.edges, numbers[i], strict=True)]
                text = sum(models[0][j * cotraining.BINS + b] for j, b in enumerate(bins)) + sum(models[0][len(bins) * cotraining.BINS + int(x)] for x in w) / max(1, len(w)) ** 0.5 + models[0][-1]
                for v, x in enumerate((text, sum(models[1][int(x)] for x in meta[i]) + models[1][-1])):
                    logits[v].append(float(np.clip(x * scales[v][0] + scales[v][1], -35, 35)))
            for v, y in enumerate(cotraining._given([(models, scales, cuts)], views, [views.text(numbers, words, begin), views.meta(meta)], h)):
                given[v] += y.tolist()
    for v in (0, 1):
        other = np.array(logits[1 - v])
        for k in (0, 1):
            own = np.flatnonzero(((other > 0) == k) & (np.abs(other) >= cotraining.SURE_LOGIT + 1e-4))
            labelled = np.flatnonzero(np.array(given[v]) == k)
            assert set(labelled) <= set(np.flatnonzero((other > 0) == k)) and min(most, len(own)) // 2 <= len(labelled) <= 2 * most
            rest = np.setdiff1d(own, labelled)
            if len(rest) and len(labelled):
                assert np.abs(other[rest]).max() <= np.abs(other[labelled]).min() + 1.01 / cotraining.LEVELS


def test_cotraining_views_share_no_column():
    texts = pa.array(["one", "two words", "three\nlines\nhere"])
    raw, at = c.text_of(texts)
    assert (cotraining.meta_features(["en"] * 3, ["a"] * 3, [5] * 3) == cotraining.meta_features(["en"], ["a"], [5])).all()
    assert len({tuple(x) for x in cotraining.text_numbers(raw, at)[0].tolist()}) == 3


def test_cotraining_cut():
    assert cotraining._cut(np.array([4.0, 0.0, 2.0]), 6) == (0, 1.0) and cotraining._cut(np.array([4.0, 0.0, 2.0]), 3) == (0, 0.25) and cotraining._cut(np.array([4.0, 0.0, 8.0]), 2) == (2, 0.25)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "<p>" + "some words that go on, " * 9000, "c"), (3, "u", "<p" * 500 + "<<>>&#x0;&amp", "c")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_crf.extract(pages).collect()}
    assert len(rows) == 4 and rows[1]["text"] == rows[2]["text"] == "" and rows[None]["n_chars"] > 100_000
    assert html_crf.extract(pages.where("false")).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1, "c"), (1, [1.0, 0.0], 1, "c"), (2, [1.0, 0.0], 1, "c"), (3, [1.0, 0.0, 0.0], 1, "c"), (4, [1e200, 0.0], 1, "c")], "vec_id long, embedding array<double>, label int, grp string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_forest.near_vectors(rows).collect()}
    assert got == {None: (3, 1, False), 1: (3, 1, True), 2: (3, 1, False), 3: (0, 3, True), 4: (3, 1, False)}
    assert vector_forest.near_vectors(rows.where("false")).count() == 0


def test_vectors_of_repeated_and_missing_ids(spark):
    """A repeated row is a vector of its own; a row without an id links, too."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (None, [0.01, 1.0], 1), (None, None, 1), (5, [0.0, 1.0], 2), (5, [1.0, 0.0], 2)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 0, "None", True), ("5", 0, "5", True), ("5", 0, "5", True)])


def test_vectors_with_negative_zeros(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [1.0, 0.01], 1), (4, [-0.0, -0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_forest.near_vectors(rows).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}


def test_pipeline(spark, docs, labels, tmp_path):
    plain = docs.drop(*CLASH)
    for name, table in (("some", plain), ("none", plain.where("false"))):
        at = f"file://{tmp_path}/{name}"
        table.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        rows = corpus_pipeline.run(spark, at).collect()
        assert bool(rows) == (name == "some")
    with_clash = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        with_clash = stage(spark, with_clash, f"file://{tmp_path}/some")
        assert with_clash.columns == docs.columns
    with_clash.count()
