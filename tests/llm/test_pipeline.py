"""Each stage of the pipeline against a brute-force version on what the stage before it kept."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from lectern.llm import cotraining, mixing
from test_operators import documents, groups, near_texts, shingles, tiktoken_encoding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each_group_stays(spark):
    """The smallest id of each group; rows without an id and second texts of an id are told apart."""
    texts = near_texts(12, 120)
    rows = [(i, x, "en", "a", len(x)) for i, x in texts.items()]
    some = [x for x in texts.values() if len(x.split()) > 8][:3]
    odd = [(None, some[0], "en", "b", 1), (None, some[0], "en", "b", 1), (None, "nobody has this text but these two rows", "en", "b", 1), (None, "nobody has this text but these two rows", "en", "b", 1), (None, None, "en", "b", None)]
    odd += [(9001, "one text of an id that comes twice", "en", "c", 1), (9001, "and its other text which is not the same", "en", "c", 1), (9002, some[1], "en", "c", 1), (9002, some[1], "en", "c", 1)]
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows + odd, SCHEMA).repartition(3), "").collect()]
    every = {k: r for k, r in enumerate([*rows, *dict.fromkeys(odd)])}
    comp, _ = groups({k: shingles(r[1], 5) for k, r in every.items()}, 80, 100)
    want = Counter(every[k] for k in set(comp.values()))
    assert Counter(kept) == want


def test_mix_keeps_the_shares(spark, small):
    """Whole copies move a source from its target by less than its largest document."""
    docs = documents(spark, small)
    size = {r["doc_id"]: (r["source"], r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(docs, keep=()).docs.collect()}
    got = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, small).collect())
    assert all(got[i] == math.floor(taken / n + 0.5) for i, (_, n, _, taken) in size.items() if n)
    words, largest, target = Counter(), Counter(), {}
    for i, (source, n, want, _) in size.items():
        words[source] += got[i] * n
        largest[source], target[source] = max(largest[source], n), want
    assert all(abs(words[s] - target[s]) <= largest[s] for s in target)


def test_mix_of_rows_without_ids(spark):
    rows = [(None, f"text number {i} " * (i + 3), "en", "ab"[i % 2], 1) for i in range(20)]
    got = Counter(r["text"] for r in corpus_pipeline.mixing(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert set(got) <= {r[1] for r in rows} and len(got) > 10


def test_stages_follow_each_other(spark, small):
    _, library = tiktoken_encoding()
    docs = documents(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r["doc_id"] for r in cotraining.classify(docs, labels).where("kept").collect()}
    first = corpus_pipeline.quality(spark, docs, small)
    assert first.columns == docs.columns and sorted(tuple(r) for r in first.collect()) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in good)
    second = corpus_pipeline.near_duplicates(spark, first, small)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    comp, _ = groups({i: shingles(x, 5) for i, x in texts.items()}, 80, 100)
    assert {r["doc_id"] for r in second.collect()} == set(comp.values())
    third = corpus_pipeline.mixing(spark, second, small)
    times = Counter(r["doc_id"] for r in third.collect())
    got = Counter()
    for r in corpus_pipeline.run(spark, small).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        got[r["doc_id"]] += 1
    assert got == times
