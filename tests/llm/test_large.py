"""Tables too large to be broadcast, on small ones with a smaller limit."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import common as c
from lectern.llm import jaccard_join
from test_operators import groups, near_texts, shingles


@pytest.mark.parametrize("bits", [32, 3])
def test_large_joins_shuffle_no_texts(spark, monkeypatch, bits):
    """Where classes are too many to be broadcast only candidates' texts are shuffled; classes with one owner lose no link."""
    joined, join_small = [], c.join_small
    monkeypatch.setattr(c, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard_join, "OWNER_BITS", bits)
    monkeypatch.setattr(c, "join_small", lambda left, *a, **b: (joined.append(left.columns), join_small(left, *a, **b))[1])
    texts = near_texts(12, 120)
    rows = spark.createDataFrame([*texts.items(), *((i + 10_000, x) for i, x in texts.items())], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(rows, k=5, num=80, den=100).collect()}
    comp, _ = groups({i: shingles(x, 5) for i, x in texts.items()}, 80, 100)
    assert {i: got[i] for i in texts} == comp
    assert joined and not any("text" in x for x in joined)


def test_marks_miss_no_key(spark, monkeypatch):
    rows, keys = spark.range(5000).withColumn("x", F.col("id") * 7919 - 10**12), spark.range(0, 5000, 50).select((F.col("id") * 7919 - 10**12).alias("x"))
    told = c.marked(rows, keys, "x", 100).groupBy((F.col("id") % 50 == 0).alias("in"), "may__").count().collect()
    n = {(r["in"], r["may__"]): r["count"] for r in told}
    assert n[True, True] == 100 and (True, False) not in n and n.get((False, True), 0) < 500
    monkeypatch.setattr(c, "BROADCAST_BYTES", 0)
    of = lambda how: sorted(r["id"] for r in c.join_marked(rows, keys, "x", how, 100).collect())
    assert of("inner") == of("left_semi") == list(range(0, 5000, 50)) and of("left_anti") == [i for i in range(5000) if i % 50]


def test_parts_of_terms_are_sifted_before_they_move(spark, monkeypatch):
    """Where words are too many to be broadcast, parts of terms that can't be words aren't shuffled."""
    from lectern.operators import postings

    joined, join_marked = [], postings.join_marked
    monkeypatch.setattr(c, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(postings, "join_marked", lambda left, *a: (joined.append((left.count(), c.marked(left, *a[:2], a[3]).where("may__").count())), join_marked(left, *a))[1])
    texts = {i: f"Alphabet soup{i} with gammaray_{i % 3} and beta, alphabetical order" for i in range(40)}
    asked = {1: ["alpha", "beta", "soup1", "alpha"], 2: ["gammaray_2", "order", "nothing"]}
    got = postings.keyword_counts(None, spark.createDataFrame([*texts.items()], "doc_id long, text string"), spark.createDataFrame([*asked.items()], "qid long, keywords array<string>"), id_col="doc_id")
    want = {(q, i): n for q, words in asked.items() for i, x in texts.items() if (n := sum(w in x.lower() for w in words))}
    assert {(r["qid"], r["doc_id"]): r["n"] for r in got.collect()} == want
    assert len(joined) == 1 and joined[0][1] < joined[0][0] / 4
