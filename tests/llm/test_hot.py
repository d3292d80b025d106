"""Hot rows: a third or more of all rows with one text or vector, without ids or with one id."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from lectern.llm import common as c
from lectern.llm import flac, jaccard_join, mixing, sharding, vector_forest
from lectern.llm.queries import QUERIES


@pytest.fixture(scope="module")
def hot(spark):
    """6,000 rows without an id and one text, 2,000 with one id and one text, 4,000 others, some near copies."""
    none = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'one text that all of these rows have in common, word by word' as text", "'s' as source")
    same = spark.range(2000).selectExpr("7L as doc_id", "'another text of one id that comes again and again in here' as text", "'t' as source")
    rest = spark.range(4000).selectExpr("id + 10 as doc_id", "concat('text of number ', id div 2, ' with quite a few words that are ', id div 2, ' and more of them up to the end', if(id % 2 = 0, '', ' now')) as text", "if(id % 3 = 0, 's', 't') as source")
    near = spark.createDataFrame([(5, "one text that all of these rows have in common, word by word", "s"), (6, "another text of one id that comes again and again in here", "s")], "doc_id long, text string, source string")
    return none.union(same).union(rest).union(near)


def test_one_row_of_each_class_is_compared(spark, hot, monkeypatch):
    seen = {}
    tasks = jaccard_join._tasks

    def spy(sets, bands):
        seen.update(rows=sets.count(), nodes=sets.select("node").distinct().count())
        return tasks(sets, bands)

    monkeypatch.setattr(jaccard_join, "_tasks", spy)
    got = Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(hot.repartition(7), k=3, num=60, den=100).collect())
    assert got[None, 5, 6000] == 6000 and got[7, 6, 2000] == 2000 and got[5, 5, 6000] == 1 and got[10, 10, 1] == 1 and sum(got.values()) == 12_002
    assert seen["rows"] == seen["nodes"] >= 4000


def test_one_vector_of_each_class_is_compared(spark, monkeypatch):
    pick = np.random.default_rng(3)
    rows = [(None, [1.0, 2.0, 3.0], 1)] * 1500 + [(4, [3.0, 2.0, 1.0], 1)] * 1500 + [(10 + i, v, 1) for i, v in enumerate(pick.standard_normal((600, 3)).tolist())]
    seen, blobs = [], vector_forest._blobs
    monkeypatch.setattr(vector_forest, "_blobs", lambda kind: (seen.append(kind), blobs(kind))[1])
    stashed, stash = [], c.stash
    monkeypatch.setattr(c, "stash", lambda df, *a: (stashed.append(out := stash(df, *a)), out)[1])
    got = vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)).collect()
    assert len(got) == len(rows) and seen
    kept = next(x for x in stashed if x.columns == ["node", "grp", "copies", "blob"])
    assert kept.count() == 602
    x = np.array([v for _, v, _ in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    links = Counter((i, int(n) - 1) for (i, _, _), n in zip(rows, link.sum(1), strict=True))
    found = Counter((r["vec_id"], r["n_links"]) for r in got)
    exact = sum((links & found).values())
    assert exact >= 0.9 * len(rows) and sum(r["n_links"] for r in got) >= 0.95 * (int(link.sum()) - len(rows))


def test_the_forest_runs_on_given_tables(spark, small, monkeypatch):
    """Every label of the smallest table with over 32 vectors goes through the trees."""
    seen, cells = [], vector_forest._cells
    monkeypatch.setattr(vector_forest, "_cells", lambda members, sizes, *a: (seen.append({r["grp"]: (r["n"], r["leaf"]) for r in sizes.collect()}), cells(members, sizes, *a))[1])
    got = QUERIES["op10_vector_near_dedup"](spark, small).collect()
    labels = Counter(r["label"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
    assert seen and {g.split("/")[1]: n for g, (n, _) in seen[0].items()} == {str(k): n for k, n in labels.items() if n > 32}
    assert all(leaf == max(32, n // 4) for n, leaf in seen[0].values()) and len(got) == sum(labels.values())


@pytest.mark.parametrize(("n", "labels"), [(60, 1), (1000, 4), (3000, 1)])
def test_recall_of_small_labels(spark, n, labels):
    """The sizes that the given tables have, with planted near copies, against all pairs."""
    pick = np.random.default_rng(n)
    x = pick.standard_normal((n, 64))
    for i in range(0, n - 1, 2):
        far = pick.standard_normal(64)
        x[i + 1] = x[i] + 0.38 * far / np.linalg.norm(far) * np.linalg.norm(x[i]) * pick.random()
    label = [i // 2 % labels for i in range(n)]
    got = {r["vec_id"]: r["n_links"] for r in vector_forest.near_vectors(spark.createDataFrame([(i, v, label[i]) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    all_ = int(link.sum())
    assert all_ > n / 2 and 0.95 * all_ <= sum(got.values()) <= all_ and all(got[i] <= k for i, k in enumerate(link.sum(1)))


def test_mixing_deals_equal_rows_and_reruns_agree(spark, hot, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    tell = lambda n: Counter(map(str, mixing.mix_sources(hot.repartition(n), keep=("text",)).docs.collect()))
    one = tell(3)
    assert one == tell(8)
    rows = mixing.mix_sources(hot.repartition(4)).docs.collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    for s in ("s", "t"):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 64


def test_no_stretch_of_the_line_is_long(spark, hot, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    stashed, stash = [], c.stash
    monkeypatch.setattr(c, "stash", lambda df, *a: (stashed.append(out := stash(df, *a)), out)[1])
    mixing.mix_sources(hot.repartition(4))
    hottest = next(x for x in stashed if x.columns == ["h", "parts"]).collect()
    assert sorted(r["parts"] for r in hottest) == [4, 12]


def test_shards_deal_rows_without_ids(spark, hot):
    rows = sharding.shard(hot.repartition(5)).collect()
    for k in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and len(rows) == 12_002


def test_media_are_stored_once_for_each_text(spark, hot, tmp_path):
    rows, media = flac.store_media(hot.repartition(5))
    stored = media.select("key.p", "key.q", "media").distinct().collect()
    texts = {r["text"] for r in hot.select("text").distinct().collect()}
    assert len(stored) == len(texts) and rows.count() == 12_002 and media.inputFiles()
    decoded = {bytes(np.frombuffer(p.read(0, p.stream.samples), np.uint8) ^ 128).rstrip(b"\0").decode() for _, p, _ in flac.decoded_pcm([r["media"] for r in stored[:200]])}
    assert decoded <= texts and len(decoded) == 200
    got = flac.stored_digests(hot.repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((r["doc_id"], len(r["text"])) for r in hot.collect())
    shas = {hashlib.sha256(bytes(r["media"])).hexdigest(): r["media"] for r in stored}
    assert {r["media_sha256"] for r in got} == set(shas) and all(r["media_bytes"] == len(shas[r["media_sha256"]]) for r in got)


def test_features_by_brute_force(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op9_flac_media"](spark, small).collect():
        raw = texts[r["doc_id"]]
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = [b - 128 for b in raw]
        cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        want = f"mean={sum(x) / len(x):.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};peak={max(map(abs, x))};crossings={cross / len(x):.4f};frames="
        assert r["feature"].startswith(want) and int(r["feature"].removeprefix(want)) == -(-len(raw) // flac.BLOCK)
