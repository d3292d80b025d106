"""Each operator against a brute-force version on the smallest tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, cotraining, flac, html_crf, jaccard_join, maxent_lm, mixing, sharding, token_files, vector_forest
from lectern.llm import common as c
from lectern.llm.labelled_pages import bare_pages, labelled_pages
from lectern.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def arrays(texts):
    data = [x.encode() for x in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def shingles(text, k):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(sets, num, den):
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        n = len(x & y)
        if n and den * n >= num * (len(x) + len(y) - n):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, links


def near_texts(seed, n):
    """Groups of copies with a few words changed, of sizes from 1 word up."""
    r = random.Random(seed)
    out = {}
    while len(out) < n:
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 3, 5, 9, 12, 25, 60, 200]))]
        for _ in range(r.choice([1, 2, 4, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3]) if len(w) > 3 else 0):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], ["new"], [w[at], "more"]])
            out[len(out) * 3 + 1] = r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_jaccard_join_is_exact(spark, k, num, den):
    texts = near_texts(k, 300)
    rows = jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=k, num=num, den=den).collect()
    sets = {i: shingles(x, k) for i, x in texts.items()}
    comp, links = groups(sets, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows} == {i: (len(sets[i]), comp[i], links[i]) for i in texts}


def test_large_groups_split_and_lose_nothing(spark):
    """A passage ties all texts together; groups above 8 are split, and blocks of 16 cut what stays."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for g in range(12):
        own = [f"t{g}x{i}" for i in range(30)]
        for _ in range(40 if g == 0 else 6):
            w = list(own)
            w[r.randrange(30)] = f"r{r.randrange(1000)}"
            texts[len(texts)] = passage + " " + " ".join(w)
    rows = jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), k=3, num=90, den=100, split_above=8).collect()
    comp, links = groups({i: shingles(x, 3) for i, x in texts.items()}, 90, 100)
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in rows} == {i: (comp[i], links[i]) for i in texts}


def test_joins_without_broadcast(spark, monkeypatch):
    """A third of all rows are one text (or vector), joins go by shuffle, hot keys are dealt apart."""
    monkeypatch.setattr(c, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(c, "HOT_ROWS", 10)
    texts = near_texts(31, 120)
    texts |= {5000 + i: "the one text that a third of all rows have" for i in range(60)} | {6000 + i: "" for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    comp, links = groups({i: shingles(x, 3) for i, x in texts.items()}, 90, 100)
    rows = jaccard_join.jaccard_join(docs).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in rows} == {i: (comp[i], links[i]) for i in texts} and len(rows) == len(texts)
    dealt = sharding.shard(docs).collect()
    where = {r["doc_id"]: r["shard"] for r in dealt}
    assert len(dealt) == len(texts) and len({where[5000 + i] for i in range(60)}) == 1
    by_text = defaultdict(set)
    for i, x in texts.items():
        by_text[x].add(where[i])
    assert all(len(x) == 1 for x in by_text.values())
    vectors = [(i, [1.0, 0.0, 0.0] if i < 40 else [math.cos(i), math.sin(i), 0.1], 1) for i in range(120)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_forest.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([v for _, v, _ in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i][0] for i in range(120)] == [int((x[i] @ x.T >= 0.93).sum()) - 1 for i in range(120)] and all(got[i][1] == 0 for i in range(40))


def test_jaccard_blocks_through_spark(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    texts = near_texts(21, 150)
    rows = jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=1, num=1, den=2, split_above=20).collect()
    comp, links = groups({i: shingles(x, 1) for i, x in texts.items()}, 1, 2)
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in rows} == {i: (comp[i], links[i]) for i in texts}


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_key(seed):
    """Whatever shingles sketches leave out, no linked pair loses its last shared key."""
    r = np.random.default_rng(seed)
    num, den = [(90, 100), (80, 100), (1, 2), (7, 10)][seed]
    bands = jaccard_join.Bands(num, den)
    common = r.random(1 << jaccard_join.MARK_BITS) < [0.0, 0.3, 0.6, 1.0][seed]
    for _ in range(60):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 80)), dtype=np.uint64) * np.uint64(2))
        keep = a[r.random(len(a)) < r.choice([0.85, 0.95, 1.0])]
        b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, int(r.integers(0, 4)), dtype=np.uint64)]))
        n = len(np.intersect1d(a, b))
        if not n or den * n < num * (len(a) + len(b) - n) or (len(a) == len(b) == n):
            continue
        keys, owner = jaccard_join.sketch_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands, common)
        assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_jaccard_blocks_agree_with_pairs():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    far = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    want = lambda a, b: np.array([[100 * len(set(x) & set(y)) >= 45 * len(set(x) | set(y)) and x is not y for y in b] for x in a])
    assert (jaccard_join.linked(sets, None, 45, 100) == want(sets, sets)).all()
    assert (jaccard_join.linked(sets, far, 45, 100) == want(sets, far)).all()


def test_reach_bounds_every_linked_pair():
    for num, den in ((90, 100), (80, 100), (1, 2)):
        bands = jaccard_join.Bands(num, den)
        for a in range(1, 150):
            for b in range(a, a * den // num + 1):
                inter = -(-num * (a + b) // (num + den))
                low_, high = bands.of(np.array([a, b]))
                assert high - low_ in (0, 1)
                if inter <= a:
                    assert a + b - 2 * inter <= bands.reach(np.array([low_]))[0]


@pytest.mark.parametrize("local", [10, 500_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(c, "LOCAL_NODES", local)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = {x["a"]: x["b"] for x in c.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    u = c.Union()
    for a, b in edges:
        u.join(a, b)
    assert found == {x: u.find(x) for x in {y for e in edges for y in e} if u.find(x) != x}


def test_mixing(spark, small):
    mix = mixing.mix_sources(documents(spark, small))
    rows, size = mix.docs.collect(), Counter()
    texts = {r["doc_id"]: r["text"] for r in documents(spark, small).collect()}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
    order = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, capped = {}, sum(size.values()), {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        target = capped | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    slots = mix.slots.collect()
    assert sum(s["words"] for s in slots) == sum(taken.values())
    # Any stretch of the schedule has the sources near their shares.
    seen = sorted(slots, key=lambda s: s["slot"])
    share, part = Counter(s["source"] for s in seen), Counter(s["source"] for s in seen[: len(seen) // 2])
    assert all(abs(part[s] - share[s] / 2) <= 6 for s in share)


def test_sharding(spark, small):
    docs = documents(spark, small)
    rows = sharding.shard(docs.union(docs.where("doc_id < 5").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))).collect()
    bytes_, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in where.values())
    assert max(bytes_.values()) - min(bytes_.values()) < 0.01 * sum(bytes_.values()) / 8


@given(st.lists(st.integers(0, 1000), max_size=40))
@settings(max_examples=60, deadline=None)
def test_differencing_accounts_for_all(sizes):
    sums, places = sharding.difference([(x,) for x in sizes], 4)
    got = [0] * 4
    for x, p in zip(sizes, places, strict=True):
        got[p[0]] += x
    assert got == sums and sum(sums) == sum(sizes)


ALPHABET = "aé ß\n\t '’sreDLVtmIIx1²٣  　中.,!\r \x1c\u0085ʰ̈😀İ<|Σ"


def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_library():
    ranks, library = tiktoken_encoding()
    codec, r = bpe.Codec(ranks), random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(40)] + ["a" * 500, "", " " * 9, "don't 're'll x'VE"]
        raw, at = arrays(texts)
        ids, bounds, offsets = codec.encode(raw, at)
        for i, x in enumerate(texts):
            own = ids[bounds[i] : bounds[i + 1]]
            assert own.tolist() == library.encode_ordinary(x)
            assert codec.decode(own).tobytes() == x.encode()
            assert offsets[bounds[i] : bounds[i + 1]].tolist() == np.cumsum([0, *codec.size[own]])[:-1].tolist()


def test_bpe_tables(spark, small):
    _, library = tiktoken_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, small).collect()}
    for r in QUERIES["op5_byte_level_bpe"](spark, small).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.bpe_encode(documents(spark, small).limit(5), path)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.bpe_decode(encoded, path).collect()} == {r["doc_id"]: texts[r["doc_id"]] for r in encoded.collect()}


def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_words_agree_with_library():
    library, r = word_tokenizer(), random.Random(2)
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        own = token_files.Words(f.read())
    for _ in range(40):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) + r.choice(["", "<|endoftext|>", " <|EndOfText|>"]) for _ in range(40)]
        ids, bounds = own.encode(*arrays(texts))
        assert [ids[s:e].tolist() for s, e in itertools.pairwise(bounds)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files(spark, small, tmp_path):
    library, at = word_tokenizer(), f"file://{tmp_path}/tokens"
    manifest = token_files.write_tokens(documents(spark, small), P.path("word_bpe_49k.json"), at)
    rows = {r["doc_id"]: r for r in token_files.read_tokens(manifest, at).collect()}
    start = 0
    frames = token_files.Frames((tmp_path / "tokens" / token_files.DICTIONARY).read_bytes())
    shards = [token_files.Shard(at, m["name"], frames) for m in manifest.collect()]
    for d in documents(spark, small).orderBy("doc_id").collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        r = rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    one = [x for x in (s.document(7) for s in shards) if x is not None]
    assert len(one) == 1 and one[0].tolist() == rows[7]["ids"]
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(at, manifest.first()["name"], token_files.Frames(b""))


def test_token_files_of_a_hot_id(spark, tmp_path):
    """An id that half of all rows share fills several shards; files stay in order of ids."""
    rows = [(i, f"text {i}") for i in range(60)] + [(30, f"other text {i}") for i in range(100)] + [(None, f"none {i}") for i in range(40)]
    at = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write_tokens(docs, P.path("word_bpe_49k.json"), at, shards=8).orderBy("shard").collect()
    got = sorted(token_files.read_tokens(docs.sparkSession.createDataFrame(manifest), at).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got[:-1])] and max(m["n_docs"] for m in manifest) < 70
    library = word_tokenizer()
    assert sorted(tuple(r["ids"]) for r in got) == sorted((*library.encode(x, add_special_tokens=False).ids, 1) for _, x in rows)


@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_flac_round_trip(data):
    own = [x + bytes(max(64, -(-len(x) // 64) * 64) - len(x)) for x in data]
    streams = flac.encode(own)
    for (s, x, _), p in zip(flac.decode(streams), own, strict=True):
        assert (x[:, 0] + 128).astype(np.uint8).tobytes() == p and s.samples == len(p)
    assert streams[0] == flac.encode(own[:1])[0]


def hand_made(samples, stereo=None, escape=False):
    """A stream written bit by bit, without a seek table: one frame of 16-bit samples."""
    bits = ""
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b") if n else ""

    def subframe(x, depth):
        out = put(0b00010010 if not escape else 0b00010000, 8)  # fixed, order 1 or 0
        order = 0 if escape else 1
        out += "".join(put(v, depth) for v in x[:order]) + put(0, 2) + put(0, 4)
        if escape:
            return out + put(15, 4) + put(depth, 5) + "".join(put(v, depth) for v in x)
        out += put(3, 4)
        for a, b in itertools.pairwise(x):
            u = 2 * (b - a) if b >= a else -2 * (b - a) - 1
            out += "0" * (u >> 3) + "1" + put(u & 7, 3)
        return out

    n = len(samples)
    head = bytes([0xFF, 0xF8, 0x70, ((0 if stereo is None else stereo) << 4) | 8, 0]) + struct.pack(">H", n - 1)
    head += bytes([flac.crc8(head)])
    if stereo is None:
        bits = subframe(samples, 16)
        pcm = np.array(samples).reshape(-1, 1)
    else:
        left, right = samples, [x // 3 - 5 for x in samples]
        side = [a - b for a, b in zip(left, right, strict=True)]
        mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
        first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: (mid, side)}[stereo]
        bits = subframe(first, 16 + (stereo == 9)) + subframe(second, 16 + (stereo in (8, 10)))
        pcm = np.stack([left, right], 1)
    bits += "0" * (-len(bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    raw = np.frombuffer(frame, np.uint8)
    frame += struct.pack(">H", int(flac.crc16s(raw, np.array([0]), np.array([len(raw)]))[0]))
    channels = pcm.shape[1]
    info = struct.pack(">HH", n, n) + bytes(6) + struct.pack(">Q", 44100 << 44 | (channels - 1) << 41 | 15 << 36 | n) + hashlib.md5(flac.pcm(pcm, 16)).digest()
    return b"fLaC\x80\x00\x00\x22" + info + frame, pcm


@pytest.mark.parametrize(("stereo", "escape"), [(None, False), (None, True), (1, False), (8, False), (9, False), (10, False), (10, True)])
def test_flac_decodes_what_others_write(stereo, escape):
    r = random.Random(4)
    stream, pcm = hand_made([r.randrange(-300, 300) for _ in range(200)], stereo, escape)
    (_, x, firsts), = flac.decode([stream])
    assert (x == pcm).all() and firsts == [0]


def test_flac_notices_damage(spark):
    stream = bytearray(flac.encode([b"some text that is stored " * 64 * 4])[0])
    stream[len(stream) // 2] ^= 8
    with pytest.raises(flac.Broken):
        flac.decode([bytes(stream)])
    good = flac.encode([b"x" * 64 * 70])[0]
    rows = spark.createDataFrame([(1, bytes(stream)), (2, good), (3, None), (4, b"no")], "doc_id long, media binary")
    blocks = flac.pcm_blocks(rows).orderBy("doc_id", "block").collect()
    assert [(r["doc_id"], r["first_sample"], r["n_samples"], r["error"] is None) for r in blocks] == [(1, 0, 0, False), (2, 0, 4096, True), (2, 4096, 384, True), (4, 0, 0, False)]


def test_flac_blocks_can_be_sought():
    data = bytes(random.Random(8).randrange(256) for _ in range(64 * 200))
    ((_, got, error),) = flac.decoded_pcm(flac.encode([data]))
    own = bytes(b ^ 128 for b in data)
    assert error is None and got.firsts == [0, 4096, 8192, 12288] and len(got.blocks) == 4
    for first, n in ((0, 12800), (4095, 2), (4096, 4096), (5000, 7000), (12799, 1), (12790, 50)):
        assert got.read(first, n) == own[first : first + n]


def test_flac_query(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, small).collect()}
    for r in QUERIES["op9_flac_media"](spark, small).collect():
        p = texts[r["doc_id"]]
        p += bytes(max(64, -(-len(p) // 64) * 64) - len(p))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["error"] is None and r["feature"].startswith("mean=")


def test_maxent(spark, small):
    texts = {r["doc_id"]: WORD.findall(low(r["text"] or "")) + [0] for r in documents(spark, small).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(x for i, t in texts.items() if not held[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    base, own = [0.0, 0.0], [0.0, 0.0]
    for r in QUERIES["op8_maxent_scoring"](spark, small).collect():
        t = texts[r["doc_id"]]
        want = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        assert r["base_score"] == pytest.approx(want, abs=1e-6) and (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(counts[x] > 0 for x in t), n, held[r["doc_id"]])
        base[r["held_out"]] += r["base_score"]
        own[r["held_out"]] += r["score"]
    assert own[0] > base[0] and own[1] > base[1]


def plain_softmax(tree, w, hashes, node, bits):
    """Probabilities of the choices at a node, one number at a time."""
    x = []
    for j in range(maxent_lm.WAYS):
        z = float(tree.prior[node, j])
        for h in hashes:
            r = ((int(h) + node * 0x9FB21C651E98DF25) % 2**64 * 0xD6E8FEB86659FD93) % 2**64 >> (64 - bits)
            z += float(w[r, j])
        x.append(z)
    total = sum(map(math.exp, x))
    return [math.exp(z) / total for z in x]


def plain_word(tree, w, hashes, word, bits):
    p = 1.0
    for k, (at, to) in enumerate(zip(tree.nodes, tree.children, strict=True)):
        if at[word] >= 0:
            p *= plain_softmax(tree, w, hashes if k < 2 else [hashes[0], hashes[2]], int(at[word]), bits)[to[word]]
    return p


def test_maxent_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 300):
        tree = maxent_lm.Tree(np.sort(r.integers(1, 90, n))[::-1], 7.0)
        w = r.standard_normal((64, maxent_lm.WAYS)).astype(np.float32)
        f = [np.full(n + 1, r.integers(1 << 60), np.uint64) for _ in range(3)]
        logs = maxent_lm.word_logs(tree, w, f, np.arange(n + 1), 6)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
        assert np.exp(logs) == pytest.approx([plain_word(tree, w, [h[0] for h in f], i, 6) for i in range(n + 1)], rel=1e-4)


def test_maxent_score_is_that_of_a_dense_model(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("a b c d e f g h i j k l m n o p q r s t u v w x y z".split()) + r.choice(["", "", "1", str(r.randrange(40))]) for _ in range(r.randrange(60))) for _ in range(60)] + [None, "", "never seen words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = docs.where("doc_id < 50")
    model = maxent_lm.train(seen)
    counts = Counter(x for t in texts[:50] for x in maxent_lm.tokens(*arrays([t]))[0].tolist())
    keys, top_counts, tree = model.top.value
    word = {int(x): i for i, x in enumerate(keys)}
    assert all(counts[k] == n for k, n in zip(keys.tolist(), top_counts.tolist(), strict=True)) and 20 < len(word) < len(counts)
    for row in maxent_lm.score(docs, model).collect():
        t, begin = maxent_lm.tokens(*arrays([texts[row["doc_id"]] or ""]))
        f, want = maxent_lm.features(t, begin), 0.0
        for i, x in enumerate(t.tolist()):
            p = plain_word(tree, model.weights.value, [h[i] for h in f], word.get(x, len(word)), model.bits)
            if x not in word:
                p *= (1 - model.unseen) * counts[x] / model.rare if counts[x] else model.unseen
            want += math.log10(p)
        assert row["score"] == pytest.approx(want, rel=1e-4)


def test_maxent_step_is_a_plain_gradient_step():
    r = np.random.default_rng(6)
    tree, bits = maxent_lm.Tree(np.sort(r.integers(1, 50, 40))[::-1], 3.0), 5
    words, f = r.integers(0, 41, 30), [r.integers(0, 1 << 60, 30).astype(np.uint64) for _ in range(3)]
    learner = maxent_lm.Learner(tree, r.standard_normal((32, maxent_lm.WAYS)).astype(np.float32), bits, 0.1, 30)
    learner.g2 += 1
    g, was = np.zeros(learner.w.shape), learner.w.copy()
    for i, x in enumerate(words.tolist()):
        for k, (at, to) in enumerate(zip(tree.nodes, tree.children, strict=True)):
            hashes = [h[i] for j, h in enumerate(f) if k < 2 or j != 1]
            if at[x] >= 0:
                p = np.array(plain_softmax(tree, was, hashes, int(at[x]), bits))
                p[to[x]] -= 1
                for h in hashes:
                    g[((int(h) + int(at[x]) * 0x9FB21C651E98DF25) % 2**64 * 0xD6E8FEB86659FD93) % 2**64 >> (64 - bits)] += p
    learner.step(f, words)
    assert learner.w == pytest.approx(was - 0.1 * g / np.sqrt(1 + g * g), abs=1e-4)
    assert learner.touched.sum() == sum((3 if k < 2 else 2) * (at[words] >= 0).sum() for k, at in enumerate(tree.nodes))


def test_maxent_table():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 60, 5000)).astype(np.uint64)
    table = maxent_lm.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 61)) == -1).all()


def test_near_vectors(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((600, 24))
    x[200:400] = x[:200] + 0.07 * r.standard_normal((200, 24)) * np.linalg.norm(x[:200], axis=1, keepdims=True) / math.sqrt(24) * 5
    x[400:420] = x[0]
    label = r.integers(0, 3, 600)
    label[200:400] = label[:200]
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(600)]
    rows += [(700, None, 1), (701, [0.0] * 24, 1), (702, [float("nan")] * 24, 1), (703, x[0].tolist(), None), (704, [1.0, None], 1), (705, [], 1)]
    got = {q["vec_id"]: q for q in vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    uf = c.Union()
    for a, b in zip(*np.nonzero(link), strict=True):
        uf.join(int(a), int(b))
    assert len(got) == len(rows)
    found, all_ = sum(got[i]["n_links"] for i in range(600)), int(link.sum())
    assert 0.97 * all_ <= found <= all_ and all(got[i]["n_links"] <= link[i].sum() for i in range(600))
    assert np.mean([got[i]["component_id"] == uf.find(i) for i in range(600)]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(700, 706))


def test_forest_of_a_large_label(spark):
    """One label with more vectors than the sample can split: leaves are split again by their own
    vectors; every hundredth vector is asked of all, by brute force."""
    r = np.random.default_rng(11)
    n, dim = 12_000, 16
    x = r.standard_normal((n, dim))
    x[n // 2 :] = x[: n // 2] + 0.3 * r.standard_normal((n // 2, dim)) * np.linalg.norm(x[: n // 2], axis=1, keepdims=True) / math.sqrt(dim)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").selectExpr("*", "1 as label")
    got = {q["vec_id"]: q for q in vector_forest.near_vectors(rows.repartition(4), leaf=300, sample=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, n, 100)
    link = u[asked] @ u.T >= 0.93
    link[np.arange(len(asked)), asked] = False
    found, all_ = sum(got[i]["n_links"] for i in asked.tolist()), int(link.sum())
    assert all_ > 50 and 0.95 * all_ <= found <= all_ and all(got[int(i)]["n_links"] <= link[k].sum() for k, i in enumerate(asked))


def test_page_model_on_pages_it_has_not_seen():
    model = html_crf.default_model()
    for make, wanted in ((labelled_pages, 0.98), (bare_pages, 0.97)):
        right = total = 0
        for page in make(150, seed=99):
            blocks, y = html_crf._marked(page)
            if blocks:
                got = model.decode([model.scores(blocks)])[0]
                right, total = right + int((got == np.array(y, bool)).sum()), total + len(y)
        assert right / total > wanted


P_ = "The quick report says many things about this subject, and it goes on for a while. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<header><p>Site</p></header><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>A&nbsp;b\n c<br>d<p>{P_}</article><footer>&copy; x</footer>", "T & U\nA b c d\n" + P_.strip()),
        (f"<article><p>{P_}</p><div class='ad'>Buy this now.</div><form><label>Mail</label></form></article><div class='comments'><p>{P_}</p></div>", P_.strip()),
        (f"<div class='cookie-notice'>We use cookies.</div><main><p>{P_}</p></main><aside><p>{P_}</p></aside>", P_.strip()),
        (f"<body><div><a>Home</a> <a>News</a> <a>Sport</a></div><div><h1>Plan</h1>{P_}<br><br>{P_}</div><div>Copyright 2024 All rights reserved</div>", "Plan\n" + (P_ + P_).strip()),
        (f"<body><div><a>Home</a> <a>News</a></div><div><h1>Plan</h1><div>{P_}</div><div>{P_}</div></div><div>Copyright 2024</div>", f"Plan\n{P_.strip()}\n{P_.strip()}"),
        (P_, P_.strip()),
        (f"<div>{P_}</div>", P_.strip()),
        (f"<p>{P_}</p><p>{P_}</p>", f"{P_.strip()}\n{P_.strip()}"),
        (f"<table><tr><td>Start Sport</td><td><h1>Plan</h1><p>{P_}</p><p>{P_}</p></td><td>Buy now!</td></tr></table>", f"Plan\n{P_.strip()}\n{P_.strip()}"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> -->", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert html_crf.main_texts([page], html_crf.default_model()) == [text]


def test_whole_blocks_count():
    """What comes after the first thousands of characters moves the features."""
    long = "word " * 1000
    for more in ("Buy now", "1 2 3 4 5 6 7 8 9 " * 100, "Capital Letters " * 400):
        assert html_crf.text_features(long + "end", 0, "p", 0.5) != html_crf.text_features(long + more, 0, "p", 0.5)


def test_pages_table(spark, small):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op1_html_extraction"](spark, small).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in blocks if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_viterbi_is_exact():
    r = np.random.default_rng(1)
    model = html_crf.Crf({}, r.standard_normal((2, 2)), r.standard_normal(2))
    pages = [r.standard_normal(n) * 2 for n in (5, 1, 0, 7)]
    for e, got in zip(pages, model.decode(pages), strict=True):
        score = lambda y, e=e: model.first[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(model.trans[a, b] for a, b in itertools.pairwise(y)) if y else 0
        assert score(tuple(got.astype(int))) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=len(e))))


def test_cotraining_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    known = labels.where("doc_id % 5 != 0")
    rows = cotraining.classify(docs, known).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_sql_says_the_same(spark):
    import duckdb

    from lectern.llm.queries import SQL

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    for name, sql in SQL.items():
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        got = QUERIES[name](spark, "/root/testdata/sf0.01")
        assert sorted(got.columns) == sorted(columns) and sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(found.fetchall())
