"""Behaviour that the tables don't reach."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import PRESETS
from lectern.functions import text as t
from lectern.operators import answer, chunking, contents, layout, search, sections, tree
from lectern.plans.engine import Engine
from lectern.plans.pipeline import Pipeline, State, chain
from lectern.sources import pages as source
from lectern.sources.store import Store, records
from lectern.streaming.ingest import event_windows, ingest_stream


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}")
    return [r["x"] for r in rows.select("id", f(F.col("v")).alias("x")).orderBy("id").collect()]


INTENTS = {
    "How do I implement gradient descent in Python?": ("code_request", "intermediate"), "What is the difference between CNN and RNN?": ("comparison", "intermediate"), "Explain neural networks for a beginner": ("conceptual", "beginner"),
    "Why isn't my model converging?": ("conceptual", "intermediate"), "Give me a step by step guide": ("tutorial", "intermediate"), "Fix this bug": ("debugging", "intermediate"), "advanced settings for TVs": ("comparison", "advanced"),
}


def test_questions(spark):
    assert column(spark, list(INTENTS), lambda q: F.concat_ws(",", t.intent(q), t.complexity(q))) == [",".join(x) for x in INTENTS.values()]
    assert column(spark, ["How do I implement a CNN in Keras?"], t.topics) == [["cnn", "keras"]]
    assert column(spark, ["How do I implement a CNN in Keras? Keras"], t.keywords) == [["implement", "cnn", "keras", "keras"]]
    assert column(spark, ["show me", "why"], t.code_language) == ["python", None]
    errors = column(spark, [None, "   ", "ab", "a" * 1001, "???", "How to build a CNN?"], t.question_error)
    assert errors == ["Query is None", "Query is empty", "Query too short (min 3 characters, got 2)", "Query too long (max 1000 characters, got 1001)", "Query must contain at least one alphanumeric character", None]


def test_numbers_and_titles(spark):
    want = {"Chapter 3: Trees": ("3", "Trees"), "Ch 4": ("4", "Ch 4"), "1.2 Title": ("1.2", "Title"), "3 - Foo": ("3", "Foo"), "12": ("1", "2"), "1.23": ("1.2", "3"), "Preface": (None, "Preface")}
    assert column(spark, list(want), t.heading_number) == [x for x, _ in want.values()]
    assert column(spark, list(want), t.heading_title) == [x for _, x in want.values()]
    levels = [("Chapter 3: Trees", 14.0, 1), ("1.2 Title", 14.0, 1), ("Preface", 14.0, 1), ("Department", 14.0, 1), ("Overview", 14.0, 3), ("Overview", 15.0, 2), ("Overview", 19.0, 1)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(levels)], "id int, v string, size double, want int")
    assert rows.where(t.heading_level(F.col("v"), F.col("size"), F.lit(12.0)) != F.col("want")).count() == 0


def test_code(spark):
    texts = ["def f(x):", "x = 1;", "public static void run", "function go (", "plain prose only", "", "a\n    indented"]
    assert column(spark, texts, lambda x: t.contains_code(x, "broad")) == [True, True, False, True, False, False, True]
    assert column(spark, texts, lambda x: t.contains_code(x, "strict")) == [True, False, True, True, False, False, True]


def test_contents_lines(spark):
    want = {
        "Chapter 1: The Landscape ........ 3": ("1", "The Landscape", 3, 1), "1.1 What Is It? ...... 4": ("1.1", "What Is It?", 4, 2), "1.2.3 Deep .. 20": ("1.2.3", "Deep", 20, 3), "Index ........ 780": (None, "Index", 780, 2),
        "Appendix A .... 700": (None, "Appendix A", 700, 1), "3.4 Metrics    88": ("3.4", "Metrics", 88, 2), "Glossary      401": (None, "Glossary", 401, 2), "Chapter 12 ........ 9": (None, "Chapter 12", 9, 1), "Preface ........ xv": None,
    }
    assert [x and tuple(x) for x in column(spark, list(want), t.contents_entry)] == list(want.values())


def test_windows(spark):
    rows = spark.createDataFrame([(1, ["x"] * 250), (2, [])], "book_id long, tokens array<string>")
    starts = lambda **k: [r["token_start"] for r in chunking.windows(rows, ["book_id"], 100, 20, **k).orderBy("k").collect()]
    assert starts() == [0, 80, 160, 240] and starts(drop_tail=True) == [0, 80, 160]


@given(st.integers(0, 120), st.integers(1, 30), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_tail_rule_is_the_loop(n, size, overlap):
    step, at, loop = max(1, size - overlap), 0, []
    while at < n:
        loop.append(at)
        at += step
        if at < n and at + size > n and n - at < overlap:
            break
    assert [s for s in range(0, n, step) if not (s > 0 and s + size > n and n - s < overlap)] == loop


def test_section_ranges(spark):
    heads = spark.createDataFrame([(1, i, p, f"H{i}", lv, 1.0) for i, (lv, p) in enumerate([(1, 1), (2, 2), (2, 3), (1, 5)], 1)], "book_id long, ord int, page int, text string, level int, size double")
    books = spark.createDataFrame([(1, 9), (2, 4)], "book_id long, total_pages int")
    assert [r["end_page"] for r in sections.raw_sections(heads, books).orderBy("ord").collect()] == [4, 2, 4, 9]
    rows = sections.sections(heads.withColumn("page", F.col("page") + 1), books).orderBy("book_id", "ord").collect()
    assert [(r["title"], r["start_page"]) for r in rows][0] == ("Front Matter", 1) and rows[-1]["title"] == "Full Book"


def nodes(spark, entries):
    toc = spark.createDataFrame([(1, i, x, None, p, lv, x) for i, (x, lv, p) in enumerate(entries, 1)], "book_id long, seq int, title string, number string, page int, level int, raw_text string")
    return tree.from_contents(toc)


def test_tree(spark):
    books = spark.createDataFrame([(1, 20, 99)], "book_id long, total_pages int, last_idx int")
    rows = tree.fill_ranges(tree.front_matter(nodes(spark, [("A", 1, 1), ("A.1", 2, 2), ("B", 1, 10)])), books).orderBy("path").collect()
    assert [(r["title"], r["parent_id"], r["end_page"]) for r in rows] == [("A", 0, 9), ("A.1", 1, 9), ("B", 0, 20)]
    late = tree.fill_ranges(tree.front_matter(nodes(spark, [("A", 1, 5)])), books).orderBy("path").collect()
    assert [(r["title"], r["start_page"], r["end_page"]) for r in late] == [("Front Matter", 1, 4), ("A", 5, 20)]


def test_parents_are_the_stack(spark):
    r = random.Random(1)
    books = {b: [r.randint(1, 3) for _ in range(r.randint(1, 25))] for b in range(80)}
    toc = [(b, i, "t", None, i, lv, "t") for b, levels in books.items() for i, lv in enumerate(levels, 1)]
    rows = tree.from_contents(spark.createDataFrame(toc, "book_id long, seq int, title string, number string, page int, level int, raw_text string")).collect()
    got = {(x["book_id"], x["seq"]): x["path"] for x in rows}
    for b, levels in books.items():
        stack = [(0, 0)]
        for i, lv in enumerate(levels, 1):
            while stack[-1][1] >= lv:
                stack.pop()
            assert got[b, i] == [x for x, _ in stack[1:]] + [i]
            stack.append((i, lv))


def test_rerank(spark):
    rows = [(1, "a", 1, 0.8, "", "text"), (1, "b", 2, 0.9, "implement a gan", "text"), (1, "c", 3, 0.5, "gan code", "code")]
    hits = spark.createDataFrame(rows, "qid long, chunk_id string, rank int, similarity double, content string, chunk_type string")
    asked = search.parse_questions(spark.createDataFrame([(1, "implement gan")], "qid long, raw_query string"))
    ranked = search.rerank(hits.join(asked, "qid")).orderBy("position").collect()
    assert [(r["chunk_id"], r["rerank"], r["relevance_pct"]) for r in ranked] == [("c", 0.7, 100.0), ("b", 0.66, 94.3), ("a", 0.32, 45.7)]
    zero = search.rerank(hits.join(asked, "qid").withColumn("similarity", F.lit(0.0)).withColumn("content", F.lit(""))).where("chunk_id != 'c'").collect()
    assert all(r["relevance_pct"] == 0 for r in zero)


def test_contents_region_needs_entries(spark):
    few = spark.createDataFrame([(1, i, 1, "", x) for i, x in enumerate(["Contents", "One ..... 1", "Two ..... 2"])], "book_id long, idx int, page int, type string, text string")
    assert contents.entries(few).count() == 0


def test_lines(spark):
    chars = spark.createDataFrame([(1, 1, 1, "b", 10.0, 5.0, 9.0, 10.4, "F"), (1, 1, 0, "a", 0.0, 0.0, 4.0, 9.6, "G"), (1, 1, 2, "c", 8.0, 0.0, 4.0, 11.5, "F")], "book_id long, page int, seq int, text string, size double, x0 double, x1 double, top double, fontname string")
    rows = layout.lines(chars).orderBy("top").collect()
    assert [(r["text"], r["size"], r["fontname"], r["x1"]) for r in rows] == [("ab", 10.0, "G", 9.0), ("c", 8.0, "F", 4.0)]


def test_pipeline_control():
    p = Pipeline("p")
    with pytest.raises(ValueError, match="no stage"):
        p.start("x")
    ran = []
    step = lambda n: lambda s: (ran.append(n), s)[1]
    for n in "abc":
        p.stage(n, step(n))
    p.edge("a", "b", lambda s: False).edge("a", "c").start("a").end("c")
    assert p.run(State()).path == ["a", "c"] and "a [" not in p.render() and p.status["b"] == "pending"
    p.reset()
    assert set(p.status.values()) == {"pending"}

    def broken(s):
        raise RuntimeError("no")

    result = chain("q", [("one", broken), ("two", step("two"))]).run(State())
    assert result.error == "one failed: no" and result.status == {"one": "failed", "two": "pending"}


def test_paths(tmp_path):
    good, empty = tmp_path / "a.pdf", tmp_path / "b.pdf"
    good.write_bytes(b"x")
    empty.write_bytes(b"")
    assert source.path_error(str(good)) is None
    other = tmp_path / "a.txt"
    other.write_text("x")
    assert source.path_error(good) is None
    assert [source.path_error(x) for x in ("", None, 3, "/no.pdf", tmp_path, other, str(empty))] == [
        "PDF path is empty or None", "PDF path is empty or None", "PDF path must be a string or Path, got int", "File does not exist: /no.pdf", f"Path is not a file: {tmp_path}", "File is not a PDF (extension: .txt)", f"PDF file is empty: {empty}",
    ]


PAGES = [(7, 1, "1. Start here\n\nThe cnn is a network.\n\nimport numpy"), (7, 2, "2. More\n\nText about a gan and its training."), (7, 3, "the end of it")]


def test_engine(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 600.0, 800.0) for p in PAGES], "book_id long, page int, text string, width double, height double")
    books = spark.createDataFrame([(7, "Nets", "A. Author")], "book_id long, book_title string, author string")
    engine = Engine(spark, f"file://{tmp_path}/store", PRESETS["default"])
    asked = spark.createDataFrame([(1, "implement a cnn"), (2, "??")], "qid long, raw_query string")
    with pytest.raises(ValueError, match="No document indexed"):
        engine.ask(asked)
    for _ in range(2):  # a second time changes nothing
        engine.ingest(pages, books)
    assert engine.store.count() == 1 and engine.stats().first()["total"] == 1
    chapters = engine.chunk(pages, strategy="chapter").orderBy("chunk_index").collect()
    assert [c["chapter_titles"] for c in chapters] == [["1. Start here"], ["2. More"]]
    got = engine.ask(asked).collect()
    assert [r["qid"] for r in got] == [1] and "Here's the retrieved content" in got[0]["response"]["answer"]
    assert engine.ask(asked, book_title="Other").count() == 0
    assert [r["book_title"] for r in engine.store.book_titles().collect()] == ["Nets"]
    own = Engine(spark, f"file://{tmp_path}/store", generator=lambda prompts: prompts.select("qid", F.lit("mine").alias("answer")))
    assert own.ask(asked).first()["response"]["confidence"] == 0.85
    assert engine.full_pipeline().run(State({"pages": pages, "books": books, "questions": asked})).error is None


def test_store_replaces_by_id(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 2)
    s.create()
    rows = records(spark.createDataFrame([(1, 0, "t", [1.0, 2.0])], "book_id long, chunk_index int, text string, embedding array<float>"), "ns")
    s.upsert(rows)
    s.upsert(rows.withColumn("author", F.lit("new")))
    assert [r["author"] for r in s.read("ns").collect()] == ["new"]
    for wrong in (F.array(F.lit(1.0).cast("float")), F.lit(None).cast("array<float>")):
        with pytest.raises(ValueError, match="components"):
            s.upsert(rows.withColumn("embedding", wrong))


def test_store_rewrites_only_the_parts_it_touches(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert not s.exists() and s.read().count() == 0 and s.count() == 0
    rows = lambda books, text, n: records(spark.createDataFrame([(b, i, f"{text} {i}") for b in books for i in range(n)], "book_id long, chunk_index int, text string"), "ns")
    s.upsert(rows(range(40), "old", 3))
    before = s._parts()
    s.upsert(rows([7], "new", 2), whole_books=True)
    after = s._parts()
    assert sum(before[k] != after[k] for k in before) == 1 and set(before) == set(after)
    assert sorted(r["text"] for r in s.read("ns").where("book_id = 7").collect()) == ["new 0", "new 1"]
    assert s.count() == 39 * 3 + 2 and s.read("other").count() == 0
    s.upsert(records(spark.createDataFrame([(7, 5, "more")], "book_id long, chunk_index int, text string"), "b/c"))
    assert s.count("b/c") == 1 and s.count("ns") == 39 * 3 + 2
    s.vacuum()
    assert s.count() == 39 * 3 + 3 and len([x for x in (tmp_path / "s").iterdir() if x.is_dir()]) == 3
    two = [records(spark.createDataFrame([(9, 0, "x", a)], "book_id long, chunk_index int, text string, author string"), "z") for a in ("p", "q")]
    s.upsert(two[0].union(two[1]))
    first = s.read("z").collect()
    s.upsert(two[1].union(two[0]))
    assert len(first) == 1 and s.read("z").collect() == first


def test_streams(spark, tmp_path, small):
    at = str(tmp_path / "in")
    spark.createDataFrame([(*p, 600.0, 800.0, "Nets") for p in PAGES], "book_id long, page int, text string, width double, height double, book_title string").write.parquet(at)
    engine = Engine(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    ingest_stream(engine, stream, str(tmp_path / "check")).awaitTermination(120)
    assert engine.store.count() == 1
    events = spark.read.parquet(f"{small}/events.parquet")
    assert event_windows(events).agg(F.sum("n")).first()[0] == events.count()


def test_answers(spark):
    rows = [(1, i, f"c{i}", "code" if i % 2 else "text", f"content {i}", "ch", "s", 3, 50.0) for i in range(1, 6)]
    hits = spark.createDataFrame(rows, "qid long, position int, chunk_id string, chunk_type string, content string, chapter string, section string, page_number int, relevance_pct double")
    one = answer.answers(hits, degraded=False).first()
    assert one["code_snippets"] == ["content 1", "content 3"] and one["sources"] == ["c1", "c2", "c3"]
    assert answer.context(hits).first()["context"].count("=" * 70) == 4
