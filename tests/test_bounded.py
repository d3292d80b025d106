"""What a task, the driver or a disk holds doesn't grow with a group or with all rows."""

from pyspark.sql import functions as F

from lectern.operators import answer, search
from lectern.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_bring_few_hits_together(spark, small):
    """Each task sends its first hits alone; no list of all hits of a question."""
    assert plan(QUERIES["answer_snippets"](spark, small)).count("WindowGroupLimit") >= 4
    hits = spark.range(50).select(F.lit(1).alias("qid"), F.col("id").alias("chunk_id"), F.when(F.col("id") % 20 == 19, "code").otherwise("text").alias("chunk_type"), F.concat(F.lit("text "), "id").alias("content"), F.lit("c").alias("chapter"), (50 - F.col("id")).alias("position"))
    row = answer.answers(hits.repartition(5), degraded=False).first()
    assert row["code_snippets"] == ["text 39", "text 19"] and row["sources"][:3] == [49, 48, 47] and "From c:\ntext 49..." in row["answer"]
    assert answer.answers(search.scored(hits.where("chunk_id < 0").withColumns({"rank": F.lit(1), "similarity": F.lit(0.5), "intent": F.lit(""), "topics": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>")})), order=search.best_first()).count() == 0


def test_trees_and_chapters_are_joined_by_shuffle(spark, small):
    """Tables that grow with the books don't go through the driver, however small their files are."""
    for name in ("tree_ranges", "chapter_chunks", "chunk_sections", "heading_dedup"):
        assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, small)), name


def test_lines_move_not_their_characters(spark):
    """A character in any order, doubled, of many letters or none; each task sends runs."""
    from lectern.operators import layout

    data = [(1, 1, i, c, 10.0 if i % 2 else 0.0, "F" if i else "G", float(i), i + 1.0, 3.5 if i < 4 else 12.25) for i, c in enumerate("abcdéf😀h")]
    data += [(1, 1, 2, "C", None, "F", 0.5, 9.0, 4.0), (1, 1, 20, "ffi", 8.0, "F", 1.0, 2.0, 12.0), (1, 1, 21, None, 8.0, "F", None, 2.0, 12.0), (2, 1, 5, " x", 8.0, "F", 1.0, 2.0, 0.2), (2, 1, 3, "y", 8.0, "F", 1.0, 2.0, -0.2)]
    names = "book_id long, page int, seq int, text string, size double, fontname string, x0 double, x1 double, top double"
    want = {(1, 4.0): ("abCcd", 10.0, "G", 0.0, 9.0), (1, 12.0): ("éf😀hffi", (10.0 * 2 + 16) / 4, "F", 1.0, 8.0), (2, 0.0): ("y x", 8.0, "F", 1.0, 2.0)}
    for rows in (data, data[::-1], data[::2] + data[1::2]):
        for parts in (1, 3):
            found = layout.lines(spark.createDataFrame(rows, names).coalesce(1) if parts == 1 else spark.createDataFrame(rows, names).repartition(3))
            assert {(r["book_id"], r["top"]): (r["text"], r["size"], r["fontname"], r["x0"], r["x1"]) for r in found.collect()} == want


def test_books_lie_in_many_folders(spark):
    """No folder holds all files; pages are counted without reading their texts."""
    from lectern.plans.tables import shared_dir
    from lectern.sources import pdf, pdf_files

    at = f"{shared_dir(spark)}/files"
    pages = spark.range(40).select(F.col("id").alias("book_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("page"), F.concat(F.lit("é of "), "id").alias("text"))
    made = pdf_files.write_books(pages.orderBy(F.desc("page")), at, pdf_files.FOLDERS).collect()
    assert len(made) == 40 and len({r["path"].rsplit("/", 1)[0] for r in made}) == 40 and {r["pages"] for r in made} == {2}
    pdf.register(spark)
    found = spark.read.format("pdf").load(at).collect()
    assert sorted((pdf_id, r["page"], r["text"]) for r in found for pdf_id in [int(r["path"].rsplit("/", 1)[1][:-4])]) == [(i, p, f"é of {i}") for i in range(40) for p in (1, 2)]
    counted = spark.read.format("pdf").option("texts", False).load(at)
    assert counted.count() == 80 and counted.where("text is not null").count() == 0


def test_searches_multiply_blocks(spark, small):
    """No row for each pair of question and vector; sums near a middle of two values are taken one by one."""
    import numpy as np

    made = plan(QUERIES["vector_topk"](spark, small))
    assert "NestedLoop" not in made and "MapInArrow" in made
    x, y = np.array([[1.0, 0.0]]), np.array([[0.1234565, np.sqrt(1 - 0.1234565**2)], [-1.0, 0.0], [0.0, 0.0]])
    found = search._cosines(x, search._norms(x), y, np.array([1.0, 1.0, 0.0]))[0]
    assert found[:2].tolist() == [0.123457, -1.0] and np.isnan(found[2])
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20, 0, -1)] + [(0, [1.0, 1.0]), (99, None), (98, [0.0, 0.0]), (97, [1.0, None]), (96, [1.0])], "id long, embedding array<double>").repartition(3)
    found = search.top_k(rows, spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "qid long, embedding array<double>"), 3, "id").collect()
    assert sorted((r["qid"], r["chunk_id"], r["similarity"], r["rank"]) for r in found) == [(7, 1, 1.0, 1), (7, 2, 1.0, 2), (7, 3, 1.0, 3)]


def test_section_windows_shuffle_no_tokens(spark, small):
    made = plan(QUERIES["chunk_sections"](spark, small))
    assert "flatten" not in made and "collect_list(struct(pos" not in made


def test_characters_are_never_rows(spark, small):
    """A task makes the characters of its texts and joins them at once, whatever letters they are."""
    from lectern.operators import layout
    from lectern.queries import _characters

    assert "Generate" not in plan(QUERIES["line_group"](spark, small))
    texts = [(1, "aé😀\nb " * 30), (2, ""), (3, None), (4, "  x"), (5, "日本" * 50)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    i = F.col("i") + 1
    chars = rows.select("doc_id", F.posexplode(F.split("text", "")).alias("i", "text")).where("text != ''").withColumn("i", i)
    i = F.col("i")
    chars = chars.select(F.col("doc_id").alias("book_id"), F.lit(1).alias("page"), i.alias("seq"), "text", F.when(i % 3 != 0, 8.0 + i % 3).otherwise(0.0).alias("size"), F.lit("Serif").alias("fontname"), (i * 5.0).alias("x0"), (i * 5.0 + 5).alias("x1"), (F.floor(i / 40) * 10 + 0.25 * (i % 2)).alias("top"))
    got, want = (sorted(map(tuple, x.collect())) for x in (layout.spelled_lines(rows.where("text != ''"), _characters), layout.lines(chars)))
    assert got == want and len(got) == 5 + 1 + 3


def test_lines_of_files_are_read_as_runs(spark, small, monkeypatch):
    """Characters of files are joined by the task that reads them; their lines are those of the characters."""
    from lectern.operators import layout
    from lectern.plans.tables import shared_dir
    from lectern.sources import pdf, pdf_files

    monkeypatch.setattr(layout, "lines", None)  # of rows of characters
    assert QUERIES["pdf_lines"](spark, small).limit(1).count() == 1
    monkeypatch.undo()
    at = f"{shared_dir(spark)}/files"
    pages = spark.range(7).select(F.col("id").alias("book_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), F.concat(F.lit("  é of "), "id", F.lit("\n\n\U0001F600 second  line ")).alias("text"))
    pdf_files.write_books(pages, at).count()
    pdf.register(spark)
    read = lambda kind: spark.read.format("pdf").option("rows", kind).load(at).withColumn("book_id", pdf_files.book_of("path"))
    runs, chars = read("runs"), read("chars")
    assert runs.count() == 7 * 3 * 2 < chars.count()
    got, want = (sorted(map(tuple, x.collect())) for x in (layout.lines_of(runs), layout.lines(chars)))
    assert got == want and len(got) == 7 * 3 * 2


def shuffled(df):
    """Names of the columns of each shuffle."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_chapters_shuffle_texts_once(spark, small):
    """Elements are gathered by book; neither they nor the chunks are dealt again, and no copy of them is written."""
    own = shuffled(QUERIES["chapter_chunks"](spark, small))
    assert len(own) > 5 and not any({"text", "part", "tokens"} & x for x in own if "book_id" in x and "u" not in x)  # u: lines of contents


def test_windows_meet_sections_by_numbers(spark, small):
    """Titles are dealt by book alone, not to windows, pages or stretches."""
    own = shuffled(QUERIES["chunk_sections"](spark, small))
    assert len(own) > 5 and not any("title" in x and {"k", "stretch", "token_start", "token_end"} & x for x in own)


def test_flat_chunks_shuffle_tokens_once(spark, small):
    from lectern.operators import chunking
    from lectern.queries import _pages

    headings = spark.createDataFrame([(1, 1, "A", 1, 1, 2, "A", "1", None, None, None, None), (1, 2, "B", 2, 3, 9, "A", "1", "B", None, None, None)], "book_id long, ord int, title string, level int, start_page int, end_page int, chapter_title string, chapter_number string, section_title string, section_number string, subsection_title string, subsection_number string")
    rows = chunking.flat_chunks(_pages(spark, small), headings, 100, 20)
    own = shuffled(rows)
    assert len(own) > 5 and not any({"text", "tokens"} & x for x in own if "book_id" in x)
    pages = spark.createDataFrame([(1, i, " ".join(f"w{i}" for _ in range(5))) for i in range(1, 10)] + [(2, 1, "x y"), (3, 1, None)], "book_id long, page int, text string")
    got = {(r["book_id"], r["chunk_index"]): (r["page_start"], r["page_end"], r["chapter_titles"], r["chapter_numbers"], r["section_titles"], r["section_numbers"]) for r in chunking.flat_chunks(pages, headings, 10, 5).collect()}
    assert got[1, 0] == (1, 2, ["A"], ["1"], [], []) and got[1, 1] == (2, 3, ["A"], ["1"], ["B"], [""]) and got[1, 5] == (6, 7, ["A"], ["1"], ["B"], [""]) and {b for b, _ in got} == {1, 2}


def test_ids_that_come_once_deal_no_rows(spark, small, monkeypatch):
    from lectern.plans.tables import shared_dir
    from lectern.sources import store

    told, upserted = [], store.upserted
    monkeypatch.setattr(store, "upserted", lambda old, new, gone, again: (told.append(again), upserted(old, new, gone, again))[1])
    rows = store.records(spark.range(20).select(F.col("id").alias("book_id"), F.lit(0).alias("chunk_index"), F.lit("x").alias("text")), "ns")
    own = store.Store(spark, shared_dir(spark))
    own.upsert(rows)
    own.upsert(rows.union(rows))
    assert told == [False, True] and own.read("ns").count() == own.count("ns") == 20
