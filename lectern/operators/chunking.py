"""Token windows over books, with the pages and sections that they cover.

Overlaps of intervals are joined on (book, stretch): both sides are cut into stretches of a
window's length, so that one long book is spread over tasks and no join is without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions.tokens import Tokenizer, detokenize, lossless
from lectern.plans.tables import met

KINDS = [("chapter", 1), ("section", 2), ("subsection", 3)]


def step_of(size: int, overlap: int) -> int:
    return max(1, size - overlap)


def page_spans(pages: DataFrame, tokenizer: Tokenizer = lossless) -> DataFrame:
    """book_id, page, token_start, token_end and tokens of each page; pages follow without a break."""
    rows = pages.select("book_id", "page", tokenizer(F.col("text")).alias("tokens"))
    end = F.sum(F.size("tokens")).over(W.partitionBy("book_id").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("token_end", end.cast("int")).withColumn("token_start", (F.col("token_end") - F.size("tokens")).cast("int"))


def counted_spans(pages: DataFrame, tokenizer: Tokenizer = lossless) -> DataFrame:
    """The same without the tokens, which are counted where the pages are: their texts aren't shuffled."""
    rows = pages.select("book_id", "page", F.size(tokenizer(F.col("text"))).alias("n"))
    end = F.sum("n").over(W.partitionBy("book_id").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")
    return rows.withColumn("token_end", end).select("book_id", "page", (F.col("token_end") - F.col("n")).alias("token_start"), "token_end")


def placed_windows(spans: DataFrame, size: int, overlap: int) -> DataFrame:
    """Where the windows of books lie (windows without text), out of the spans of their pages."""
    step = step_of(size, overlap)
    total = spans.groupBy("book_id").agg(F.max("token_end").alias("n")).where("n > 0")
    rows = total.select("book_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("token_start"))
    return rows.select("book_id", F.expr(f"int(token_start div {step})").alias("k"), "token_start", F.least(F.col("token_start") + size, "n").alias("token_end"))


def book_tokens(spans: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page", "tokens")))
    return spans.groupBy("book_id").agg(F.flatten(F.transform(ordered, lambda s: s["tokens"])).alias("tokens"))


def windows(rows: DataFrame, key: list[str], size: int, overlap: int, drop_tail: bool = False, text: bool = True) -> DataFrame:
    """key, k, token_start, token_end, text: a window every size - overlap tokens. drop_tail leaves
    out a last window that is shorter than the overlap (but never the first). Without text, windows
    are where they lie alone, and no text is put together."""
    step = step_of(size, overlap)
    rows = rows.where(F.size("tokens") > 0).withColumn("n", F.size("tokens"))
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))
    if drop_tail:
        starts = F.filter(starts, lambda s: ~((s > 0) & (s + size > F.col("n")) & (F.col("n") - s < overlap)))
    # Each window takes its own tokens along, not the book's.
    own = F.transform(starts, lambda s: F.struct(s.alias("s"), *([detokenize(F.slice("tokens", s + 1, size)).alias("text")] if text else [])))
    out = rows.select(*key, "n", F.explode(own).alias("w")).select(*key, "n", F.col("w.s").alias("token_start"), *(["w.text"] if text else []))
    return out.select(*key, F.expr(f"int(token_start div {step})").alias("k"), "token_start", F.least(F.col("token_start") + size, "n").alias("token_end"), *(["text"] if text else []))


def estimate(n: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / step_of(size, overlap))).cast("int")


def _stretches(rows: DataFrame, size: int) -> DataFrame:
    last = F.greatest(F.col("token_start"), F.col("token_end") - 1)
    return rows.withColumn("stretch", F.explode(F.sequence(F.expr(f"int(token_start div {size})"), (last / size).cast("int"))))


def overlaps(left: DataFrame, right: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Pairs of windows and spans of a book that overlap, each once: in the first stretch that it shares. An
    empty span strictly inside a window counts."""
    own = _stretches(left.select("book_id", "k", "token_start", "token_end"), size)
    far = _stretches(right.select("book_id", "token_start", "token_end", *columns), size).withColumnsRenamed({"token_start": "s", "token_end": "e"})
    return met(own, far, ["book_id", "stretch"]).where(f"token_start < e and token_end > s and stretch = greatest(token_start div {size}, s div {size})")


def page_ranges(windows_: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """First and last page of each window (1 where it has none)."""
    found = overlaps(windows_, spans, size, ["page"]).groupBy("book_id", "k").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    one = lambda c: F.coalesce(c, F.lit(1)).cast("int").alias(c)
    return met(windows_, found, ["book_id", "k"], "left").select(*windows_.columns, one("page_start"), one("page_end"))


def section_spans(sections: DataFrame, spans: DataFrame) -> DataFrame:
    """Token spans of sections by their first and last page; a missing or zero end is the book's."""
    total = spans.groupBy("book_id").agg(F.max("token_end").alias("total"))
    start = spans.select("book_id", F.col("page").alias("start_page"), "token_start")
    end = spans.select("book_id", F.col("page").alias("end_page"), "token_end")
    rows = met(met(met(sections, start, ["book_id", "start_page"], "left"), end, ["book_id", "end_page"], "left"), total, "book_id")
    return rows.withColumn("token_start", F.coalesce("token_start", F.lit(0))).withColumn("token_end", F.coalesce(F.nullif("token_end", F.lit(0)), "total")).drop("total")


def window_sections(windows_: DataFrame, sections: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Six arrays of titles and numbers of each window's sections: distinct, in order of first
    appearance, null as the empty text. Sections have an ord of their own in a book; spans are those of its pages.

    Windows meet sections by numbers alone; titles lie beside them once for each book, and windows take theirs there."""
    names = [f"{kind}_{what}" for kind, _ in KINDS for what in ("title", "number")]
    place = F.row_number().over(W.partitionBy("book_id").orderBy("ord")) - 1
    placed = section_spans(sections.select("book_id", "start_page", "end_page", place.alias("place")), spans)
    found = overlaps(windows_, placed, size, ["place"]).groupBy("book_id", "k").agg(F.array_sort(F.collect_list("place")).alias("places"))
    own = [c for c in windows_.columns if c != "book_id"]
    met_ = met(windows_, found, ["book_id", "k"], "left").groupBy("book_id").agg(F.collect_list(F.struct(*own, "places")).alias("windows"))
    named = sections.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", "title", *names))).alias("named"))
    own_sections = lambda w: F.transform(w["places"], lambda i: F.get("named", i))
    rows = met(met_, named, "book_id", "left").select("book_id", F.explode(F.transform("windows", lambda w: F.struct(w.alias("w"), own_sections(w).alias("of")))).alias("x"))
    rows = rows.select("book_id", *(f"x.w.{c}" for c in own), F.col("x.of").alias("of"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    empty = F.array().cast("array<string>")

    def listed(kind: str, level: int, what: str) -> Column:
        title = lambda s: s[f"{kind}_title"]
        use = lambda s: filled(title(s)) | ((s["level"] == level) if level < 3 else F.lit(False))
        value = lambda s: F.when(filled(title(s)), title(s)).otherwise(s["title"]) if what == "titles" else s[f"{kind}_number"]
        found = F.transform(F.filter("of", use), lambda s: F.coalesce(value(s), F.lit("")))
        return F.coalesce(F.array_distinct(found), empty).alias(f"{kind}_{what}")

    arrays = [listed(kind, level, what) for kind, level in KINDS for what in ("titles", "numbers")]
    return rows.select("book_id", *own, *arrays)


def flat_chunks(pages: DataFrame, sections: DataFrame, size: int = 1500, overlap: int = 200, code_rule: str = "broad", tokenizer: Tokenizer = lossless) -> DataFrame:
    """Chunks of whole books with pages, sections and the code flag. Where windows lie and what they meet is found by numbers;
    tokens are shuffled once, by book, and cut there."""
    spans = counted_spans(pages, tokenizer)
    about = window_sections(page_ranges(placed_windows(spans, size, overlap), spans, size), sections, spans, size)
    own = [c for c in about.columns if c != "book_id"]
    cuts = about.groupBy("book_id").agg(F.collect_list(F.struct(*own)).alias("windows"))
    tokens = book_tokens(pages.select("book_id", "page", tokenizer(F.col("text")).alias("tokens")))
    text = lambda w: detokenize(F.slice("tokens", w["token_start"] + 1, size))
    rows = met(tokens, cuts, "book_id").select("book_id", F.explode(F.transform("windows", lambda w: F.struct(w.alias("w"), text(w).alias("text")))).alias("x"))
    rows = rows.select("book_id", F.col("x.w.k").alias("chunk_index"), *(f"x.w.{c}" for c in own if c != "k"), "x.text")
    return rows.withColumn("contains_code", t.contains_code(F.col("text"), code_rule))


def _chapter_parts(chapters: DataFrame, elements: DataFrame, legacy_ranges: bool, columns: list[str]) -> DataFrame:
    """node_id, columns and text of each chapter that has one (see chapter_texts).

    A sweep over numbers alone counts the elements that aren't blank before a chapter's first and after its last one; its
    text is that stretch of its book's. So texts are shuffled once, by book, and stay there for what a book is grouped by next."""
    first = elements.groupBy("book_id", F.col("page").alias("start_page")).agg(F.min("idx").alias("page_idx"))
    rows = chapters if legacy_ranges else met(chapters, first, ["book_id", "start_page"], "left").withColumn("start_idx", F.coalesce("start_idx", "page_idx"))
    low, high = F.greatest(F.coalesce("start_idx", F.lit(0)), F.lit(0)).cast("long"), F.coalesce("end_idx", F.lit(2**31 - 1)).cast("long")
    ends = F.explode(F.array(F.struct(low.alias("at"), F.lit(0).alias("kind")), F.struct((high + 1).alias("at"), F.lit(1).alias("kind"))))
    ends = rows.select("book_id", "node_id", ends.alias("e")).select("book_id", "node_id", "e.at", "e.kind")
    filled = elements.where(t.strip(F.coalesce("text", F.lit(""))) != "").select("book_id", F.col("idx").cast("long").alias("at"), "text")
    keys = ends.unionByName(filled.select("book_id", F.lit(None).cast("int").alias("node_id"), "at", F.lit(2).alias("kind")))
    before = F.count(F.when(F.col("kind") == 2, 1)).over(W.partitionBy("book_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = keys.withColumn("stretch", before).where("kind != 2").groupBy("book_id", "node_id")
    spans = spans.agg(F.max(F.when(F.col("kind") == 0, F.col("stretch"))).alias("a"), F.max(F.when(F.col("kind") == 1, F.col("stretch"))).alias("b")).where("a < b")
    about = met(spans, rows.select("book_id", "node_id", *columns), ["book_id", "node_id"])
    about = about.groupBy("book_id").agg(F.collect_list(F.struct("a", "b", "node_id", *columns)).alias("chapters"))
    parts = filled.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    text = lambda c: F.array_join(F.transform(F.slice("parts", (c["a"] + 1).cast("int"), (c["b"] - c["a"]).cast("int")), lambda p: p["text"]), "\n\n")
    made = F.transform("chapters", lambda c: F.struct(c.alias("of"), text(c).alias("text")))
    joined = met(parts, about, "book_id").select("book_id", F.explode(made).alias("c"))
    return joined.select("book_id", *(f"c.of.{x}" for x in ("node_id", *columns)), "c.text")


def chapter_texts(chapters: DataFrame, elements: DataFrame, legacy_ranges: bool = False) -> DataFrame:
    """Text of each chapter: its elements that aren't blank, joined by blank lines. Where a chapter
    has no first element it begins at the first on its first page (legacy: at element 0). Chapters may overlap."""
    return _chapter_parts(chapters, elements, legacy_ranges, [])


def chapter_chunks(chapters: DataFrame, nodes: DataFrame, elements: DataFrame, size: int = 1500, overlap: int = 200, code_rule: str = "strict", tokenizer: Tokenizer = lossless, legacy_ranges: bool = False) -> DataFrame:
    """Chunks that never cross a chapter, numbered through the book; each lists all sections and
    the page range of its chapter."""
    from lectern.operators.tree import chapter_sections

    lists = ["section_titles", "section_numbers", "subsection_titles", "subsection_numbers"]
    inside = chapter_sections(nodes).withColumnRenamed("chapter_id", "node_id").select("book_id", "node_id", *lists)
    about = met(chapters, inside, ["book_id", "node_id"]).withColumn("first_page", F.col("start_page"))
    columns = ["first_page", "end_page", "title", "number", "seq", *lists]
    texts = _chapter_parts(about, elements, legacy_ranges, columns)
    key = ["book_id", "node_id", *columns]
    rows = windows(texts.select(*key, tokenizer(F.col("text")).alias("tokens")), key, size, overlap, drop_tail=True)
    index = F.row_number().over(W.partitionBy("book_id").orderBy(F.coalesce("first_page", F.lit(0)), "seq", "k")) - 1
    page = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(-1)).cast("int")
    named = lambda c: F.array(F.coalesce(c, F.lit("")))
    return rows.select(
        "book_id", index.cast("int").alias("chunk_index"), "token_start", "token_end", "text", page("first_page").alias("page_start"), page("end_page").alias("page_end"),
        named("title").alias("chapter_titles"), named("number").alias("chapter_numbers"), *lists, t.contains_code(F.col("text"), code_rule).alias("contains_code"),
    )


def book_totals(pages: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """book_id and its numbers of pages, chapters and chunks; every book of pages has a row."""
    counted = lambda rows, name: rows.groupBy("book_id").agg(F.count("*").alias(name))
    out = pages.groupBy("book_id").agg(F.coalesce(F.max("page"), F.lit(0)).cast("int").alias("pages"))
    out = met(met(out, counted(chapters, "chapters"), "book_id", "left"), counted(chunks, "chunks"), "book_id", "left")
    return out.select("book_id", "pages", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chapters", "chunks")))


def linked(chunks: DataFrame) -> DataFrame:
    """Adds prev_id and next_id of each chunk within its book."""
    own = W.partitionBy("book_id").orderBy("chunk_index")
    return chunks.withColumn("prev_id", F.lag("chunk_id").over(own)).withColumn("next_id", F.lead("chunk_id").over(own))
