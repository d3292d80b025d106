"""Section trees as adjacency lists: nodes(book_id, node_id, parent_id, seq, level, title, number,
start_page, start_idx, confidence, source, path), after fill_ranges with end_page and end_idx. The
root is node 0 and isn't a row. path holds the sequence numbers from the root, so paths sort in
preorder, and ancestors are found by windows over prefixes of the path instead of joins. The depth of
the tree is a parameter: books have chapters, sections and subsections, other trees may go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.plans.tables import met

#: Levels of a book: chapters, sections, subsections.
DEPTH = 3


def from_contents(toc: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes of contents entries of levels 1 to depth; a parent is the nearest entry before of a smaller
    level. Of the last entries of each smaller level, those after all of the levels above them are the ancestors."""
    before = W.partitionBy("book_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("seq")), True).over(before) for k in range(1, depth)]
    rows = toc.withColumn("last__", F.array(*last).cast("array<int>"))
    above = F.slice("last__", 1, F.col("level") - 1)
    up = F.filter(above, lambda x, i: x.isNotNull() & (x > F.coalesce(F.array_max(F.slice("last__", 1, i)), F.lit(-1))))
    rows = rows.withColumn("path", F.concat(up, F.array("seq"))).drop("last__")
    null = F.lit(None).cast("int")
    parent = F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(0)
    return rows.select("book_id", F.col("seq").alias("node_id"), parent.alias("parent_id"), "seq", "level", "title", "number", F.col("page").alias("start_page"), null.alias("start_idx"), F.lit(0.9).alias("confidence"), F.lit("toc").alias("source"), "path")


def merge_headings(nodes: DataFrame, headings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds detected headings (book_id, ord, page, text, level, num, element_idx, confidence), whose ord
    follows their pages. One whose page has a node only lends it its element; others go below the nearest
    node of the level above that begins on their page or before (ties: first in preorder), else below the root.

    An as-of join by windows: nodes and headings of a book lie in one order of (page, number), in which
    each heading takes the last node of the level above that has passed."""
    columns, no = nodes.columns, lambda kind: F.lit(None).cast(kind)
    old = nodes.withColumn("new", F.lit(False)).withColumn("ord", no("long"))
    new = headings.select(
        "book_id", no("int").alias("node_id"), no("int").alias("parent_id"), no("int").alias("seq"), "level", F.col("text").alias("title"), F.col("num").alias("number"), F.col("page").alias("start_page"), F.col("element_idx").cast("int").alias("start_idx"), "confidence",
        F.lit("detected").alias("source"), no("array<int>").alias("path"), F.lit(True).alias("new"), F.col("ord").cast("long").alias("ord"),
    )
    rows, book, page = old.unionByName(new), W.partitionBy("book_id"), W.partitionBy("book_id", "start_page")
    hosts = ~F.col("new") & (F.coalesce("start_page", F.lit(0)) != 0)
    rows = rows.withColumn("top", F.coalesce(F.max(F.when(~F.col("new"), F.col("seq"))).over(book), F.lit(0)))
    rows = rows.withColumn("host", F.max(F.when(hosts, F.struct("path", "node_id"))).over(page)["node_id"])
    lent = F.min(F.when(F.col("new") & F.col("start_idx").isNotNull(), F.struct("ord", "start_idx"))).over(page)["start_idx"]
    rows = rows.withColumn("lent", lent).where("not new or host is null")
    rows = rows.withColumn("start_idx", F.coalesce("start_idx", F.when(F.col("node_id") == F.col("host"), F.col("lent"))))
    seq = (F.col("top") + F.row_number().over(W.partitionBy("book_id", "new").orderBy("ord"))).cast("int")
    rows = rows.withColumn("seq", F.when(F.col("new"), seq).otherwise(F.col("seq"))).withColumn("node_id", F.coalesce("node_id", "seq"))
    root = F.array().cast("array<int>")
    rows = rows.withColumn("path", F.when(F.col("new") & (F.col("level") == 1), F.array("seq")).otherwise(F.col("path")))
    passed = book.orderBy("start_page", "seq").rowsBetween(W.unboundedPreceding, -1)
    same = page.orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    for level in range(2, depth + 1):
        above = (F.col("level") == level - 1) & (F.col("start_page") > 0)
        first = F.min(F.when(above, F.col("path"))).over(same)  # of the nodes of a page so far, the first in preorder
        near = F.last(F.when(above, F.col("first__")), True).over(passed)
        rows = rows.withColumn("first__", first).withColumn("near__", F.when(F.col("start_page") > 0, near))
        own = F.col("new") & (F.col("level") == level)
        rows = rows.withColumn("path", F.when(own, F.concat(F.coalesce("near__", root), F.array("seq"))).otherwise(F.col("path")))
    parent = F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(0)
    return rows.withColumn("parent_id", F.when(F.col("new"), parent).otherwise(F.col("parent_id"))).select(*columns)


def front_matter(nodes: DataFrame) -> DataFrame:
    """Adds a chapter before the first child of the root where that begins after page 1."""
    first = nodes.where("parent_id = 0").groupBy("book_id").agg(F.min(F.coalesce("start_page", F.lit(0))).alias("first")).where("first > 1")
    front = first.select("book_id", F.lit(-1).alias("node_id"), F.lit(0).alias("parent_id"), F.lit(-1).alias("seq"), F.lit(1).alias("level"), F.lit("Front Matter").alias("title"), F.lit(None).cast("string").alias("number"), F.lit(1).alias("start_page"), F.lit(0).alias("start_idx"), F.lit(1.0).alias("confidence"), F.lit("inferred").alias("source"), F.array(F.lit(-1)).alias("path"))
    return nodes.unionByName(front)


def fill_ranges(nodes: DataFrame, books: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds end_page and end_idx: a node ends before its next sibling, and the last where its
    parent ends. books: book_id, total_pages, last_idx."""
    siblings = W.partitionBy("book_id", "parent_id")
    order = siblings.orderBy(F.coalesce("start_page", F.lit(0)), F.coalesce("start_idx", F.lit(0)), "seq")
    before = lambda own: F.when(F.lead(own).over(order).isNull() | (F.lead(own).over(order) == 0), F.col(own)).otherwise(F.lead(own).over(order) - 1)
    rows = met(nodes, books.select("book_id", "total_pages", "last_idx"), "book_id")
    own = F.struct((F.row_number().over(order) == F.count("*").over(siblings)).alias("last"), before("start_page").cast("int").alias("page"), before("start_idx").cast("int").alias("idx"))
    rows = rows.withColumn("own", own).withColumn("page__", F.col("total_pages")).withColumn("idx__", F.col("last_idx"))
    for k in range(1, depth + 1):
        # Of all nodes below a prefix of the path, the first in preorder is the ancestor itself.
        at, inside = F.first("own").over(W.partitionBy("book_id", F.slice("path", 1, k)).orderBy("path")), F.size("path") >= k
        page = F.when(F.col("at__.last"), F.coalesce(F.nullif("page__", F.lit(0)), "total_pages")).otherwise(F.col("at__.page"))
        idx = F.when(F.col("at__.last"), F.col("idx__")).otherwise(F.col("at__.idx"))
        rows = rows.withColumn("at__", at).withColumns({"page__": F.when(inside, page).otherwise(F.col("page__")), "idx__": F.when(inside, idx).otherwise(F.col("idx__"))})
    return rows.select(*nodes.columns, F.col("page__").cast("int").alias("end_page"), F.col("idx__").cast("int").alias("end_idx"))


def chapters(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id = 0 and level = 1")


def dropped(nodes: DataFrame) -> DataFrame:
    """Children of the root that aren't chapters, which chapter chunks leave out."""
    return nodes.where("parent_id = 0 and level != 1")


def at_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.where(F.col("level") == level).orderBy("book_id", "path")


def chapter_sections(nodes: DataFrame) -> DataFrame:
    """Titles and numbers of all sections and subsections of each chapter, in order, repeats kept."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    section = nodes.where("level = 2").select("book_id", F.col("parent_id").alias("chapter_id"), F.col("node_id").alias("section_id"), F.col("seq").alias("s"), blank(F.col("title")).alias("st"), blank(F.col("number")).alias("sn"))
    sub = nodes.where("level = 3").select("book_id", F.col("parent_id").alias("section_id"), F.col("seq").alias("u"), blank(F.col("title")).alias("ut"), blank(F.col("number")).alias("un"))
    listed = lambda x, field: F.transform(F.array_sort(F.collect_list(x)), lambda e: e[field])
    s = section.groupBy("book_id", "chapter_id").agg(listed(F.struct("s", "st"), "st").alias("section_titles"), listed(F.struct("s", "sn"), "sn").alias("section_numbers"))
    u = met(section, sub, ["book_id", "section_id"]).groupBy("book_id", "chapter_id").agg(listed(F.struct("s", "u", "ut"), "ut").alias("subsection_titles"), listed(F.struct("s", "u", "un"), "un").alias("subsection_numbers"))
    heads = chapters(nodes).select("book_id", F.col("node_id").alias("chapter_id"), "title", "number")
    out = met(met(heads, s, ["book_id", "chapter_id"], "left"), u, ["book_id", "chapter_id"], "left")
    empty = F.array().cast("array<string>")
    return out.select("book_id", "chapter_id", "title", "number", *(F.coalesce(c, empty).alias(c) for c in ("section_titles", "section_numbers", "subsection_titles", "subsection_numbers")))


def outline(nodes: DataFrame) -> DataFrame:
    """A printable line for each node in preorder."""
    number = F.when(F.coalesce("number", F.lit("")) != "", F.concat(F.lit("["), "number", F.lit("] "))).otherwise("")
    pages = F.when(F.col("start_page") > 0, F.format_string("p.%s-%s", "start_page", "end_page")).otherwise("no page")
    line = F.concat(F.repeat(F.lit("  "), F.size("path")), number, "title", F.lit(" ("), pages, F.format_string(", confidence=%.2f, source=%s)", "confidence", "source"))
    return nodes.select("book_id", "path", line.alias("line"))


def nested(nodes: DataFrame) -> DataFrame:
    """book_id, node_id, json of each chapter: an object with its children inside, to any depth. Nodes
    in preorder open their object; each closes as many as lie between it and the next."""
    fields = F.struct("title", "level", "number", "start_page", "end_page")
    below = W.partitionBy("book_id", "root").orderBy("path")
    rows = nodes.withColumn("root", F.get("path", F.lit(0))).withColumn("own", F.to_json(fields)).withColumn("depth", F.size("path"))
    comma = F.when(F.lag("depth").over(below) >= F.col("depth"), ",").otherwise("")
    close = F.repeat(F.lit("]}"), F.col("depth") - F.coalesce(F.lead("depth").over(below), F.lit(1)) + 1)
    piece = F.concat(comma, F.expr("substring(own, 1, length(own) - 1)"), F.lit(',"children":['), close)
    rows = rows.select("book_id", "root", "level", "path", piece.alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "piece"))), lambda x: x["piece"]), "")
    out = rows.groupBy("book_id", F.col("root").alias("node_id")).agg(whole.alias("json"), F.min_by("level", "path").alias("level"))
    return out.where("level = 1").drop("level").select("book_id", "node_id", "json")
