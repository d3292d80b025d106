"""Sections of a book from its headings (flat path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.plans.tables import met

COLUMNS = ["book_id", "ord", "title", "level", "start_page", "end_page", "chapter_title", "chapter_number", "section_title", "section_number", "subsection_title", "subsection_number"]


def raw_sections(headings: DataFrame, books: DataFrame) -> DataFrame:
    """A section for each heading (book_id, ord, page, text, level): it ends before the next heading
    of its level or above, and knows the nearest heading of each level above it."""
    own = W.partitionBy("book_id").orderBy("ord")
    after, before = own.rowsBetween(1, W.unboundedFollowing), own.rowsBetween(W.unboundedPreceding, -1)
    rows = met(headings, books.select("book_id", "total_pages"), "book_id").withColumn("name", F.struct(t.heading_title(F.col("text")).alias("title"), t.heading_number(F.col("text")).alias("number")))
    end = F.when(F.col("level") == 1, F.first(F.when(F.col("level") <= 1, F.col("page") - 1), True).over(after))
    end = end.when(F.col("level") == 2, F.first(F.when(F.col("level") <= 2, F.col("page") - 1), True).over(after)).otherwise(F.first(F.col("page") - 1, True).over(after))
    up = {k: F.last(F.when(F.col("level") == k, F.col("name")), True).over(before) for k in (1, 2)}
    rows = rows.withColumn("end_page", F.coalesce(end, "total_pages")).withColumn("up1", up[1]).withColumn("up2", up[2])
    chapter = F.when(F.col("level") == 1, F.col("name")).otherwise(F.col("up1"))
    section = F.when(F.col("level") == 2, F.col("name")).when(F.col("level") == 3, F.col("up2"))
    sub = F.when(F.col("level") == 3, F.col("name"))
    named = [x for kind, s in (("chapter", chapter), ("section", section), ("subsection", sub)) for x in (s["title"].alias(f"{kind}_title"), s["number"].alias(f"{kind}_number"))]
    return rows.select("book_id", "ord", F.col("text").alias("title"), "level", F.col("page").alias("start_page"), "end_page", *named, "total_pages")


def sections(headings: DataFrame, books: DataFrame) -> DataFrame:
    """Sections by start page, with front matter before the first and without gaps; a book without
    headings is one section."""
    rows = raw_sections(headings, books)
    none = F.lit(None).cast("string")
    bare = [none.alias(x) for x in COLUMNS[6:]]
    first = rows.groupBy("book_id", "total_pages").agg(F.min("start_page").alias("first")).where("first > 1")
    front = first.select("book_id", F.lit(0).alias("ord"), F.lit("Front Matter").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("start_page"), (F.col("first") - 1).alias("end_page"), F.lit("Front Matter").alias("chapter_title"), *bare[1:], "total_pages")
    whole = met(books, headings.select("book_id").distinct(), "book_id", "left_anti")
    whole = whole.select("book_id", F.lit(1).alias("ord"), F.lit("Full Book").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("start_page"), F.col("total_pages").alias("end_page"), *bare, "total_pages")
    own = W.partitionBy("book_id").orderBy("start_page", "ord")
    follow = F.lead("start_page").over(own)
    rows = rows.unionByName(front).withColumn("end_page", F.when(follow.isNull(), F.greatest("end_page", "total_pages")).otherwise(F.greatest(F.col("end_page"), follow - 1)))
    rows = rows.unionByName(whole).withColumn("ord", F.row_number().over(own))
    return rows.select(*COLUMNS)
