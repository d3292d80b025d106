"""Tables of contents: where they are in a book's elements, and their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.plans.tables import met

#: Elements of a book among which contents are looked for, and how far they go from there.
NAMED, REACH = 100, 500


def region(elements: DataFrame) -> DataFrame:
    """book_id, start_idx, end_idx of books that have a table of contents: a short element with a
    keyword among the first 100, up to where the main text begins after more than 5 entries."""
    text = t.strip(F.coalesce("text", F.lit("")))
    # What is asked of a text is told before rows are dealt by book, and the text stays behind.
    long = (F.length("text") > 200) | F.col("text").rlike(r"(?i)^(chapter|introduction|preface)\s+\d+")
    head = elements.select("book_id", "idx", text.alias("text")).where(F.col("idx") < NAMED + REACH)
    named = (F.col("idx") < NAMED) & (F.length("text") < 50) & t.has_any(F.lower("text"), t.CONTENTS_KEYWORDS)
    rows = head.select("book_id", "idx", named.alias("named"), (F.col("text") != "").alias("filled"), t.is_contents_line(F.col("text")).alias("entry"), long.alias("long"))
    book = W.partitionBy("book_id")
    rows = rows.withColumn("start_idx", F.min(F.when(F.col("named"), F.col("idx"))).over(book))
    near = rows.where(F.col("filled") & (F.col("idx") > F.col("start_idx")) & (F.col("idx") < F.col("start_idx") + REACH))
    near = near.withColumn("seen", F.sum(F.col("entry").cast("int")).over(book.orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)))
    main = ~F.col("entry") & (F.col("seen") > 5) & F.col("long")
    near = near.withColumn("stop", F.min(F.when(main, F.col("idx"))).over(book))
    found = near.where("stop is null or idx <= stop").groupBy("book_id", "start_idx", "stop").agg(F.max("seen").alias("entries")).where("entries > 3")
    last = elements.groupBy("book_id").agg(F.max("idx").alias("last_idx"))
    end = F.coalesce(F.col("stop") - 1, F.least(F.col("start_idx") + 400, F.col("last_idx")))
    return met(found, last, "book_id").select("book_id", "start_idx", end.cast("int").alias("end_idx"))


def entries(elements: DataFrame) -> DataFrame:
    """book_id, seq, title, number, page, level, raw_text of the entries of each table of contents,
    without pages over 9999 and repeats of (page, title); books with under 3 entries have none."""
    near = elements.where(F.col("idx") < NAMED + REACH)  # no region reaches further
    rows = near.select("book_id", "idx", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    # Few lines end in a page, which needs no stripping to be told.
    rows = rows.where(t.ends_in_page(F.col("line"))).withColumn("raw_text", t.strip(F.col("line"))).where(~F.lower("raw_text").isin(t.CONTENTS_KEYWORDS) & t.is_contents_line(F.col("raw_text")))
    rows = met(rows, region(elements), "book_id").where("idx > start_idx and idx <= end_idx")
    # Exploded, so that a line is parsed once: a condition on a column is put before it as another parse.
    rows = rows.select("*", F.explode(F.filter(F.array(t.contents_entry(F.col("raw_text"))), lambda e: e.isNotNull())).alias("e"))
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("book_id"))).where("n >= 3 and e.page <= 9999")
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("book_id", "e.page", "e.title").orderBy("idx", "pos"))).where("r = 1")
    seq = F.row_number().over(W.partitionBy("book_id").orderBy("idx", "pos"))
    return rows.select("book_id", seq.alias("seq"), F.col("e.title").alias("title"), F.col("e.number").alias("number"), F.col("e.page").cast("int").alias("page"), F.col("e.level").alias("level"), "raw_text")
