"""Characters to lines to headings. Order that results depend on is a column, never row order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.plans.tables import met

CHAPTER_CONFIDENCE = {"font": 0.7, "type": 0.8, "pattern": 0.75}


RUN_TYPES = "top double, fontname {font}, first long, n int, text string, lengths array<int>, size_sum double, size_count long, x0_min double, x1_max double"
RUNS = ("book_id", "page", "top", "fontname", "first", "n", "text", "lengths", "size_sum", "size_count", "x0_min", "x1_max")


def _changes(column: pa.Array) -> np.ndarray:
    """Where an entry differs from the one before it."""
    if column.null_count or pa.types.is_floating(column.type) or not pa.types.is_primitive(column.type):
        column = column.dictionary_encode(null_encoding="encode").indices
    values = column.to_numpy(zero_copy_only=False)
    return values[1:] != values[:-1]


def _least(column: pa.Array, at: np.ndarray, sign: float) -> pa.Array:
    """Of each run the least (sign 1) or largest (-1) value that isn't null."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    values = np.fmin.reduceat(np.where(known, sign * column.fill_null(0.0).to_numpy(), np.inf), at)
    return pa.array(sign * values, pa.float64(), mask=~np.logical_or.reduceat(known, at))


def joined_runs(batches: Iterable[pa.RecordBatch], key: str = "book_id") -> Iterator[pa.RecordBatch]:
    """Characters that follow each other in a line as one row: first seq, number, text, lengths where one
    isn't 1; what is asked of their sizes and places."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        top = pc.add(pc.round(batch.column("top"), round_mode="half_to_even"), 0.0)
        for column in (batch.column(key), batch.column("page"), top):
            change[1:] |= _changes(column)
        seq = batch.column("seq").to_numpy()
        change[1:] |= seq[1:] != seq[:-1] + 1
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, n))
        text = pa.concat_arrays([batch.column("text")]).cast(pa.string())
        start = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1]
        joined = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(start[at], start[n:]).astype(np.int32)), text.buffers()[2] or pa.py_buffer(b""))
        length = pc.utf8_length(text).to_numpy()
        odd = np.logical_or.reduceat(length != 1, at)
        lengths = pa.array([length[i : i + k].tolist() if o else None for i, k, o in zip(at, size, odd, strict=True)] if odd.any() else [None] * len(at), pa.list_(pa.int32()))
        # A size of 0 is none.
        sizes = batch.column("size").fill_null(0.0).to_numpy()
        count = np.add.reduceat((sizes != 0).astype(np.int64), at)
        kept = {c: batch.column(c).take(pa.array(at)) for c in (key, "page", "fontname")}
        columns = {**kept, "top": top.take(pa.array(at)), "first": pa.array(seq[at].astype(np.int64)), "n": pa.array(size.astype(np.int32)), "text": joined, "lengths": lengths}
        columns |= {"size_sum": pa.array(np.add.reduceat(sizes, at), mask=count == 0), "size_count": pa.array(count), "x0_min": _least(batch.column("x0"), at, 1.0), "x1_max": _least(batch.column("x1"), at, -1.0)}
        yield pa.RecordBatch.from_pydict({c: columns[c] for c in (key, *RUNS[1:])})


def _spelled(runs: Column) -> Column:
    """The text of sorted runs. Where some overlap (a seq comes twice), of their characters one by one."""

    def one(r: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(r["lengths"], 1, i), F.lit(0), lambda s, x: s + x)
        text = lambda i: F.when(r["lengths"].isNull(), F.substring(r["text"], i + 1, F.lit(1))).otherwise(F.substring(r["text"], before(i) + 1, F.get(r["lengths"], i)))
        return F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda i: F.struct((r["first"] + i).alias("seq"), text(i).alias("text")))

    last = lambda i: F.get(runs, i - 1)["first"] + F.get(runs, i - 1)["n"]
    overlap = F.exists(F.transform(runs, lambda r, i: (i > 0) & (r["first"] < last(i))), lambda x: x)
    chars = F.array_sort(F.flatten(F.transform(runs, one)))
    return F.array_join(F.transform(F.when(overlap, chars.cast("array<struct<seq:bigint,text:string>>")).otherwise(F.transform(runs, lambda r: F.struct(r["first"].alias("seq"), r["text"].alias("text")))), lambda s: s["text"]), "")


def lines(chars: DataFrame) -> DataFrame:
    """Groups characters of a page whose top rounds (half to even) to the same number. Each task joins the characters
    that follow each other before anything is shuffled, so a line moves, not its characters."""
    double = lambda c: F.col(c).cast("double").alias(c)
    rows = chars.select("book_id", "page", double("top"), F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), double("size"), "fontname", double("x0"), double("x1"))
    return lines_of(rows.mapInArrow(joined_runs, _run_schema(rows)))


def _run_schema(chars: DataFrame) -> str:
    kind = dict(chars.dtypes)
    return f"book_id {kind['book_id']}, page {kind['page']}, {RUN_TYPES.format(font=kind['fontname'])}"


def spelled_lines(rows: DataFrame, spell: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], book_id: str = "long", page: str = "int") -> DataFrame:
    """Lines of characters that `spell` makes out of batches of rows (columns as in lines(), tops, sizes and places in double
    precision, seq a long, no text null). They are joined by the task that made them and are never rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from joined_runs(spell(batch))

    return lines_of(rows.mapInArrow(run, f"book_id {book_id}, page {page}, {RUN_TYPES.format(font='string')}"))


def lines_of(runs: DataFrame) -> DataFrame:
    """Lines out of runs of characters (see RUNS)."""
    found = runs.groupBy("book_id", "page", "top").agg(
        F.array_sort(F.collect_list(F.struct("first", "n", "text", "lengths"))).alias("runs"),
        F.coalesce(F.try_divide(F.sum("size_sum"), F.sum("size_count")), F.lit(0.0)).alias("size"),
        F.min_by("fontname", "first").alias("fontname"),
        F.min("x0_min").alias("x0"),
        F.max("x1_max").alias("x1"),
    )
    text = F.when(F.size("runs") == 1, F.get("runs", F.lit(0))["text"]).otherwise(_spelled(F.col("runs")))
    return found.select("book_id", "page", "top", t.strip(text).alias("text"), "size", "fontname", "x0", "x1")


def upper_median(rows: DataFrame, column: str = "size", by: str = "book_id") -> DataFrame:
    """The value at n div 2 of the sorted values of each group: the upper of two middle ones. Values are
    counted first, so a group holds its distinct values, not its rows; a running sum of counts finds the
    middle. Nulls don't count; a group of nulls has none."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n__"))
    group = W.partitionBy(by)
    upto = F.sum("n__").over(group.orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counted.withColumn("upto__", upto).withColumn("middle__", F.shiftright(F.sum("n__").over(group), 1))
    at = (F.col("upto__") > F.col("middle__")) & (F.col("upto__") - F.col("n__") <= F.col("middle__"))
    return ranked.where(at).select(by, F.col(column).alias("median"))


def text_lines(lines_: DataFrame) -> DataFrame:
    return lines_.where(~t.is_monospace(F.col("fontname")) & (F.length("text") >= 3))


def candidates(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines that may be headings: numbered, large, near the top or centered."""
    kept = text_lines(lines_)
    size = pages.select("book_id", "page", "width", "height")
    rows = met(kept, met(size, upper_median(kept), "book_id"), ["book_id", "page"])
    centered = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) < 0.25 * F.col("width")
    return rows.where(t.is_numeric_heading(F.col("text")) | (F.col("size") >= F.col("median") * 1.2) | (F.col("top") < 0.2 * F.col("height")) | centered)


def size_levels(rows: DataFrame) -> DataFrame:
    """Levels by size: the largest distinct size (2 decimals) is 1, the next 2, all others 3."""
    rank = F.dense_rank().over(W.partitionBy("book_id").orderBy(F.desc(F.round("size", 2))))
    return rows.withColumn("level", F.least(rank, F.lit(3)).cast("int"))


def flat_headings(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, ord, page, text, level, size; on a page, deeper levels come first."""
    order = W.partitionBy("book_id").orderBy("page", F.desc("level"), "top", "x0")
    rows = size_levels(candidates(lines_, pages))
    return rows.select("book_id", F.row_number().over(order).alias("ord"), "page", "text", "level", "size")


def _headings(rows: DataFrame, source: str, size: F.Column, median: F.Column, element: F.Column) -> DataFrame:
    text = F.col("text")
    return rows.select(
        "book_id", "page", "seq", text, t.heading_level(text, size, median).alias("level"), t.chapter_number(text).alias("num"),
        element.cast("int").alias("element_idx"), F.lit(CHAPTER_CONFIDENCE[source]).alias("confidence"), F.lit(source).alias("source"),
    )


def font_headings(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    median = upper_median(lines_.where("size > 0"))
    size = met(pages.select("book_id", "page", "width", "height"), median, "book_id")
    rows = met(lines_.where(F.length("text") >= 3), size, ["book_id", "page"])
    centered = (F.abs(F.col("x0") + F.col("x1") - F.col("width")) / F.col("width") < 0.2) & (F.col("top") < 0.3 * F.col("height"))
    rows = rows.where((F.col("size") >= F.col("median") * 1.2) | t.is_chapter_heading(F.col("text")) | centered)
    seq = F.row_number().over(W.partitionBy("book_id").orderBy("page", "top", "x0"))
    return _headings(rows.withColumn("seq", seq), "font", F.col("size"), F.col("median"), F.lit(None))


def element_headings(elements: DataFrame, source: str) -> DataFrame:
    """Headings among elements by their type ("type") or by a chapter pattern ("pattern")."""
    text = t.strip(F.coalesce("text", F.lit("")))
    rows = elements.select("book_id", "page", F.col("idx").alias("seq"), text.alias("text"), "type", "idx").where("text != ''")
    test = F.lower("type").rlike("title|heading") if source == "type" else t.is_chapter_heading(F.col("text"))
    return _headings(rows.where(test), source, F.lit(14.0), F.lit(12.0), F.col("idx"))


def merged_headings(*strategies: DataFrame) -> DataFrame:
    """Union of strategies, in priority order; of headings of a page with the same first 50
    characters the first stays."""
    rows = None
    for k, s in enumerate(strategies):
        s = s.withColumn("strategy", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    first = W.partitionBy("book_id", "page", F.substring(t.strip(F.col("text")), 1, 50)).orderBy("strategy", "seq")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    order = W.partitionBy("book_id").orderBy(F.coalesce("page", F.lit(0)), F.desc("level"), "strategy", "seq")
    return rows.withColumn("ord", F.row_number().over(order)).drop("strategy")
