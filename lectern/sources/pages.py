"""Page and element sources. Extracted pages and characters are tables; a parser of document files
is a plug-in over binary files, as none comes with the engine."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as t

PAGE_SCHEMA = "path string, page int, text string, width double, height double"
#: Parses one file's bytes into (page from 1, text, width, height).
Parser = Callable[[bytes], Iterable[tuple[int, str, float, float]]]


# What is said of a path that can't be read.
NO_PATH = "PDF path is empty or None"
NOT_A_PATH = "PDF path must be a string or Path, got "
MISSING = "File does not exist: "
NO_FILE = "Path is not a file: "
NOT_A_PDF = "File is not a PDF (extension: "
UNREADABLE = "File is not readable: "
EMPTY_FILE = "PDF file is empty: "


def path_error(path: str | os.PathLike[str] | None) -> str | None:
    """Why a document path can't be read, or None; the first reason holds."""
    if not path:
        return NO_PATH
    if not isinstance(path, str | Path):
        return NOT_A_PATH + type(path).__name__
    suffix = Path(path).suffix
    for fails, message in (
        (lambda: not os.path.exists(path), f"{MISSING}{path}"),
        (lambda: not os.path.isfile(path), f"{NO_FILE}{path}"),
        (lambda: suffix.lower() != ".pdf", f"{NOT_A_PDF}{suffix})"),
        (lambda: not os.access(path, os.R_OK), f"{UNREADABLE}{path}"),
        (lambda: os.path.getsize(path) == 0, f"{EMPTY_FILE}{path}"),
    ):
        if fails():
            return message
    return None


def file_error(path: Column, length: Column) -> Column:
    """The same over a listing of files."""
    suffix = F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)
    return F.when(F.coalesce(path, F.lit("")) == "", NO_PATH).when(F.lower(suffix) != ".pdf", F.concat(F.lit(NOT_A_PDF), suffix, F.lit(")"))).when(length == 0, F.concat(F.lit(EMPTY_FILE), path))


def parsed_pages(spark: SparkSession, glob: str, parser: Parser) -> DataFrame:
    """Pages of all files that match, each file parsed by a task."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                yield pd.DataFrame([(path, *page) for page in parser(bytes(content))], columns=["path", "page", "text", "width", "height"])

    files = spark.read.format("binaryFile").load(glob).where(file_error(F.col("path"), F.col("length")).isNull())
    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def elements(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Paragraphs of pages, numbered through each book: book_id, idx, page, type, text."""
    rows = pages.select("book_id", "page", F.posexplode(F.split("text", separator)).alias("pos", "part"))
    rows = rows.withColumn("text", t.strip(F.col("part"))).where("text != ''")
    idx = F.row_number().over(W.partitionBy("book_id").orderBy("page", "pos")) - 1
    return rows.select("book_id", idx.cast("int").alias("idx"), "page", F.lit("NarrativeText").alias("type"), "text")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.coalesce(F.max("page"), F.lit(0)).cast("int").alias("total_pages"))
