"""Questions, metadata filters, exact cosine top-k, and heuristic reranking, for batches of
questions."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.config import DEFAULT, Retrieval
from lectern.functions import text as t

#: A batch of questions is broadcast up to so many, and so many bytes of vectors; a larger one is joined in
#: parts of about this size.
QUESTIONS, QUESTION_BYTES = 10_000, 32 << 20
#: Questions that a block of rows is multiplied with at once.
ASKED = 256


def parse_questions(questions: DataFrame, question_col: str = "raw_query") -> DataFrame:
    """Adds intent, topics, keywords, code_language, complexity_hint and errors of each question."""
    q = F.col(question_col)
    error = t.question_error(q)
    return questions.select(
        "*", t.intent(q).alias("intent"), t.topics(q).alias("topics"), t.keywords(q).alias("keywords"), t.code_language(q).alias("code_language"), t.complexity(q).alias("complexity_hint"),
        F.when(error.isNull(), F.array().cast("array<string>")).otherwise(F.array(error)).alias("errors"),
    )


def metadata_filter(book_title: str | None = None, chapter: str | None = None) -> Column:
    """Condition on chunks; no title, "All Books" and an empty chapter filter nothing."""
    out = F.lit(True)
    if book_title and book_title != "All Books":
        out = out & (F.col("book_title") == book_title)
    if chapter:
        out = out & F.array_contains("chapter_numbers", chapter)
    return out


def top_k(chunks: DataFrame, questions: DataFrame, k: int = DEFAULT.retrieval.top_k, chunk_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """qid, chunk_id, similarity, rank of the k nearest chunks of each question. The stated questions
    meet all chunks: they are counted and broadcast, more than QUESTIONS in parts by a hash of their
    qid; each task keeps its own k best before rows are dealt by question."""
    seen = questions.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("width")).first()
    parts = max(1, -(-seen["n"] // QUESTIONS), -(-seen["n"] * 8 * max(0, seen["width"]) // QUESTION_BYTES))
    found = [_nearest(chunks, questions.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) if parts > 1 else questions, k, chunk_id, vector) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _nearest(chunks: DataFrame, questions: DataFrame, k: int, chunk_id: str, vector: str) -> DataFrame:
    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("vector"))
    return nearest(rows, questions.select("qid", F.col(vector).cast("array<double>").alias("vector")), k)


def nearest(rows: DataFrame, questions: DataFrame, k: int, cells: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, similarity, rank of the k nearest of rows (chunk_id, vector) to questions (qid, vector), which are
    broadcast (see QUESTION_BYTES). A task multiplies blocks of its rows with all questions and sends the k best that it
    has met for each. With cells (qid, cell) a question meets the rows of its cells alone.

    Products of matrices add up in an order of their own. Where one lies so near to the middle between two values
    of six decimals that this could matter, the sum is taken again one by one, as the stated cosine takes it."""
    asked = questions.where(F.size("vector") > 0).toPandas()
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, similarity double"
    kinds = [to_arrow_type(rows.schema["chunk_id"].dataType), to_arrow_type(questions.schema["qid"].dataType)]
    by_width = {}
    for n, at in asked.groupby(asked["vector"].map(len)).groups.items():
        x = np.array([[np.nan if v is None else v for v in asked["vector"][i]] for i in at], np.float64)
        by_width[n] = (np.array(at), x, _norms(x))
    wanted = None
    if cells is not None:
        listed = cells.groupBy("qid").agg(F.collect_set("cell").alias("cells")).toPandas()  # a row for each question
        place = {q: i for i, q in enumerate(asked["qid"])}
        wanted = np.zeros((1 + max((max(x) for x in listed["cells"]), default=-1), len(place)), bool)
        for q, x in zip(listed["qid"], listed["cells"], strict=True):
            wanted[np.asarray(x), place[q]] = True
    held = rows.sparkSession.sparkContext.broadcast((asked["qid"].tolist(), by_width, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, by_width, wanted = held.value
        best: dict[int, list[tuple[float, Any]]] = {}
        for batch in batches:
            ids, vectors = batch.column("chunk_id"), batch.column("vector")
            widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            at_cell = batch.column("cell").to_numpy() if wanted is not None else np.zeros(batch.num_rows, np.int64)
            for width, (places, x, norms) in by_width.items():
                for cell in np.unique(at_cell[widths == width]):
                    asks = np.arange(len(places)) if wanted is None else np.flatnonzero(wanted[cell, places])
                    at = np.flatnonzero((widths == width) & (at_cell == cell))
                    if not len(asks) or not len(at):
                        continue
                    y = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                    own = [(i is not None, i) for i in ids.take(pa.array(at)).to_pylist()]  # null comes first
                    y_norm = _norms(y)
                    for s in range(0, len(asks), ASKED):
                        few = asks[s : s + ASKED]
                        _keep(best, places[few], _cosines(x[few], norms[few], y, y_norm), own, k)
        found = [(qids[i], c, -v) for i, xs in best.items() for v, (_, c) in xs]
        columns = [pa.array([f[1] for f in found], kinds[0]), pa.array([f[0] for f in found], kinds[1]), pa.array([f[2] for f in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([columns[1], columns[0], columns[2]], ["qid", "chunk_id", "similarity"])

    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("similarity"), "chunk_id"))
    return rows.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, summed in order."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return np.sqrt(out)


def _cosines(x: np.ndarray, x_norm: np.ndarray, y: np.ndarray, y_norm: np.ndarray) -> np.ndarray:
    """Cosines to six decimals, halves away from zero; NaN where a length is 0."""
    with np.errstate(all="ignore"):
        out = (x @ y.T) / (x_norm[:, None] * y_norm)
        out[~np.isfinite(out)] = np.nan
        scaled = np.abs(out) * 1e6
        a, b = np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5)
        for s in range(0, len(a), 65536):
            i, j = a[s : s + 65536], b[s : s + 65536]
            exact = np.zeros(len(i))
            for d in range(x.shape[1]):
                exact += x[i, d] * y[j, d]
            exact = exact / (x_norm[i] * y_norm[j])
            # As decimal text has it: a value of which that is the middle goes up.
            out[i, j] = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in exact.tolist()]
            scaled[i, j] = np.rint(np.abs(out[i, j]) * 1e6)
        return np.sign(out) * np.floor(scaled + 0.5) / 1e6 + 0.0


def _keep(best: dict[int, list[tuple[float, Any]]], questions: np.ndarray, near: np.ndarray, ids: list[Any], k: int) -> None:
    """Puts the k best of a block beside what a task has of each question: of equal ones, those of the smallest ids."""
    order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
    near = near[:, order]
    for q, row in zip(questions.tolist(), near, strict=True):
        held = best.get(q, [])
        least = -held[-1][0] if len(held) == k else -np.inf
        some = np.flatnonzero(row >= least)  # NaN is left out
        if len(some) > k:
            cut = -np.partition(-row[some], k - 1)[k - 1]
            some = some[row[some] >= cut]
            some = some[np.argsort(-row[some], kind="stable")[:k]]
        if len(some):
            best[q] = sorted([*held, *((-float(row[j]), ids[order[j]]) for j in some.tolist())])[:k]


def relevance(score: Column, over: W, digits: int = 1) -> Column:
    """Percentage of the best score; null where that is 0."""
    return F.round(F.try_divide(score, F.max(score).over(over)) * 100, digits)


def scored(hits: DataFrame, weights: Retrieval = DEFAULT.retrieval) -> DataFrame:
    """Adds rerank to hits (qid, chunk_id, rank, similarity, content, chunk_type and the question's intent,
    topics, keywords): their score, in no order yet (see best_first)."""
    count = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.contains(F.col("lower__"), w)))
    score = weights.similarity * F.col("similarity") + weights.topic * count("topics") + weights.keyword * count("keywords")
    score = score + F.when((F.col("intent") == "code_request") & (F.col("chunk_type") == "code"), weights.code).otherwise(0.0)
    score = score + F.when((F.col("intent") == "conceptual") & (F.col("chunk_type") == "text"), weights.text).otherwise(0.0)
    rows = hits.withColumn("lower__", F.lower(F.coalesce("content", F.lit(""))))
    return rows.withColumn("rerank", F.round(F.least(score, F.lit(1.0)), 6)).drop("lower__")


def best_first() -> tuple[Column, Column]:
    """The order of scored hits: ties keep the order of the search."""
    return F.desc("rerank"), F.col("rank")


def rerank(hits: DataFrame, k: int | None = DEFAULT.retrieval.rerank_k, weights: Retrieval = DEFAULT.retrieval) -> DataFrame:
    """Scores hits and puts them in order. Adds rerank, relevance_pct, position. Without k a question's hits are all
    numbered by one task, texts with them; what needs only the first of many takes scored()."""
    rows = scored(hits, weights)
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy(*best_first())))
    # Each task sends its own k best hits of a question; the best of all is among them.
    rows = rows if k is None else rows.where(F.col("position") <= k)
    return rows.select(*hits.columns, "rerank", relevance(F.col("rerank"), W.partitionBy("qid")).alias("relevance_pct"), "position")


def as_found(hits: DataFrame) -> DataFrame:
    """Hits in the order of the search: rerank is the similarity, relevance_pct its percentage."""
    return hits.withColumn("rerank", F.col("similarity")).withColumn("relevance_pct", F.round(F.col("similarity") * 100, 1)).withColumn("position", F.col("rank"))


def to_hits(chunks: DataFrame) -> DataFrame:
    """Chunk columns as a reader wants them: chapter ("number: title"), section, page, chunk_type."""
    number, title = F.coalesce(F.get("chapter_numbers", F.lit(0)), F.lit("")), F.coalesce(F.get("chapter_titles", F.lit(0)), F.lit(""))
    return chunks.select(
        "chunk_id", F.col("text").alias("content"), F.when(number != "", F.concat_ws(": ", number, title)).otherwise(title).alias("chapter"),
        F.array_join("section_titles", ", ").alias("section"), F.col("page_start").alias("page_number"), F.when(F.col("contains_code"), "code").otherwise("text").alias("chunk_type"),
    )


def display(hits: DataFrame) -> DataFrame:
    """Texts to show for hits, with fallbacks, and all of a row as JSON."""
    known = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(F.col(c))
    return hits.select("qid", "position", known("chapter", "Unknown").alias("chapter"), known("section", "N/A").alias("section"), F.coalesce(F.col("page_number").cast("string"), F.lit("?")).alias("page"), F.format_string("%.2f%%", F.col("similarity") * 100).alias("similarity"), F.to_json(F.struct("chunk_id", "chunk_type", "relevance_pct")).alias("metadata"))
