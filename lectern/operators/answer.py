"""Context, prompts and answers from ranked hits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Answers
from lectern.functions import text as t

# Texts of contexts and of answers without a generator.
SOURCE = "[SOURCE %d]\nChapter: %s\nSection: %s\nPage: %s\nType: %s\nRelevance: %s%%\n\n"
FAILED = "Error calling LLM. Here's the retrieved content:\n\nFrom "
SEPARATOR, LEGACY_SEPARATOR = "\n" + "=" * 70 + "\n", "\n{'='*70}\n"


def context(hits: DataFrame, settings: Answers = DEFAULT.answers) -> DataFrame:
    """qid, context: the sources of each question in order, joined by a rule."""
    block = F.concat(
        F.format_string(SOURCE, F.col("position").cast("int"), F.coalesce("chapter", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.when(F.col("chunk_type") == "code", "CODE").otherwise("TEXT"), F.coalesce(F.col("relevance_pct").cast("string"), F.lit(""))),
        F.coalesce("content", F.lit("")), F.lit("\n"),
    )
    parts = F.array_sort(F.collect_list(F.struct("position", block.alias("block"))))
    rule = LEGACY_SEPARATOR if settings.legacy_separator else SEPARATOR
    return hits.groupBy("qid").agg(F.array_join(F.transform(parts, lambda p: p["block"]), rule).alias("context"))


class AnswerGenerator(Protocol):
    """Turns rows (qid, raw_query, system_prompt, context, hits) into answers."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


def answers(hits: DataFrame, degraded: bool = True, settings: Answers = DEFAULT.answers, order: Sequence[str | Column] = ("position",)) -> DataFrame:
    """An answer for each question out of its hits alone: where the best one is from and its first
    characters, code snippets, sources and confidence. It stands in for a generator that is absent
    or failed (degraded). order: what puts a question's hits in order. Of them only the first ones and the first
    with code are brought together (each task sends its own), however many there are."""
    own = W.partitionBy("qid").orderBy(*order)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)

    def first(rows: DataFrame, n: int, *columns: str | Column) -> DataFrame:
        rows = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= n)
        return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", *columns))).alias("hits"))

    rows = first(hits, max(1, settings.sources), "chunk_id", blank("chapter"), F.substring(blank("content"), 1, settings.fallback_chars).alias("content"))
    empty = F.array().cast("array<string>")
    if degraded:
        rows = rows.withColumn("code_snippets", empty)
    else:
        code = first(hits.where("chunk_type = 'code'"), settings.snippets, blank("content"))
        code = code.select("qid", F.transform("hits", lambda h: h["content"]).alias("code_snippets"))
        rows = rows.join(code, "qid", "left").withColumn("code_snippets", F.coalesce("code_snippets", empty))
    best = F.element_at("hits", 1)
    text = F.concat(F.lit(FAILED), best["chapter"], F.lit(":\n"), best["content"], F.lit("..."))
    return rows.select(
        "qid", text.alias("answer"), "code_snippets", F.slice(F.transform("hits", lambda h: h["chunk_id"]), 1, settings.sources).alias("sources"),
        F.lit(settings.degraded_confidence if degraded else settings.confidence).alias("confidence"), F.lit(degraded).alias("degraded"),
    )


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, raw_query, system_prompt, context of parsed questions."""
    prompt = t.system_prompt(F.col("intent"), F.col("complexity_hint"))
    return questions.select("qid", "raw_query", prompt.alias("system_prompt")).join(contexts, "qid")


def responses(answers_: DataFrame, questions: DataFrame) -> DataFrame:
    """The whole response of each question as a struct and as JSON."""
    about = questions.select("qid", F.struct("intent", "topics", "keywords", "complexity_hint").alias("query_info"))
    rows = answers_.join(about, "qid")
    whole = F.struct("answer", "code_snippets", "sources", "confidence", "query_info")
    return rows.select("qid", whole.alias("response"), F.to_json(whole).alias("json"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), F.count_if("contains_code").alias("code"), F.count_if(~F.col("contains_code")).alias("text"))


def history(rows: DataFrame, n: int = 5, order: str = "seq") -> DataFrame:
    """The n latest questions."""
    return rows.orderBy(F.desc(order)).limit(n)
