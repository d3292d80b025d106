"""The engine: ingests books of pages into a store and answers batches of questions."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULT, PRESETS, Config
from lectern.functions.tokens import Tokenizer, lossless
from lectern.functions.vectors import embed
from lectern.operators import answer, cells, chunking, contents, latent, layout, search, sections, tree
from lectern.operators.answer import AnswerGenerator
from lectern.plans.pipeline import Pipeline, State, chain
from lectern.plans.tables import met
from lectern.sources import pages as page_source
from lectern.sources import pdf
from lectern.sources.store import Store, records

#: Hits of a batch of questions that are broadcast to the texts of the store; more are joined.
HITS = 200_000


def set_up_logging(name: str = "lectern", level: str = "INFO", file: str | None = None, layout_: str = "%(asctime)s %(name)s %(levelname)s %(message)s") -> logging.Logger:
    """A logger that writes to the console, and to a file if one is named; set up once."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        for h in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
            h.setFormatter(logging.Formatter(layout_))
            log.addHandler(h)
    return log


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT, tokenizer: Tokenizer = lossless, embedder: Callable[[Column], Column] | None = None, generator: AnswerGenerator | None = None) -> None:
        self.spark, self.config, self.tokenizer, self.generator = spark, config, tokenizer, generator
        self.embedder = embedder or embed(config.dimension)
        self.store = Store(spark, path, config.dimension)
        self.log = set_up_logging(level=config.log_level)

    def _cut(self, rows: DataFrame) -> DataFrame:
        """Ends the plan of a small table that many steps look at: in the folder that executors
        share where one is set, else in memory."""
        return rows.checkpoint() if self.spark.sparkContext.getCheckpointDir() else rows.persist()

    # --- ingestion -----------------------------------------------------------------------------

    def learn(self, texts: DataFrame, text: str = "text", path: str | None = None) -> None:
        """Learns the embedding from texts (see operators/latent.py), before books are ingested; kept at a path
        if one is named."""
        found = latent.fit(texts, text, self.config.dimension)
        if path:
            found.save(self.spark, path)
        self.embedder = found.embed

    def chunk(self, pages: DataFrame, lines: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
        """Chunks of books. pages: book_id, page, text, width, height; lines: see layout.lines."""
        c = self.config.chunking
        books = page_source.page_counts(pages)
        if (strategy or c.strategy) == "flat":
            headings = layout.flat_headings(lines, pages) if lines is not None else self.spark.createDataFrame([], "book_id bigint, ord int, page int, text string, level int, size double")
            return chunking.flat_chunks(pages, sections.sections(headings, books), c.size, c.overlap, c.code_rule, self.tokenizer)
        elements = self._cut(page_source.elements(pages))
        found = [layout.font_headings(lines, pages)] if lines is not None else []
        headings = self._cut(layout.merged_headings(*found, *(layout.element_headings(elements, k) for k in ("type", "pattern"))))
        nodes = self._cut(tree.merge_headings(self._cut(tree.from_contents(contents.entries(elements))), headings))
        last = elements.groupBy("book_id").agg(F.max("idx").alias("last_idx"))
        nodes = self._cut(tree.fill_ranges(tree.front_matter(nodes), books.join(last, "book_id", "left")))
        return chunking.chapter_chunks(tree.chapters(nodes), nodes, elements, c.size, c.overlap, "strict", self.tokenizer)

    def ingest(self, pages: DataFrame, books: DataFrame, lines: DataFrame | None = None, strategy: str | None = None) -> None:
        """Chunks, embeds and stores books. books: book_id, book_title, author."""
        chunks = met(self.chunk(pages, lines, strategy), books.select("book_id", "book_title", "author"), "book_id", "left")
        self.store.upsert(records(chunks.withColumn("embedding", self.embedder(F.col("text"))), self.config.namespace), whole_books=True)

    def read_files(self, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pages, lines and books of all PDF files of a folder. A book is a path; its title is the file's
        name. Files that can't be read have no pages."""
        pdf.register(self.spark)
        book = F.xxhash64("path").alias("book_id")
        pages = self.spark.read.format("pdf").load(path).where("error is null").select(book, "path", "page", "text", "width", "height")
        runs = self.spark.read.format("pdf").option("rows", "runs").load(path).withColumn("book_id", book)
        title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        books = pages.select("book_id", "path").distinct().select("book_id", title.alias("book_title"), F.lit("Unknown").alias("author"))
        return pages.drop("path"), layout.lines_of(runs), books

    def ingest_files(self, path: str, strategy: str | None = None) -> None:
        pages, lines, books = self.read_files(path)
        self.ingest(self._cut(pages), books, self._cut(lines), strategy)

    # --- the index -----------------------------------------------------------------------------

    def build_index(self) -> cells.Cells:
        """Indexes the vectors of the namespace as it is now; an ingestion makes the index void."""
        at = f"{self._index_path()}/{uuid.uuid4().hex}"
        out = cells.build_cells(self.store.read(self.config.namespace), at, ("book_title", "chapter_numbers"))
        self.spark.range(1).selectExpr(f"'{at}' as at").coalesce(1).write.mode("overwrite").text(f"{self._index_path()}/current")
        return out

    def _index_path(self) -> str:
        return f"{self.store.path}-index/{self.config.namespace}-{self.store.version()}"

    def _index(self) -> cells.Cells | None:
        try:
            return cells.Cells(self.spark, self.spark.read.text(f"{self._index_path()}/current").first()["value"])
        except AnalysisException:  # none of this state
            return None

    # --- questions -----------------------------------------------------------------------------

    def query_pipeline(self, rerank: bool = True, book_title: str | None = None, chapter: str | None = None) -> Pipeline:
        """parse, search, rerank, context, answer: each stage adds a table to the state. Of the store, the
        parts that may hold the title and chapter are read, or the vectors of an index of its last state."""
        title, chapter = None if book_title in (None, "", "All Books") else book_title, chapter or None
        r, a = self.config.retrieval, self.config.answers

        def parse(s: State) -> State:
            if s.tables.get("questions") is None:
                s.errors.append("No user query provided")
                return s
            parsed = search.parse_questions(s.tables["questions"])
            s.tables["parsed"], s.tables["rejected"] = parsed.where(F.size("errors") == 0), parsed.where(F.size("errors") > 0)
            return s

        def find(s: State) -> State:
            if not self.store.exists():
                s.errors.append("No document indexed")
                return s
            chunks = self.store.read(self.config.namespace, title, chapter)
            vectors = s.tables["parsed"].withColumn("embedding", self.embedder(F.col("raw_query"))).select("qid", "embedding")
            if index := self._index():
                hits = index.search(vectors, r.top_k, search.metadata_filter(title, chapter))
            else:
                hits = search.top_k(chunks, vectors, r.top_k)
            about = s.tables["parsed"].select("qid", "intent", "topics", "keywords")
            hits = self._cut(hits)  # the search is done once; its texts are looked up by what it found
            few = hits.count() <= HITS
            s.tables["hits"] = search.to_hits(chunks).join(F.broadcast(hits) if few else hits, "chunk_id").join(about, "qid")
            return s

        def order(s: State) -> State:
            if rerank:
                s.tables["ranked"] = search.rerank(s.tables["hits"], r.rerank_k, r)
            else:
                s.tables["ranked"] = search.as_found(s.tables["hits"])
            return s

        def assemble(s: State) -> State:
            s.tables["context"] = answer.context(s.tables["ranked"], a)
            s.tables["prompts"] = answer.prompts(s.tables["parsed"], s.tables["context"])
            return s

        def reason(s: State) -> State:
            s.tables["answers"] = answer.answers(s.tables["ranked"], True, a)
            if self.generator is not None:
                try:
                    texts = self.generator(s.tables["prompts"]).select("qid", F.col("answer").alias("own"))
                    plain = answer.answers(s.tables["ranked"], False, a)
                    s.tables["answers"] = plain.join(texts, "qid").withColumn("answer", F.col("own")).drop("own")
                except Exception:  # the answers out of the hits stand
                    self.log.exception("generator")
            s.tables["responses"] = answer.responses(s.tables["answers"], s.tables["parsed"])
            return s

        return chain("query", [("query_parser", parse), ("vector_search", find), ("reranking", order), ("context_assembly", assemble), ("llm_reasoning", reason)])

    def index_pipeline(self) -> Pipeline:
        """load, index: needs the tables pages and books, and lines if there are."""

        def load(s: State) -> State:
            if s.tables.get("pages") is None or s.tables.get("books") is None:
                s.errors.append("No document provided")
            return s

        def index(s: State) -> State:
            self.ingest(s.tables["pages"], s.tables["books"], s.tables.get("lines"))
            return s

        return chain("index", [("loader", load), ("indexing", index)])

    def full_pipeline(self) -> Pipeline:
        one, two = self.index_pipeline(), self.query_pipeline()
        return chain("full", [*one.stages.items(), *two.stages.items()])

    def ask(self, questions: DataFrame, rerank: bool = True, book_title: str | None = None, chapter: str | None = None) -> DataFrame:
        """Responses of a batch of questions (qid, raw_query)."""
        result = self.query_pipeline(rerank, book_title, chapter).run(State({"questions": questions}))
        if result.error:
            raise ValueError(result.error)
        return result.state.tables["responses"]

    def stats(self) -> DataFrame:
        return self.store.stats(self.config.namespace)


def create_engine(spark: SparkSession, path: str, preset: str = "default") -> Engine:
    return Engine(spark, path, PRESETS[preset])
