"""Books whose pages arrive in pieces: pages are kept as state until their book is whole.

A book is given out, all of its pages at once, when it has as many as its rows say (total_pages), or when
none has come for `wait` (which a later batch of the stream finds; under availableNow an open timer may keep the stream running). Its pages stay in the state for `keep`, so a page that comes late, or again, gives the
whole book out anew; the store replaces what it had. Of pages with one number the last that came
stays. State is kept by book, in RocksDB, one entry for each page; a null page number counts as 0."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.plans.engine import Engine

PAGE = "text string, width double, height double"
OUT = f"book_id long, book_title string, page int, {PAGE}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


class Gatherer(StatefulProcessor):
    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait, self.keep = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", PAGE, self.keep)
        self.about = handle.getValueState("about", "title string, total int", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        title, total = self.about.get() if self.about.exists() else (None, None)
        for batch in rows:
            for r in batch.itertuples(index=False):
                self.pages.updateValue((0 if pd.isna(r.page) else int(r.page),), (r.text, r.width, r.height))
                title = title if pd.isna(r.book_title) else r.book_title
                total = total if pd.isna(r.total_pages) else int(r.total_pages)
        self.about.update((title, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if total is not None and sum(1 for _ in self.pages.keys()) >= total:
            yield self._book(key)
        else:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key: Any, timers: Any, expired: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._book(key)

    def _book(self, key: Any) -> pd.DataFrame:
        title = self.about.get()[0] if self.about.exists() else None
        rows = sorted((int(k[0]), *v) for k, v in self.pages.iterator())
        return pd.DataFrame([(int(key[0]), title, *r) for r in rows], columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None: ...


def whole_books(pages: DataFrame, wait_ms: int = 10 * 60_000, keep_ms: int = 30 * DAY) -> DataFrame:
    """Pages (book_id, book_title, page, text, width, height, total_pages: null if not known) of a stream,
    book by book as they become whole."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = pages.select(F.col("book_id").cast("long"), "book_title", F.col("page").cast("int"), "text", F.col("width").cast("double"), F.col("height").cast("double"), F.col("total_pages").cast("int"))
    return own.groupBy("book_id").transformWithStateInPandas(Gatherer(wait_ms, keep_ms), OUT, "Append", "ProcessingTime")


def ingest_pieces(engine: Engine, pages: DataFrame, checkpoint: str, wait_ms: int = 10 * 60_000, strategy: str | None = None) -> StreamingQuery:
    """Starts ingestion of a stream of pages in any order and any batches. A batch that runs again changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        if held.limit(1).count():
            books = held.groupBy("book_id").agg(F.max("book_title").alias("book_title"), F.lit("Unknown").alias("author"))
            engine.ingest(held.drop("book_title"), books, strategy=strategy)
        held.unpersist()

    return whole_books(pages, wait_ms).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
