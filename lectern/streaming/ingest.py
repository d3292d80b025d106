"""Extension: books that arrive over time go into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.plans.engine import Engine


def ingest_stream(engine: Engine, pages: DataFrame, checkpoint: str, title: str = "book_title") -> StreamingQuery:
    """Starts ingestion of a stream of pages (book_id, book_title, page, text, width, height). A book's
    pages come in one batch. Ids come from content, so a batch that runs again changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        books = batch.groupBy("book_id").agg(F.first(title).alias("book_title"), F.lit("Unknown").alias("author"))
        engine.ingest(batch.drop(title), books)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts and sums of events by type and tumbling window; rows later than late go."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
