"""Books whose pages come in pieces."""

import pandas as pd

from lectern.plans.engine import Engine
from lectern.streaming.gather import Gatherer, ingest_pieces

SCHEMA = "book_id long, book_title string, page int, text string, width double, height double, total_pages int"
PIECES = [
    [(1, "One", 1, "Chapter 1: A\n\nabout a cnn", 600.0, 800.0, 3), (2, "Two", 2, "second page", 600.0, 800.0, None)],
    [(1, "One", 3, "the end", 600.0, 800.0, 3), (3, "Three", 1, "alone", 600.0, 800.0, 1)],
    [(1, "One", 2, "Chapter 2: B\n\nmore of it", 600.0, 800.0, 3), (2, "Two", 1, "first page", 600.0, 800.0, 2)],
]


def write(spark, at, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)


def stream(spark, at):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)


def test_pieces_give_what_whole_books_give(spark, tmp_path):
    at = str(tmp_path / "in")
    for rows in PIECES:
        write(spark, at, rows)
    engine, plain = Engine(spark, f"file://{tmp_path}/a"), Engine(spark, f"file://{tmp_path}/b")
    ingest_pieces(engine, stream(spark, at), str(tmp_path / "check"), strategy="chapter").awaitTermination(180)
    rows = spark.createDataFrame([r for p in PIECES for r in p], SCHEMA)
    plain.ingest(rows.drop("book_title", "total_pages"), rows.selectExpr("book_id", "book_title", "'Unknown' as author").distinct(), strategy="chapter")
    told = lambda e: sorted((r["book_id"], r["chunk_index"], r["text"], r["book_title"], r["page_start"]) for r in e.store.read().collect())
    assert told(engine) == told(plain) and {r[0] for r in told(plain)} >= {1}
    write(spark, at, [(1, "One", 2, "Chapter 2: B\n\nanother text", 600.0, 800.0, 3)])  # a page again: the book as it is now
    ingest_pieces(engine, stream(spark, at), str(tmp_path / "check"), strategy="chapter").awaitTermination(180)
    texts = [r[2] for r in told(engine) if r[0] == 1]
    assert any("another text" in x for x in texts) and not any("more of it" in x for x in texts) and any("cnn" in x for x in texts)


class Kept(dict):
    """State of one book and its timers, without a stream."""

    def __init__(self):
        super().__init__()
        self.value, self.timers = None, set()

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        own = self
        return type("Value", (), {"exists": lambda _: own.value is not None, "get": lambda _: own.value, "update": lambda _, v: setattr(own, "value", v)})()

    updateValue, iterator = dict.__setitem__, dict.items  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_a_book_of_unknown_length_waits():
    held, now = Kept(), type("Now", (), {"getCurrentProcessingTimeInMs": lambda self: self.at})()
    gatherer = Gatherer(100, 1000)
    gatherer.init(held)
    rows = lambda *pages: iter([pd.DataFrame([(5, "Five", p, x, 1.0, 1.0, None) for p, x in pages], columns=[c.split()[0] for c in SCHEMA.split(", ")])])
    now.at = 1000
    assert list(gatherer.handleInputRows((5,), rows((2, "b")), now)) == [] and held.timers == {1100}
    now.at = 1050
    assert list(gatherer.handleInputRows((5,), rows((1, "a"), (None, "cover")), now)) == [] and held.timers == {1150}
    (book,) = gatherer.handleExpiredTimer((5,), now, None)
    assert book[["book_id", "page", "text"]].values.tolist() == [[5, 0, "cover"], [5, 1, "a"], [5, 2, "b"]]
