"""Growth, statistics, pruning and conflicts of the store, and the engine's index."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import store as store_module
from lectern.sources.store import Conflict, Store, records


def chunks(spark, books, n=2, title=lambda b: f"T{b % 5}", text="x"):
    rows = [(b, title(b), i, f"{text} {i}", [str(b % 7), None], b % 2 == 0) for b in books for i in range(n)]
    return records(spark.createDataFrame(rows, "book_id long, book_title string, chunk_index int, text string, chapter_numbers array<string>, contains_code boolean"), "ns")


def test_statistics_need_no_scan_and_filters_prune(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.upsert(chunks(spark, range(60)))
    assert s.count("ns") == 120 and s.count() == 120 and s.count("other") == 0
    assert s.stats("ns").first().asDict() == {"total": 120, "code": 60, "text": 60}
    assert [r["book_title"] for r in s.book_titles("ns").collect()] == [f"T{i}" for i in range(5)]
    s.upsert(chunks(spark, [3], 5, lambda b: "New", "y"), whole_books=True)
    assert s.count() == 123 and s.stats().first()["code"] == 60 and "New" in [r["book_title"] for r in s.book_titles().collect()]
    assert len(s.matching("ns")) == store_module.BUCKETS and len(s.matching("ns", "New")) == 1 and s.matching("ns", "Nowhere") == []
    assert s.read("ns", "New").count() == 5 and s.read("ns", "New", "3").count() == 5 and s.read("ns", "New", "4").count() == 0
    plain = s.read("ns").where("book_title = 'T2' and array_contains(chapter_numbers, '5')").count()
    assert s.read("ns", "T2", "5").count() == plain > 0
    one = s.read("ns", "New")._jdf.queryExecution().toString()
    assert one.count("number=") <= 4  # the files of one part


def test_buckets_and_files_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "PART_ROWS", 10)
    monkeypatch.setattr(store_module, "FILE_ROWS", 4)
    s = Store(spark, f"file://{tmp_path}/s")
    s.upsert(chunks(spark, range(20)))
    assert s._state()[1]["buckets"] == {"ns": 8}
    s.upsert(chunks(spark, range(15, 120)))
    assert s._state()[1]["buckets"] == {"ns": 32} and s.count() == 240
    rows = s.read("ns")
    assert rows.select("chunk_id").distinct().count() == 240 and rows.groupBy("book_id").count().where("count != 2").count() == 0
    before = s._parts()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else files as small as these are joined
    try:
        s.upsert(chunks(spark, [7], 30, text="z"), whole_books=True)  # one large book
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    after = s._parts()
    assert sum(before.get(k) != v for k, v in after.items()) == 1
    folder = next(v for k, v in after.items() if before.get(k) != v)
    assert len(list((tmp_path / "s" / folder).glob("part-*.parquet"))) > 1 and s.count() == 268
    s.vacuum()
    assert s.count() == 268 and s.read().count() == 268 and len(list((tmp_path / "s").glob("CURRENT-*"))) == 1


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in "ab")
    one.upsert(chunks(spark, [1]))
    told = Store._told

    def late(self, version):
        if self is two:
            one.upsert(chunks(spark, [2]))
        return told(self, version)

    monkeypatch.setattr(Store, "_told", late)
    with pytest.raises(Conflict):
        two.upsert(chunks(spark, [3]))
    assert {r["book_id"] for r in two.read().collect()} == {1, 2}
    monkeypatch.setattr(Store, "_told", told)
    two.upsert(chunks(spark, [3]))
    assert {r["book_id"] for r in one.read().collect()} == {1, 2, 3}


def test_nothing_to_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.upsert(chunks(spark, [1]).where("false"))
    assert s.exists() and s.count() == 0 and s.read().count() == 0 and s.book_titles().count() == 0 and s.stats().first()["total"] == 0


def test_engine_asks_its_index(spark, tmp_path):
    from lectern.config import PRESETS
    from lectern.plans.engine import Engine

    pages = spark.createDataFrame([(b, 1, f"book {b} is about topic{b} and cnn number {b}", 600.0, 800.0) for b in range(40)], "book_id long, page int, text string, width double, height double")
    books = spark.createDataFrame([(b, f"T{b % 3}", "A") for b in range(40)], "book_id long, book_title string, author string")
    engine = Engine(spark, f"file://{tmp_path}/store", PRESETS["default"])
    engine.ingest(pages, books)
    asked = spark.createDataFrame([(1, "what is topic7 of a book?"), (2, "explain cnn number 12")], "qid long, raw_query string")
    flat = lambda **k: sorted((r["qid"], r["json"]) for r in engine.ask(asked, **k).collect())
    plain, titled = flat(), flat(book_title="T1")
    assert engine._index() is None
    engine.build_index()
    assert engine._index() is not None and flat() == plain and flat(book_title="T1") == titled and flat(book_title="None") == []
    engine.ingest(pages.where("book_id = 3"), books.where("book_id = 3").withColumn("author", F.lit("B")))
    assert engine._index() is None
