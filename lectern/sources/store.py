"""The chunk store: a Parquet table of parts, with idempotent upserts and statistics of each part.

A part is the chunks of a namespace whose books fall into one of its buckets. Buckets double as the
namespace grows, so that a part holds PART_ROWS chunks on average at most; a part is written as files of
FILE_ROWS by as many tasks. An upsert writes the parts that it touches anew, in a folder of its own; the
others stay as they are. A pointer file lists, for each part, its folder, its numbers of chunks, and Bloom
filters of its titles and chapter numbers, so that counts need no scan and filters read only the parts
that may match; a small table beside the chunks has each part's titles.

Pointers are numbered; a new one is written aside and takes the next number, which fails if another
writer has it by then. So readers see the old table or the new one, never a mixture; a writer that dies
leaves the table as it was; of two writers at once, the second is refused and loses nothing of the
first. Ids come from content. Ingesting a book again replaces all chunks it had. What the last pointer
doesn't name is removed by vacuum()."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import reduce
from typing import Any

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = (
    "chunk_id string, book_id bigint, book_title string, author string, chunk_index int, text string, chapter_titles array<string>, chapter_numbers array<string>, section_titles array<string>, "
    "section_numbers array<string>, subsection_titles array<string>, subsection_numbers array<string>, page_start int, page_end int, contains_code boolean, embedding array<float>, namespace string"
)
STATS = "namespace string, book_title string, total bigint, code bigint, chapters array<string>"
#: Parts of a new namespace; chunks of a part on average, at most; chunks of a file.
BUCKETS, PART_ROWS, FILE_ROWS = 8, 1_000_000, 200_000
#: Bits of a Bloom filter, and those that a value sets.
BITS, HASHES = 4096, 4
LISTS = ["chapter_titles", "chapter_numbers", "section_titles", "section_numbers", "subsection_titles", "subsection_numbers"]


def clean_list(column: str) -> Column:
    """Null members as the empty text, a null list as the empty list."""
    return F.transform(F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")), lambda e: F.coalesce(e, F.lit("")))


def chunk_id(*parts: str) -> Column:
    """An id out of what a chunk is: equal chunks have equal ids."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def records(chunks: DataFrame, namespace: str) -> DataFrame:
    """Chunks (book_id, chunk_index, text, ..., embedding) as rows of the store."""
    have = set(chunks.columns)
    rows = chunks
    for name, value in (("book_title", F.lit("")), ("author", F.lit("")), ("embedding", F.lit(None).cast("array<float>"))):
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in have else value)
    for name in LISTS:
        rows = rows.withColumn(name, clean_list(name) if name in have else F.array().cast("array<string>"))
    rows = rows.withColumn("chunk_id", chunk_id("book_id", "chunk_index", "text")).withColumn("namespace", F.lit(namespace))
    kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in SCHEMA.split(", ")}
    return rows.select(*((F.col(k) if k in rows.columns else F.lit(None)).cast(v).alias(k) for k, v in kinds.items()))


class Conflict(RuntimeError):
    """Another writer has changed the table since this one looked."""


def _bits(value: Column) -> Column:
    return F.array(*((F.crc32(F.concat(F.lit(f"{i}:"), value)) % BITS).cast("int") for i in range(HASHES)))


def _may_hold(bits: str, value: str) -> bool:
    held = int(bits or "0", 16)
    return all(held >> (zlib.crc32(f"{i}:{value}".encode()) % BITS) & 1 for i in range(HASHES))


class Store:
    """A table at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None) -> None:
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension

    def _hadoop(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self) -> JavaObject:
        return self._hadoop("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(self._hadoop(""))] if files.exists(self._hadoop("")) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"CURRENT-(\d+)", n)))

    def _state(self) -> tuple[int, dict[str, Any]]:
        """Number of the last pointer (0: no table) and what it says: buckets by namespace, parts by "namespace/bucket"."""
        found = self._pointers()
        if not found:
            return 0, {"buckets": {}, "parts": {}}
        return found[-1], json.loads(self.spark.read.text(f"{self.path}/CURRENT-{found[-1]:012d}", wholetext=True).first()["value"])

    def _parts(self) -> dict[str, str]:
        """The folder of each part."""
        return {k: v["folder"] for k, v in self._state()[1]["parts"].items()}

    def _commit(self, last: int, state: dict[str, Any]) -> None:
        """Makes a state the table, unless another writer was faster."""
        aside = self._hadoop(f".CURRENT.{uuid.uuid4().hex}")
        out = self._files().create(aside, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        fs, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        how = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = getattr(fs.Options.Rename, "NONE")
        try:
            fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, self._hadoop(f"CURRENT-{last + 1:012d}"), how)
        except Py4JJavaError as e:
            self._files().delete(aside, False)
            if last + 1 in self._pointers():
                raise Conflict(f"{self.path}: another writer was faster") from e
            raise

    def version(self) -> int:
        """Grows with every change of the table; 0: there is none."""
        return self._state()[0]

    def exists(self) -> bool:
        return bool(self._pointers())

    def create(self) -> None:
        """Makes the empty table where there is none."""
        if not self.exists():
            self._commit(0, {"buckets": {}, "parts": {}})

    def _read(self, folders: list[str], schema: str = SCHEMA) -> DataFrame:
        rows = [self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in folders))] if folders else []
        return reduce(DataFrame.unionByName, rows, self.spark.createDataFrame([], schema))

    def matching(self, namespace: str | None = None, book_title: str | None = None, chapter: str | None = None) -> list[str]:
        """Parts that may hold chunks of a namespace, title and chapter number."""
        every = self._state()[1]["parts"]
        own = [k for k in sorted(every) if namespace is None or k.rsplit("/", 1)[0] == namespace]
        return [k for k in own if (book_title is None or _may_hold(every[k]["titles"], book_title)) and (chapter is None or _may_hold(every[k]["chapters"], chapter))]

    def read(self, namespace: str | None = None, book_title: str | None = None, chapter: str | None = None) -> DataFrame:
        """Chunks, all or those of a namespace, title and chapter number; other parts aren't read."""
        parts = self._parts()
        rows = self._read([parts[k] for k in self.matching(namespace, book_title, chapter)])
        rows = rows if book_title is None else rows.where(F.col("book_title") == book_title)
        return rows if chapter is None else rows.where(F.array_contains("chapter_numbers", chapter))

    def upsert(self, rows: DataFrame, whole_books: bool = False) -> None:
        """Adds rows; those with an id of the store replace it. whole_books: rows are all that their books
        have now, so other chunks of those go. Of rows with equal ids the one of the least hash stays."""
        last, state = self._state()
        version, old = uuid.uuid4().hex, state["parts"]
        # The rows are computed once; what a writer that dies leaves behind, vacuum() removes.
        rows.select(*(F.col(f.split(" ")[0]) for f in SCHEMA.split(", "))).write.parquet(f"{self.path}/stage-{version}")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/stage-{version}")
        if self.dimension is not None:
            wrong = rows.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dimension).limit(1).count()
            if wrong:
                raise ValueError(f"embeddings must have {self.dimension} components")
        spaces = {r["namespace"]: r["count"] for r in rows.groupBy("namespace").count().collect()}
        if not spaces:
            self._files().delete(self._hadoop(f"stage-{version}"), True)
            if not last:
                self.create()
            return
        buckets, grown = dict(state["buckets"]), set()
        for space, n in spaces.items():
            n += sum(v["rows"] for k, v in old.items() if k.rsplit("/", 1)[0] == space)
            was = buckets.setdefault(space, BUCKETS)
            while n > buckets[space] * PART_ROWS:
                buckets[space] *= 2
            grown |= {space} if buckets[space] != was else set()
        many = F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(buckets.items()) for x in (k, v))), F.col("namespace"))
        part = F.concat_ws("/", "namespace", F.pmod(F.xxhash64("book_id"), many).cast("string"))
        staged = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}  # a row for each part
        gone = {k for k in old if k in staged or k.rsplit("/", 1)[0] in grown}
        # Ids are looked at first: rows are dealt by them only where some come again.
        again = rows.groupBy("namespace", "chunk_id").count().where("count > 1").limit(1).count() > 0
        now = upserted(self._read([old[k]["folder"] for k in sorted(gone)]), rows, ["namespace", "book_id"] if whole_books else None, again).withColumn("part", part)
        # Folders are numbered; of a namespace that has grown, every new part is written.
        names = sorted(staged.keys() | {k for k in gone if k.rsplit("/", 1)[0] not in grown} | {f"{x}/{i}" for x in grown for i in range(buckets[x])})
        size = {k: staged.get(k, 0) + old.get(k, {"rows": PART_ROWS})["rows"] for k in names}
        about = F.create_map(*(x for i, k in enumerate(names) for x in (F.lit(k), F.struct(F.lit(i).alias("number"), F.lit(-(-size[k] // FILE_ROWS)).alias("files")))))
        now = now.withColumn("of", F.element_at(about, F.col("part")))
        now = now.withColumn("number", F.col("of.number")).withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.col("of.files")))
        now.drop("part", "of").repartition("number", "salt").drop("salt").write.partitionBy("number").parquet(f"{self.path}/{version}/rows")
        told = self._told(version)
        parts = {k: v for k, v in old.items() if k not in gone}
        parts |= {k: {"folder": f"{version}/rows/number={i}", "stats": f"{version}/stats/number={i}", **told[i]} for i, k in enumerate(names) if i in told}
        self._commit(last, {"buckets": buckets, "parts": parts})
        self._files().delete(self._hadoop(f"stage-{version}"), True)

    def _told(self, version: str) -> dict[int, dict[str, Any]]:
        """Writes titles and counts of the parts of a version; what the pointer says of each part."""
        rows = self.spark.read.schema(f"{SCHEMA}, number int").parquet(f"{self.path}/{version}/rows")
        chapters = F.array_distinct(F.flatten(F.collect_set("chapter_numbers"))).alias("chapters")
        stats = rows.groupBy("number", "namespace", "book_title").agg(F.count("*").alias("total"), F.count_if("contains_code").alias("code"), chapters)
        stats.repartition("number").write.partitionBy("number").parquet(f"{self.path}/{version}/stats")
        stats = self.spark.read.schema(f"{STATS}, number int").parquet(f"{self.path}/{version}/stats")
        out = {r["number"]: {"rows": r["total"], "code": r["code"], "titles": "0", "chapters": "0"} for r in stats.groupBy("number").agg(F.sum("total").alias("total"), F.sum("code").alias("code")).collect()}
        for name, value in (("titles", F.array(F.coalesce("book_title", F.lit("")))), ("chapters", F.col("chapters"))):
            bits = stats.select("number", F.explode(value).alias("v")).select("number", F.explode(_bits(F.coalesce("v", F.lit("")))).alias("bit"))
            for r in bits.groupBy("number").agg(F.collect_set("bit").alias("bits")).collect():  # BITS for each part at most
                out[r["number"]][name] = f"{sum(1 << b for b in r['bits']):x}"
        return out

    def vacuum(self) -> None:
        """Removes what the table no longer points to. Not for while others read or write."""
        last, state = self._state()
        files, used = self._files(), {x["folder"].split("/")[0] for x in state["parts"].values()} | {f"CURRENT-{last:012d}"}
        for f in files.listStatus(self._hadoop("")):
            if f.getPath().getName() not in used:
                files.delete(f.getPath(), True)

    def count(self, namespace: str | None = None) -> int:
        """Number of chunks, out of the pointer."""
        every = self._state()[1]["parts"]
        return sum(every[k]["rows"] for k in self.matching(namespace))

    def stats(self, namespace: str | None = None) -> DataFrame:
        """Chunks: total, with code, without; out of the pointer."""
        own = [v for k, v in self._state()[1]["parts"].items() if namespace is None or k.rsplit("/", 1)[0] == namespace]
        total, code = sum(v["rows"] for v in own), sum(v["code"] for v in own)
        return self.spark.createDataFrame([(total, code, total - code)], "total long, code long, text long")

    def book_titles(self, namespace: str | None = None) -> DataFrame:
        """All distinct titles, in order; of the table of titles, not of the chunks."""
        every = self._state()[1]["parts"]
        rows = self._read([every[k]["stats"] for k in self.matching(namespace)], STATS)
        return rows.where("book_title != ''").select("book_title").distinct().orderBy("book_title")


def upserted(old: DataFrame, new: DataFrame, gone: list[str] | None = None, again: bool = True) -> DataFrame:
    """old without the ids of new (or without rows that agree with new in the columns of gone), and new
    with each id once. again: whether ids of new may come more than once."""
    keys = ["namespace", "chunk_id"]
    if again:
        first = W.partitionBy(*keys).orderBy(F.xxhash64(*(c for c in new.columns if c not in keys)))
        new = new.withColumn("row__", F.row_number().over(first)).where("row__ = 1").drop("row__")
    gone = gone or keys
    return old.join(new.select(*gone).distinct(), gone, "left_anti").unionByName(new)
