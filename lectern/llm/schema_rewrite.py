"""Rewrites Parquet files whose schema has drifted to one evolved schema, by DuckDB in Spark tasks.

Columns are matched by the field ids in each file's footer, never by name or place. For every file a
SELECT of its own is generated: a column that the file has under the id is cast and given its evolved
name; one that it lacks is its default. COPY writes the rows in their order, with FIELD_IDS. A file
that already has the evolved schema stays untouched. Nulls stay null.

A task writes to a staging folder under a name of its own. Only what a finished task reports is moved
over the old file, so a task that runs again, or twice, finds the old file whole; moving twice does
nothing. The staging folder goes at the end. Files are independent: one task holds row groups of one
file at a time, whatever its size. The folder must be shared; where DuckDB can't open it (a store
that isn't mounted), the task streams the file through its own scratch folder and back.

Files without rows are rewritten like others; an empty table of files gives no rows. Columns of a
file whose field id the evolved schema doesn't have are left out; those without an id too. A
repeated path is rewritten once."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as c


class Field(NamedTuple):
    """A column of the evolved schema; default is what files without it have."""

    id: int
    name: str
    type: pa.DataType
    default: object = None


#: The evolved schema of `clients`.
CLIENTS = [
    Field(1, "client_id", pa.int64()), Field(2, "master_id", pa.int64()), Field(3, "source", pa.string(), "none"), Field(4, "updated_at", pa.timestamp("us")), Field(5, "name", pa.string()),
    Field(6, "email", pa.string()), Field(7, "city", pa.string()), Field(8, "nation_id", pa.int64(), -1), Field(9, "segment", pa.string()), Field(10, "balance", pa.float64()),
]
SPARK = {pa.int64(): "long", pa.string(): "string", pa.timestamp("us"): "timestamp_ntz", pa.float64(): "double"}
DUCK = {pa.int64(): "BIGINT", pa.string(): "VARCHAR", pa.timestamp("us"): "TIMESTAMP", pa.float64(): "DOUBLE"}
ID = b"PARQUET:field_id"


def arrow_schema(fields: Iterable[Field]) -> pa.Schema:
    return pa.schema([pa.field(f.name, f.type, True, {ID: str(f.id).encode()}) for f in fields])


def _store(at: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(at)


def _even(rows: DataFrame, number: str) -> DataFrame:
    """Rows of each number together, numbers in turn over all partitions."""
    n = c.partitions(rows.sparkSession)
    homes = F.array(*map(F.lit, c.even_keys(rows.sparkSession, n)))
    return rows.withColumn("home", F.element_at(homes, (F.col(number) % n + 1).cast("int"))).repartition(n, "home").drop("home")


# --- starting files -----------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[Column], name: str = "row__") -> DataFrame:
    """Adds each row's place (from 0) in the given order; equal rows come in any order among
    themselves, others that tie by a hash of all their columns. Rows are dealt by ranges of the order and that
    hash, and by a number of their own, so equal keys of any number go to many tasks; the only thing
    that is gathered is the number of rows of each partition."""
    n = c.partitions(rows.sparkSession)
    keys = [f"key{i}__" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)) | {"hash__": F.xxhash64(*rows.columns)}).withColumn("tie__", F.monotonically_increasing_id())
    by = [*keys, "hash__", "tie__"]
    at = F.monotonically_increasing_id()
    placed = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"part__": F.shiftright(at, 33).cast("int"), "pos__": at.bitwiseAND((1 << 33) - 1)})
    placed = c.stash(placed.drop(*by))
    before, total = [], 0
    for r in placed.groupBy("part__").count().orderBy("part__").collect():  # one row a partition
        before.append((r["part__"], total))
        total += r["count"]
    before = rows.sparkSession.createDataFrame(before, "part__ int, before__ long")
    return placed.join(F.broadcast(before), "part__").withColumn(name, F.col("before__") + F.col("pos__")).select(*rows.columns, name)


def version_of(file_no: int, seed: int = 42) -> int:
    v = zlib.crc32(f"{seed}:{file_no}".encode()) % 24
    return 0 if v > 15 else v


def drifted(version: int, fields: list[Field] = CLIENTS) -> list[tuple[Field, str]]:
    """Columns of a file of this version, each with the evolved column that it holds. Bits: 1 name
    and email swap names; 2 columns after the first reverse; 4 nation_id and source are missing; 8
    balance is float, nation_id int."""
    out = [(f, f.name) for f in fields]
    if version & 8:
        types = {"balance": pa.float32(), "nation_id": pa.int32()}
        out = [(f._replace(type=types.get(f.name, f.type)), n) for f, n in out]
    if version & 4:
        out = [x for x in out if x[1] not in ("nation_id", "source")]
    if version & 1:
        swap = {"name": "email", "email": "name"}
        out = [(f._replace(name=swap.get(f.name, f.name)), n) for f, n in out]
    if version & 2:
        out = [out[0], *out[:0:-1]]
    return out


def write_drifted(rows: DataFrame, at: str, per_file: int, seed: int = 42, row_col: str = "row__") -> DataFrame:
    """Writes rows with a place (row_col) and the columns of CLIENTS to files of per_file rows, each in
    the schema of its version. A row for each file: file_no, version, path. Every file comes from
    one task, which streams it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(at)
        store.create_dir(f"{path}/staging", recursive=True)
        store.create_dir(f"{path}/data", recursive=True)
        done: list[tuple[int, int, str]] = []
        now, own, writer, columns, kind = -1, "", None, [], None

        def close() -> None:
            if writer:
                writer.close()
                store.move(own, f"{path}/data/part-{now:05d}.parquet")
                done.append((now, version_of(now, seed), f"{at}/data/part-{now:05d}.parquet"))

        for batch in batches:
            numbers = batch.column("file_no").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                if numbers[s] != now:
                    close()
                    now, own = int(numbers[s]), f"{path}/staging/{uuid.uuid4().hex}"
                    columns = drifted(version_of(now, seed))
                    kind = arrow_schema(f for f, _ in columns)
                    writer = pq.ParquetWriter(store.open_output_stream(own), kind)
                part = batch.slice(s, e - s)
                writer.write_batch(pa.RecordBatch.from_arrays([pc.cast(part.column(n), f.type, safe=False) for f, n in columns], schema=kind))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done])], ["file_no", "version", "path"])
        c.tidy()

    own = rows.select(F.expr(f"{row_col} div {per_file}").alias("file_no"), row_col, *(F.col(f.name).cast(SPARK[f.type]) for f in CLIENTS))
    dealt = _even(own, "file_no").sortWithinPartitions("file_no", row_col).drop(row_col)
    return c.stash(dealt.mapInArrow(run, "file_no long, version int, path string"))


# --- the rewrite --------------------------------------------------------------------------------


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def select_of(footer: pa.Schema, fields: list[Field], path: str) -> str:
    """The SELECT that turns a file with this footer into the evolved schema."""
    has = {int(f.metadata[ID]): f.name for f in footer if f.metadata and ID in f.metadata}

    def value(f: Field) -> str:
        # A constant, or a column whose statistics count no null, would become one that may not be null.
        return f"CASE WHEN file_row_number >= 0 THEN {_quoted(has[f.id]) if f.id in has else _literal(f.default)} END"

    columns = [f"CAST({value(f)} AS {DUCK[f.type]}) AS {_quoted(f.name)}" for f in fields]
    return f"SELECT {', '.join(columns)} FROM read_parquet({_literal(path)}, hive_partitioning = false, file_row_number = true)"


def rewrite_file(source: str, target: str, fields: list[Field], memory: str = "400MB") -> None:
    """One file to another, both as DuckDB can open them, in the order of the rows."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": True}) as con:
        ids = ", ".join(f"{_quoted(f.name)}: {f.id}" for f in fields)
        con.execute(f"COPY ({select_of(pq.read_schema(source), fields, source)}) TO {_literal(target)} (FORMAT parquet, FIELD_IDS {{{ids}}})")
    if not pq.read_schema(target).equals(arrow_schema(fields), check_metadata=True):
        raise RuntimeError(f"{target} hasn't the evolved schema")


def evolved(footer: pa.Schema, fields: list[Field]) -> bool:
    return pa.schema(list(footer)).equals(arrow_schema(fields), check_metadata=True)


def _rewrite(at: str, fields: list[Field]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(path: str) -> tuple[str, str | None]:
        """Column names of the file, and what was written in its stead."""
        store, own = _store(path)
        with store.open_input_file(own) as f:
            footer = pq.read_schema(f)
        names = ",".join(footer.names)
        if evolved(footer, fields):
            return names, None
        staged = f"{at}/staging/{uuid.uuid4().hex}"
        to, inside = _store(staged)
        if isinstance(store, fs.LocalFileSystem) and isinstance(to, fs.LocalFileSystem):
            rewrite_file(own, inside, fields)
            return names, staged
        scratch = tempfile.mkdtemp()
        try:
            fs.copy_files(own, f"{scratch}/old", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            rewrite_file(f"{scratch}/old", f"{scratch}/new", fields)
            fs.copy_files(f"{scratch}/new", inside, source_filesystem=fs.LocalFileSystem(), destination_filesystem=to)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)
        return names, staged

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(at)
        store.create_dir(f"{path}/staging", recursive=True)
        for batch in batches:
            for i, p in enumerate(batch.column("path").to_pylist()):
                names, staged = one(p)
                yield pa.RecordBatch.from_arrays([*(x.slice(i, 1) for x in batch.columns), pa.array([names]), pa.array([staged], pa.string())], [*batch.schema.names, "start_columns", "staged"])
        c.tidy()

    return run


def _moved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, staged in zip(batch.column("path").to_pylist(), batch.column("staged").to_pylist(), strict=True):
            if staged:
                (store, old), (_, new) = _store(path), _store(staged)
                if store.get_file_info(new).type != fs.FileType.NotFound:
                    store.move(new, old)
        yield batch


def rewrite_drifted(files: DataFrame, at: str, fields: list[Field] = CLIENTS, number: str = "file_no") -> DataFrame:
    """Rewrites the files of a table (number: from 0, path: below a folder that all executors share) in
    place; `at` takes the staging folder. Returns files with start_columns and rewritten."""
    rows = files.dropDuplicates(["path"])
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    made = c.stash(_even(rows, number).mapInArrow(_rewrite(at, fields), f"{kinds}, start_columns string, staged string"))
    done = c.stash(_even(made, number).mapInArrow(_moved, f"{kinds}, start_columns string, staged string"))
    store, path = _store(at)
    if store.get_file_info(f"{path}/staging").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/staging")
    return done.withColumn("rewritten", F.col("staged").isNotNull()).drop("staged")


# --- reading back -------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> pa.Array:
    """A text for each row: fields joined by |, null as ?, times as microseconds, floats as
    floor(2^20 * x)."""
    out = []
    for x in batch.columns:
        if pa.types.is_timestamp(x.type):
            x = x.cast(pa.timestamp("us")).cast(pa.int64())
        elif pa.types.is_floating(x.type):
            v = np.floor(x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64) * (1 << 20))
            whole = [str(int(f)) for f in v.tolist()] if np.isfinite(v).all() else [str(int(f)) if np.isfinite(f) else str(f) for f in v.tolist()]
            x = pc.if_else(x.is_valid(), pa.array(whole, pa.string()), None)
        out.append(x.cast(pa.string()))
    return pc.binary_join_element_wise(*out, "|", null_handling="replace", null_replacement="?")


def digest(file: pa.NativeFile, id_col: str) -> tuple[int, int, str, str, str]:
    """Rows, nulls, hashes of the ids and of all rows, and column names of a file, by row groups."""
    parquet = pq.ParquetFile(file)
    n = nulls = 0
    ids, rows = hashlib.sha256(), hashlib.sha256()
    for batch in parquet.iter_batches(65_536):
        nulls += sum(x.null_count for x in batch.columns)
        for h, texts, mark in ((ids, batch.column(id_col).cast(pa.string()).fill_null("?"), ","), (rows, _texts(batch), "\n")):
            h.update(((mark if n else "") + mark.join(texts.to_pylist())).encode())
        n += batch.num_rows
    return n, nulls, ids.hexdigest(), rows.hexdigest(), ",".join(parquet.schema_arrow.names)


def digests(files: DataFrame, id_col: str = "client_id", number: str = "file_no") -> DataFrame:
    """Files with n_rows, n_nulls, ids_sha256, rows_sha256 and columns, read from the files. Values that are
    not finite are nan, inf or -inf in rows_sha256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(batch.column("path").to_pylist()):
                store, path = _store(at)
                with store.open_input_file(path) as f:
                    found = digest(f, id_col)
                yield pa.RecordBatch.from_arrays([*(x.slice(i, 1) for x in batch.columns), *(pa.array([v]) for v in found)], [*batch.schema.names, "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "columns"])
        c.tidy()

    kinds = ", ".join(f"`{n}` {k}" for n, k in files.dtypes)
    return _even(files, number).mapInArrow(run, f"{kinds}, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, columns string")


def rewrite_clients(clients: DataFrame, files: int = 500, seed: int = 42) -> DataFrame:
    """Sorts clients by the CRC-32 of their id and the id (rows without an id first), writes them to drifted files
    and rewrites those: a row for each final file. The digests come from the final files."""
    spark = clients.sparkSession
    at = c.shared_dir(spark)
    rows = clients.select(*(F.col(f.name).cast(SPARK[f.type]).alias(f.name) for f in CLIENTS))
    placed = numbered(rows, [F.crc32(F.col("client_id").cast("string")), F.col("client_id")])
    start = write_drifted(placed, at, 1 + placed.count() // files, seed)
    out = c.stash(digests(rewrite_drifted(start, at)))
    local = F.col("path").startswith("file:///")
    path = F.when(local, F.substring("path", len("file://") + 1, 1 << 30)).otherwise(F.col("path"))
    return out.select("file_no", F.col("version").cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", path.alias("path"), "rewritten")
