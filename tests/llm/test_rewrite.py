"""The rewrite of drifted files against a plain version, and its files."""

import datetime
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import fs

from lectern.llm import schema_rewrite as s
from lectern.llm.queries import QUERIES
from test_edges import CLASH

NAMES = [f.name for f in s.CLIENTS]
SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def field(name, v):
    if v is None:
        return "?"
    if name == "updated_at":
        return str((v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1))
    return (str(math.floor(1048576 * v)) if math.isfinite(v) else str(v)) if name == "balance" else str(v)


def plain(rows):
    """{file_no: (version, n_rows, n_nulls, ids, rows, start columns, rewritten)}"""
    crc = lambda r: -1 if r[0] is None else zlib.crc32(str(r[0]).encode())
    rows = sorted(rows, key=lambda r: (crc(r), -1 if r[0] is None else r[0]))
    per, out = 1 + len(rows) // 500, {}
    for no in range(math.ceil(len(rows) / per)):
        v = zlib.crc32(f"42:{no}".encode()) % 24
        v = 0 if v > 15 else v
        own = [dict(zip(NAMES, r, strict=True)) for r in rows[no * per : (no + 1) * per]]
        for r in own:
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
            if v & 4:
                r["nation_id"], r["source"] = -1, "none"
        columns = [n for n in NAMES if not v & 4 or n not in ("nation_id", "source")]
        if v & 1:
            columns = [{"name": "email", "email": "name"}.get(n, n) for n in columns]
        if v & 2:
            columns = [columns[0], *columns[:0:-1]]
        texts = ["|".join(field(n, r[n]) for n in NAMES) for r in own]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[no] = (v, len(own), sum(x is None for r in own for x in r.values()), sha(",".join(field("client_id", r["client_id"]) for r in own)), sha("\n".join(texts)), ",".join(columns), v != 0)
    return out


def found(df):
    rows = df.collect()
    assert len({r["file_no"] for r in rows}) == len(rows)
    for r in rows:
        assert r["columns"] == ",".join(NAMES) and pq.read_schema(r["path"]).equals(s.arrow_schema(s.CLIENTS), check_metadata=True)
    for at in {os.path.dirname(r["path"]) for r in rows}:
        assert sorted(os.listdir(at)) == sorted(os.path.basename(r["path"]) for r in rows) and os.listdir(os.path.dirname(at)) == ["data"]
    return {r["file_no"]: (r["version"], r["n_rows"], r["n_nulls"], r["ids_sha256"], r["rows_sha256"], r["start_columns"], r["rewritten"]) for r in rows}


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/clients.parquet").collect()]
    want = plain(rows)
    assert found(QUERIES["op12_schema_rewrite"](spark, small)) == want and {v[0] for v in want.values()} == set(range(16))


def test_several_rows_a_file_nulls_and_odd_values(spark):
    time = datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 1e300, -1e-300, None]
    rows = [(i * 7919 if i else None, None if i % 3 else i, None if i % 5 else "a|b\n'\"é", None if i % 4 else time, None if i % 7 else f"n{i}", "" if i % 2 else f"e{i}", None, None if i % 6 else i % 25, "none", odd[i % 7] if i % 11 == 0 else i / 7) for i in range(1700)]
    df = spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], f"{SCHEMA}, " + ", ".join(f"{n} string" for n in CLASH))
    assert found(s.rewrite_clients(df)) == plain(rows)


def test_repeated_rows_and_a_hot_id(spark):
    """A third of all rows has one id; equal ids lie in one file after another, reruns agree."""
    rows = [(5, 1, "a", None, "x", "y", "z", 1, "s", 1.0)] * 300 + [(i, 1, "a", None, "x", "y", "z", 1, "s", 1.0) for i in range(600)] + [(5, k, "b", None, None, None, None, None, None, None) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = found(s.rewrite_clients(df)), found(s.rewrite_clients(df.repartition(7)))
    assert one == two and sum(v[1] for v in one.values()) == 1200
    assert {k: v[3] for k, v in one.items()} == {k: v[3] for k, v in plain(rows).items()}
    assert s.rewrite_clients(df.where("false")).collect() == []


def test_places_are_dealt_evenly(spark):
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 1, id) as k", "'same' as x")
    placed = s.numbered(rows, [rows.k])
    assert sorted(r["row__"] for r in placed.collect()) == list(range(4000))
    assert [r["k"] for r in placed.orderBy("row__").collect()] == sorted(r["k"] for r in rows.collect())


def drifted_file(at, version, n=5):
    columns = s.drifted(version)
    kind = s.arrow_schema(f for f, _ in columns)
    data = {"client_id": list(range(n)), "name": [f"n{i}" for i in range(n)], "email": [f"e{i}" for i in range(n)]}
    pq.write_table(pa.table([pa.array(data.get(name, [None] * n), f.type) for f, name in columns], schema=kind), at)
    return data


@pytest.mark.parametrize("version", range(1, 16))
def test_one_file(tmp_path, version):
    data = drifted_file(f"{tmp_path}/old", version)
    s.rewrite_file(f"{tmp_path}/old", f"{tmp_path}/new", s.CLIENTS)
    got = pq.read_table(f"{tmp_path}/new")
    assert got.schema.equals(s.arrow_schema(s.CLIENTS), check_metadata=True)
    assert all(got[n].to_pylist() == v for n, v in data.items())
    assert got["source"].to_pylist() == (["none"] * 5 if version & 4 else [None] * 5)


def test_order_of_many_rows_stays(tmp_path):
    drifted_file(f"{tmp_path}/old", 15, 300_000)
    s.rewrite_file(f"{tmp_path}/old", f"{tmp_path}/new", s.CLIENTS)
    assert pq.read_table(f"{tmp_path}/new")["client_id"].to_pylist() == list(range(300_000))


def test_tasks_that_run_again(spark, tmp_path, monkeypatch):
    """A rewrite that is repeated before its files are moved, and a move that is repeated, change nothing."""
    at = f"file://{tmp_path}"
    os.mkdir(f"{tmp_path}/data")
    drifted_file(f"{tmp_path}/data/part-00000.parquet", 7)
    batch = pa.RecordBatch.from_pydict({"file_no": [0], "path": [f"{at}/data/part-00000.parquet"]})
    one, two = (list(s._rewrite(at, s.CLIENTS)([batch])) for _ in "ab")
    assert one[0]["start_columns"] == two[0]["start_columns"] and one[0]["staged"] != two[0]["staged"]
    for _ in range(2):
        assert list(s._moved(two)) == two
    assert s.evolved(pq.read_schema(f"{tmp_path}/data/part-00000.parquet"), s.CLIENTS)
    again = list(s._rewrite(at, s.CLIENTS)([batch]))
    assert again[0]["staged"].to_pylist() == [None]


def test_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    """Files go through the task's scratch folder, which is empty afterwards."""
    far = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(s, "_store", lambda at: (far, at.removeprefix("far://")))
    monkeypatch.setenv("TMPDIR", str(tmp_path / "scratch"))
    monkeypatch.setattr(s.tempfile, "tempdir", None)
    os.mkdir(tmp_path / "scratch")
    os.mkdir(tmp_path / "data")
    drifted_file(f"{tmp_path}/data/x.parquet", 9)
    batch = pa.RecordBatch.from_pydict({"file_no": [0], "path": ["far://data/x.parquet"]})
    list(s._moved(s._rewrite("far://", s.CLIENTS)([batch])))
    assert s.evolved(pq.read_schema(f"{tmp_path}/data/x.parquet"), s.CLIENTS) and os.listdir(tmp_path / "scratch") == []


def test_unknown_columns_go(tmp_path):
    kind = pa.schema([pa.field("x", pa.int64(), metadata={s.ID: b"1"}), pa.field("client_id", pa.string(), metadata={s.ID: b"77"}), pa.field("name", pa.string())])
    pq.write_table(pa.table([[3, 4], ["a", "b"], ["c", "d"]], schema=kind), f"{tmp_path}/old")
    s.rewrite_file(f"{tmp_path}/old", f"{tmp_path}/new", s.CLIENTS)
    got = pq.read_table(f"{tmp_path}/new").to_pylist()
    assert [r["client_id"] for r in got] == [3, 4] and [r["name"] for r in got] == [None, None] and [r["nation_id"] for r in got] == [-1, -1]
