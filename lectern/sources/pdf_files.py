"""Books as PDF files: a file for each book, a line of text for each line of a page.

Text is set in one font of fixed width (6 of 10 points), lines 12 points apart from 50 points below the
top, 50 from the left; pages are as large as their lines need. Codes are given to a book's characters in their
order, with a ToUnicode map, so that any text can be read back. Books of an odd id are written with
object and cross-reference streams, others with plain objects and a table."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import groups

SIZE, LEADING, WIDTH, MARGIN = 10, 12, 6, 50
#: Folders that the files of many books are dealt over.
FOLDERS = 1024


def _stream(raw: bytes, about: str = "") -> bytes:
    packed = zlib.compress(raw, 1)
    return f"<< {about} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream"


def pdf(pages: list[str], modern: bool = False) -> bytes:
    """The bytes of a file with these pages. A book has at most 65,535 distinct characters."""
    letters = sorted({c for p in pages for c in p if c != "\n"})
    code = {c: i + 1 for i, c in enumerate(letters)}
    spelled = str.maketrans({c: f"{i:04x}" for c, i in code.items()})
    utf16 = lambda c: c.encode("utf-16-be", "surrogatepass").hex()
    blocks = [letters[i : i + 100] for i in range(0, len(letters), 100)]
    cmap = "".join(f"{len(b)} beginbfchar\n" + "".join(f"<{code[c]:04x}> <{utf16(c)}>\n" for c in b) + "endbfchar\n" for b in blocks)
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    objects: dict[int, bytes] = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{6 + 2 * i} 0 R' for i in range(len(pages)))}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(), 3: font.encode(),
        4: f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW {WIDTH * 100} >>".encode(), 5: _stream(cmap.encode()),
    }
    for i, text in enumerate(pages):
        lines = text.split("\n")
        height, width = 2 * MARGIN + LEADING * len(lines), 2 * MARGIN + WIDTH * max(map(len, lines))
        shown = "".join(f"<{x.translate(spelled)}> Tj T*\n" for x in lines)
        content = f"BT /F1 {SIZE} Tf {LEADING} TL 1 0 0 1 {MARGIN} {height - MARGIN - SIZE} Tm\n{shown}ET"
        objects[6 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Contents {7 + 2 * i} 0 R >>".encode()
        objects[7 + 2 * i] = _stream(content.encode())
    return _modern(objects) if modern else _plain(objects)


def _plain(objects: dict[int, bytes]) -> bytes:
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, x in sorted(objects.items()):
        at.append(len(out))
        out += f"{n} 0 obj\n".encode() + x + b"\nendobj\n"
    table = "".join(f"{x:010d} 00000 n \n" for x in at)
    return bytes(out) + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def _modern(objects: dict[int, bytes]) -> bytes:
    """Objects that aren't streams in one object stream; a cross-reference stream with rows filtered as in PNG."""
    out, place = bytearray(b"%PDF-1.5\n"), {}
    inside = {n: x for n, x in sorted(objects.items()) if b"\nstream\n" not in x}
    packed, table = max(objects) + 1, max(objects) + 2
    heads, body = [], b""
    for n, x in inside.items():
        place[n] = (2, packed, len(heads))
        heads.append(f"{n} {len(body)}")
        body += x + b"\n"
    head = (" ".join(heads) + "\n").encode()
    rest = {n: x for n, x in objects.items() if n not in inside} | {packed: _stream(head + body, f"/Type /ObjStm /N {len(heads)} /First {len(head)}")}
    for n, x in sorted(rest.items()):
        place[n] = (1, len(out), 0)
        out += f"{n} 0 obj\n".encode() + x + b"\nendobj\n"
    place[table] = (1, len(out), 0)
    rows = [struct.pack(">BIH", *place.get(n, (0, 0, 65535))) for n in range(table + 1)]
    above, filtered = bytes(7), b""
    for r in rows:
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
        above = r
    stream = _stream(filtered, f"/Type /XRef /Size {table + 1} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>")
    return bytes(out) + f"{table} 0 obj\n".encode() + stream + f"\nendobj\nstartxref\n{len(out)}\n%%EOF\n".encode()


def write_books(pages: DataFrame, at: str, folders: int = 0) -> DataFrame:
    """Writes pages (book_id, page, text) to at/<book_id>.pdf, a folder that all executors share; with folders, to
    at/<book_id mod folders>/<book_id>.pdf, as one folder is slower the more it holds. Returns book_id, path, pages, bytes. A file is written aside and
    renamed, so a task that runs again replaces it. A book is one task's work, as its file is; a task takes its books one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        made: set[str] = set()
        for book, rows in groups(batches, "book_id"):
            texts, book = [x or "" for x in rows.column("text").to_pylist()], int(book)
            raw, folder = pdf(texts, book % 2 == 1), f"/{book % folders}" if folders else ""
            if folder not in made:
                store.create_dir(f"{root}{folder}", recursive=True)
                made.add(folder)
            aside = f"{root}{folder}/.{book}.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as f:
                f.write(raw)
            store.move(aside, f"{root}{folder}/{book}.pdf")
            yield pa.RecordBatch.from_pydict({"book_id": [book], "path": [f"{at}{folder}/{book}.pdf"], "pages": pa.array([len(texts)], pa.int32()), "bytes": [len(raw)]})

    rows = pages.select(F.col("book_id").cast("long").alias("book_id"), "page", "text").where("book_id is not null")
    return rows.repartition("book_id").sortWithinPartitions("book_id", "page").mapInArrow(run, "book_id long, path string, pages int, bytes long")


def text_pages(lines: DataFrame, per_page: int = 40) -> DataFrame:
    """Pages (book_id, page, text) of per_page lines (book_id, pos from 0, text)."""
    page = (F.expr(f"int(pos div {per_page})") + 1).alias("page")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    rows = lines.groupBy("book_id", page).agg(F.transform(listed, lambda x: x["text"]).alias("lines"))
    return rows.select("book_id", "page", F.array_join("lines", "\n").alias("text"))


def book_of(path: str) -> F.Column:
    return F.regexp_extract(path, r"([0-9]+)\.[^./]*$", 1).cast("long")

