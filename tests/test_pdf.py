"""The PDF source: written books, files by hand, broken files, page ranges."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.sources import pdf, pdf_files
from lectern.sources.pdf import Document, Lexer, Name, Op, Part, PdfReader, Ref, page_chars, page_text


def texts(raw):
    doc = Document(raw)
    return [page_text(page_chars(doc, p)[0]) for p in doc.pages()]


def words(page):
    return "\n".join(x for x in (" ".join(line.split()) for line in page.split("\n")) if x)


PAGES = ["Hello  wörld \U0001f600\n\n  second line", "", "(brackets) \\ back <angle> 100% /name", "ſtraße Ελλάδα 日本語\tx\r\nlast"]


@pytest.mark.parametrize("modern", [False, True])
def test_written_books_come_back(modern):
    raw = pdf_files.pdf(PAGES, modern)
    assert texts(raw) == [words(p) for p in PAGES]
    chars, width, height = page_chars(Document(raw), Document(raw).pages()[0])
    assert "".join(chars.text) == PAGES[0].replace("\n", "") and (width, height) == (100 + 6 * max(map(len, PAGES[0].split("\n"))), 100 + 36)
    assert [v[0] for v in chars[1:]] == [10, "Plain", 50, 56, 50] and chars.top[-1] == 74


@pytest.mark.parametrize("modern", [False, True])
def test_a_lost_table_is_searched_for(modern):
    raw = pdf_files.pdf(PAGES, modern)
    cut = raw[: raw.rindex(b"startxref")]
    assert texts(cut) == texts(raw) and texts(cut + b"startxref\n3\n%%EOF") == texts(raw)


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4), st.booleans())
@settings(max_examples=80, deadline=None)
def test_any_text(pages, modern):
    want = ["\n".join(" ".join(w for w in "".join(" " if c in "\t\n\x0b\f\r " else c for c in line).split(" ") if w) for line in p.split("\n")) for p in pages]
    assert texts(pdf_files.pdf(pages, modern)) == ["\n".join(x for x in p.split("\n") if x) for p in want]


def test_objects():
    raw = rb"<< /A 1 0 R /B [1 -2.5 (a\(b\)\n\101(in)) <48 6> true null /C#20D] >> % gone" + b"\nBT"
    x = Lexer(raw)
    assert x.next() == {"A": Ref(1), "B": [1, -2.5, b"a(b)\nA(in)", b"H`", True, None, Name("C D")]} and x.next() == Op("BT")
    assert list(Lexer(b"1 0 R").all()) == [1, 0, Op("R")]


def by_hand(content, font, extra="", more=()):
    """A file of one page 200 by 100 whose table is left out."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>", f"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] /Resources << /Font << /F 4 0 R >> {extra} >> >>".encode(), font, b"<< /Length 1 >>\nstream\n" + content + b"\nendstream", *more]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


SIMPLE = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helv /FirstChar 32 /Widths [300 500] /FontDescriptor << /Descent -200 /MissingWidth 600 >> /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /fi /uni4E2D] >> >>"


def test_operators():
    content = rb"q 2 0 0 2 0 0 cm BT /F 10 Tf 1 0 0 1 5 30 Tm [(AB) -1000 (C)] TJ ET Q BT /F 10 Tf 12 TL 5 20 Td (x!) Tj T* (y) Tj 3 Tc 50 Tz (zz) ' ET"
    doc = Document(by_hand(content, SIMPLE))
    chars, *size = page_chars(doc, doc.pages()[0])
    assert chars.text == ["é", "fi", "中", "x", "!", "y", "z", "z"] and size == [200, 100]
    got = [tuple(round(v, 6) for v in row) for row in zip(chars.x0, chars.x1, chars.top, chars.size, strict=True)]
    # Twice as large: 5 -> 10; a width of 6 -> 12; a gap of 10 -> 20. Tops: 100 - (2 * 30 + 2 * 8).
    assert got[:3] == [(10, 22, 24, 20), (22, 34, 24, 20), (54, 66, 24, 20)]
    assert got[3:] == [(5, 11, 72, 10), (11, 16, 72, 10), (5, 11, 84, 10), (5, 8, 96, 10), (9.5, 12.5, 96, 10)]


def test_forms_and_images():
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 50 0] /Length 9 >>\nstream\nBT /F 10 Tf 0 20 Td (in) Tj ET\nendstream"
    doc = Document(by_hand(b"BI /W 1 ID (ab\nEI Q BT /F 10 Tf 5 20 Td (out) Tj ET /X Do /Missing Do", SIMPLE, "/XObject << /X 6 0 R >>", [form]))
    assert page_text(page_chars(doc, doc.pages()[0])[0]) == "out in"


def test_filters():
    packed = zlib.compress(b"BT /F 10 Tf 5 20 Td (deep) Tj ET").hex().encode() + b">"
    raw = by_hand(b"", SIMPLE).replace(b"<< /Length 1 >>\nstream\n\nendstream", b"<< /Length %d /Filter [/ASCIIHexDecode /FlateDecode] >>\nstream\n%s\nendstream" % (len(packed), packed))
    assert texts(raw) == ["deep"]
    rows = [bytes([kind, *[(i * 37 + kind) & 255 for i in range(6)]]) for kind in range(5)]
    plain, above = [], [0] * 6
    for r in rows:
        own = []
        for i, v in enumerate(r[1:]):
            a, b, c = own[i - 3] if i > 2 else 0, above[i], above[i - 3] if i > 2 else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            own.append((v + [0, a, b, (a + b) // 2, near][r[0]]) & 255)
        plain.append(bytes(own))
        above = own
    assert pdf._unpredicted(b"".join(rows), {"Predictor": 15, "Colors": 3, "Columns": 2}) == b"".join(plain)


def test_later_versions_win():
    """A file that was added to: the new object and its table come after the old ones."""
    old = pdf_files.pdf(["old"])
    start = int(old.rsplit(b"startxref\n", 1)[1].split()[0])
    content = b"<< /Length 33 >>\nstream\nBT /F1 10 Tf 5 20 Td <0002> Tj ET\nendstream"
    new = old + b"7 0 obj\n" + content + b"\nendobj\n"
    at = len(new)
    new += b"xref\n7 1\n%010d 00000 n \ntrailer << /Size 8 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(old), start, at)
    assert texts(new) == ["l"]


def test_source(spark, tmp_path):
    pdf.register(spark)
    books = {1: ["one a", "one b"], 2: [f"page {i}" for i in range(25)], 3: [""]}
    rows = spark.createDataFrame([(b, i, x) for b, pages in books.items() for i, x in enumerate(pages, 1)], "book_id long, page int, text string")
    at = f"file://{tmp_path}/in"
    made = pdf_files.write_books(rows, at).collect()
    assert {(r["book_id"], r["pages"]) for r in made} == {(b, len(p)) for b, p in books.items()}
    (tmp_path / "in" / "bad.PDF").write_bytes(b"not a file of this kind")
    (tmp_path / "in" / "empty.pdf").write_bytes(b"")
    (tmp_path / "in" / "note.txt").write_text("x")
    (tmp_path / "in" / "secret.pdf").write_bytes(by_hand(b"", SIMPLE) + b" trailer << /Encrypt 9 0 R >>")
    want = sorted((f"{b}.pdf", i, x) for b, pages in books.items() for i, x in enumerate(pages, 1))
    for options in ({}, {"partitionBytes": "1000", "pagesPerPartition": "4"}):
        read = spark.read.format("pdf").options(**options).load(at)
        got = read.collect()
        assert sorted((r["path"].rsplit("/", 1)[1], r["page"], r["text"]) for r in got if r["error"] is None) == want
        assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in got if r["error"]} == {"bad.PDF": "ValueError: no pages", "secret.pdf": "ValueError: encrypted"}
        chars = spark.read.format("pdf").options(rows="chars", **options).load(at)
        assert chars.count() == sum(len(x) for _, _, x in want) and chars.where("page = 1 and path like '%/1.pdf'").orderBy("seq").first()["text"] == "o"
    assert spark.read.format("pdf").options(partitionBytes="1000", pagesPerPartition="4").load(at).rdd.getNumPartitions() >= 7
    one = PdfReader({"path": f"{at}/2.pdf", "partitionbytes": "10", "pagesperpartition": "10"})
    assert [(p.first, p.end) for p in one.partitions()] == [(0, 10), (10, 20), (20, 30)] and len(list(one.read(Part([f"{at}/2.pdf"], 20, 30)))) == 5
    (tmp_path / "none").mkdir()
    assert spark.read.format("pdf").load(f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="missing"):
        spark.read.format("pdf").load(f"file://{tmp_path}/missing").count()


def test_engine_reads_files(spark, tmp_path):
    """From files to chunks that know their chapters, and to answers."""
    from lectern.plans.engine import Engine

    pages = [(1, 1, "Chapter 1: Start\nabout a cnn and how it learns"), (1, 2, "more of it\nand the end"), (1, 3, "Chapter 2: Trees\na forest is a set of trees"), (2, 1, "other book\nwithout chapters")]
    at = f"file://{tmp_path}/in"
    pdf_files.write_books(spark.createDataFrame(pages, "book_id long, page int, text string"), at).collect()
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest_files(at, "chapter")
    rows = engine.store.read().collect()
    assert {r["book_title"] for r in rows} == {"1"} and {(r["page_start"], r["page_end"], r["chapter_titles"][0][:9]) for r in rows} >= {(3, 3, "Chapter 2")}
    engine.ingest_files(at, "flat")
    assert {r["book_title"] for r in engine.store.read().collect()} == {"1", "2"}
    answer = engine.ask(spark.createDataFrame([(1, "what is a forest of trees?")], "qid long, raw_query string")).first()["response"]["answer"]
    assert "forest" in answer
