"""Table functions for SQL: token windows of books, and entries of tables of contents.

register() makes them known to a session:

    SELECT * FROM token_windows(TABLE(pages) PARTITION BY book_id ORDER BY (page), 1500, 200)
    SELECT id, e.* FROM lines, LATERAL contents_entries(text) e

token_windows takes a table with the columns book_id, page and text and gives what chunking.windows and
chunking.page_ranges give. It holds one window of a book at a time, whatever the book's length. Null texts have
no tokens; a table without rows has no windows."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions.tokens import TOKEN


class TokenWindows:
    _token = re.compile(TOKEN.replace(r"\z", r"\Z"))

    def __init__(self) -> None:
        self.book: Any = None
        self.size = self.step = 1
        self.tokens: deque[str] = deque()
        self.pages: deque[tuple[int, int, int]] = deque()
        self.seen = self.start = self.k = 0

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        self.book, self.size, self.step = row["book_id"], size, max(1, size - overlap)
        found = self._token.findall(row["text"] or "")
        self.pages.append((row["page"], self.seen, self.seen + len(found)))
        self.seen += len(found)
        self.tokens.extend(found)
        while self.seen >= self.start + self.size:
            yield self._window()

    def terminate(self) -> Iterator[tuple]:
        while self.start < self.seen:
            yield self._window()

    def _window(self) -> tuple:
        s, e = self.start, min(self.start + self.size, self.seen)
        pages = [p for p, a, b in self.pages if a < e and b > s]
        out = (self.book, self.k, s, e, "".join(self.tokens[i] for i in range(e - s)), min(pages, default=1), max(pages, default=1))
        self.start, self.k = s + self.step, self.k + 1
        for _ in range(min(self.step, len(self.tokens))):
            self.tokens.popleft()
        while self.pages and self.pages[0][2] <= self.start and self.pages[0][1] < self.start:
            self.pages.popleft()
        return out


class ContentsEntries:
    """Entries of the lines of a text, in their order."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for line, raw in enumerate(re.split(r"\r\n|\r|\n", text or "")):
            x = re.sub(r"^\s+|\s+$", "", raw, flags=re.ASCII)
            for pattern, number, title, page in t.CONTENTS_PATTERNS if len(x) >= 3 else []:
                m = re.search(pattern, x, re.ASCII)
                if m and len(m[title].strip()) >= 2:
                    n, name = m[number] if number else None, m[title].strip()
                    top = any(w in name.lower() for w in ("chapter", "part", "appendix"))
                    yield line, n, name, int(m[page]), min(n.count(".") + 1, 3) if n else 1 if top else 2
                    break


def register(spark: SparkSession) -> None:
    windows = F.udtf(TokenWindows, returnType="book_id bigint, k int, token_start int, token_end int, text string, page_start int, page_end int")
    entries = F.udtf(ContentsEntries, returnType="line int, number string, title string, page bigint, level int")
    spark.udtf.register("token_windows", windows)
    spark.udtf.register("contents_entries", entries)
