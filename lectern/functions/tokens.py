"""Tokenisers as column functions. The default is native and lossless: joining the tokens gives
the text. A tokeniser of one's own is any function from a text column to array<string>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]
TOKEN = r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+\z"


def lossless(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, "")
