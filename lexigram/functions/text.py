"""Column expressions over text: tokens, charsets, lines of an export."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between tokens of plain text.
DELIMITERS = r"[,.\t\n\f\r ;?!:]+"
#: Charsets that Spark decodes by itself.
_NATIVE = {"utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE"}


def tokens(text: Column) -> Column:
    """Lower-cased tokens of plain text, without empty ones."""
    return F.array_remove(F.split(F.lower(text), DELIMITERS), "")


def check_charset(name: str) -> str:
    try:
        return codecs.lookup(name or "utf-8").name
    except LookupError:
        raise ValueError(f"unknown charset {name!r}") from None


def keeps_lines(charset: str) -> bool:
    """Whether bytes of this charset can be split at line feeds before they are decoded."""
    name = check_charset(charset)
    return "a\r\nb".encode(name) == b"a\r\nb" and not name.startswith(("utf-7", "utf7", "iso2022", "iso-2022", "hz"))


def decoded(content: Column, charset: str) -> Column:
    """Bytes to text; charsets that Spark lacks go through an Arrow function."""
    name = check_charset(charset)
    if name in _NATIVE:
        return F.decode(content, _NATIVE[name])

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(name))

    return decode(content)


def export_line(n: int, count: str = "count") -> Column:
    return F.concat_ws("\t", *[F.col(f"t{i}") for i in range(1, n + 1)], F.col(count).cast("string"))
