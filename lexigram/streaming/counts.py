"""Counts of arriving documents' n-grams, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.functions.text import tokens
from lexigram.operators.aggregate import count_windows
from lexigram.operators.windows import array_windows


def stream_counts(docs: DataFrame, n: int, text_col: str = "text", stop: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """``t1..tn, count`` of a streaming (or static) frame; each row is a sequence of its own.

    Windows are made within a row, so the only state is the counts.
    """
    return count_windows(array_windows(docs, n, tokens(F.col(text_col)), stop=stop, ignore=ignore), n)
