"""An index as sorted Parquet, its dictionaries, and the text export."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigram.config import attr_column
from lexigram.functions.text import export_line
from lexigram.operators.windows import names
from lexigram.plans.search import index_n


#: Bytes of a row group and of a page: a lookup reads one small group, and of that the pages that its word lies in.
GROUP_BYTES, PAGE_BYTES = 16 << 20, 128 << 10


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors see it, deleted when the driver ends."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/lexigram-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def write_index(ngrams: DataFrame, path: str, dealt: bool = False) -> None:
    """Sorted by all tokens and dealt by ranges of them, so that frequent first tokens spread and lookups prune; ``dealt`` says that they are already."""
    n = index_n(ngrams)
    dealt = ngrams if dealt else ngrams.repartitionByRange(*names(n)).sortWithinPartitions(*names(n))
    dealt.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str, attrs: list[str] | None = None) -> DataFrame:
    """An index with the asked attributes only."""
    index = spark.read.parquet(path)
    if attrs is None:
        return index
    columns = [attr_column(a) for a in attrs]
    unknown = [a for a, c in zip(attrs, columns, strict=True) if c not in index.columns]
    if unknown:
        raise ValueError(f"unknown attributes: {unknown}")
    return index.select(*names(index_n(index)), "count", *columns)


def export_lines(ngrams: DataFrame, min_freq: int = 0) -> DataFrame:
    """Lines ``t1<TAB>..<TAB>count`` in the order of the tokens."""
    n = index_n(ngrams)
    return ngrams.where(F.col("count") >= min_freq).orderBy(*names(n)).select(export_line(n).alias("line"))


def write_export(ngrams: DataFrame, path: str, min_freq: int = 0, one_file: bool = False) -> None:
    """A folder of text files whose order is that of their names; one file only on request."""
    lines = export_lines(ngrams, min_freq)
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)
