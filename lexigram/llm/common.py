"""Session and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that numpy code looks at together; its scratch arrays take about 60 times as much.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, as in tests, else an error."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexigram-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session wrote, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_till_exit(spark: SparkSession, path: str) -> str:
    """Makes a folder that is deleted when the driver ends, for results that a returned frame still reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


#: Rows of one key that a task may well get, and keys over it that are broadcast at most.
_HOT_ROWS, _HOT_KEYS = 10_000, 50_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, n: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``side``, which has each of their keys once and in ``n`` how many of ``n_rows`` rows it has.

    Keys of many rows are broadcast: of those over ``n_rows / _HOT_KEYS`` rows there are
    ``_HOT_KEYS`` at most.  The others are joined by a shuffle in which no key is hot.
    """
    hot = F.col(n) > max(_HOT_ROWS, -(-n_rows // _HOT_KEYS))
    if n_rows <= _HOT_ROWS:
        return rows.join(side.drop(n), key)
    few = F.broadcast(side.where(hot).drop(n))
    rest = rows.join(few.select(key), key, "left_anti").join(side.where(~hot).drop(n), key)
    return rows.join(few, key).unionByName(rest)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, computed once, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; null texts become empty ones."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (one more than there are texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (a longer text comes alone)."""
    for batch in batches:
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(lens, dtype=np.int64), 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, most_bytes: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, float | None]:
    """Texts, labels (0 or 1) and the share of label 1 among all labelled rows (None: there are none), for a model to be fitted on.

    At most ``sample`` documents of each label, those with the least hashes of the id, and of
    those the first with ``most_bytes`` of text for each label.  An id counts once, however often the tables
    repeat it (with the least of its texts), and not at all where its labels contradict each other.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    share = known.agg(F.avg("y")).first()[0]
    if share is None:
        return [], np.zeros(0, int), None
    once = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    picked = None
    for y in (0, 1):
        some = once.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(read.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    # a row for each sampled document; the order is that of a hash, so that any part of it is a sample
    known_rows = rows.select("doc_id", "y", F.octet_length("text").alias("size"), F.xxhash64(F.lit(1), "doc_id").alias("at")).collect()
    chosen, total = {}, {0: 0, 1: 0}
    for r in sorted(known_rows, key=lambda r: (r["at"], str(r["doc_id"]))):
        total[r["y"]] += r["size"]
        if total[r["y"]] <= most_bytes or total[r["y"]] == r["size"]:
            chosen[r["doc_id"]] = len(chosen)
    if len(chosen) < len(known_rows):
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in chosen], rows.select("doc_id").schema)), "doc_id", "left_semi")
    got = sorted(rows.collect(), key=lambda r: chosen[r["doc_id"]])
    return [r["text"] for r in got], np.array([r["y"] for r in got], int), float(share)
