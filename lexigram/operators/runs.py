"""Counts of long windows that shuffle runs of windows instead of every window.

A window of n tokens shares n-1 of them with the next.  Windows in a row whose least token
(by a key of the token alone) is the same go together to the task of that token, as one string:
(n+1)/2 windows on average, so that a token is shuffled about 2 to 3 times and not n times.
Equal windows have equal least tokens and meet in one task, which tells the runs apart and
counts; the result is exact and no window is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigram.config import check_n
from lexigram.operators.windows import names

#: Windows of a run at most, and bytes of input (Parquet) whose windows one task counts.
RUN, PART_BYTES = 256, 4 << 20
#: Tokens of so many bytes are too frequent to lead a window; windows of such tokens only are dealt by all of them.
SHORT = 3
_LONGEST, _SCALE = 31, 1 << 58
#: Sizes from here on are Spark's guess for what it can't size.
_UNKNOWN = 1 << 50


def _key(token: Column) -> Column:
    """Orders tokens: longer ones first, since they are rarer, then by hash."""
    return F.shiftrightunsigned(F.xxhash64(token), 6) - F.least(F.octet_length(token), F.lit(_LONGEST)) * F.lit(_SCALE)


def _least(n: int, rows: DataFrame) -> DataFrame:
    """``__m``, the least of each n keys in a row, by doubling."""
    rows, width = rows.withColumn("__m", F.transform("__t", _key)), 1
    while width < n:
        step = min(width, n - width)
        count = F.greatest(F.size("__m") - step, F.lit(0))
        rows = rows.withColumn("__m", F.zip_with(F.slice("__m", F.lit(1), count), F.slice("__m", F.lit(1 + step), count), lambda a, b: F.least(a, b)))
        width += step
    return rows


def partitions(rows: DataFrame) -> int:
    """Tasks by the size of the input, so that the windows of one fit its memory; as usual where Spark doesn't know it."""
    spark = rows.sparkSession
    size, least = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // PART_BYTES)) if size < _UNKNOWN else least


def count_runs(rows: DataFrame, n: int, tokens: Column, min_freq: int = 0, parts: int | None = None) -> DataFrame:
    """``t1..tn, count`` as ``count_windows`` over ``array_windows``; tokens hold no line feed and are neither null nor empty."""
    check_n(n)
    parts = parts or partitions(rows)
    base = rows.select(tokens.alias("__t")).where(F.size("__t") >= n)
    led = _least(n, base)
    short = F.lit(-(SHORT + 1) * _SCALE)
    led = led.withColumn("__m", F.transform("__m", lambda m, i: F.when(m < short, m).otherwise(F.xxhash64(F.slice("__t", i + 1, F.lit(n))))))
    size = F.size("__m")
    # a run is cut at every RUN-th place of its row
    begins = lambda i: (i % RUN == 0) | (F.get("__m", i) != F.get("__m", i - 1))
    led = led.withColumn("__s", F.filter(F.sequence(F.lit(0), size - 1), begins))
    held = lambda s, j: F.struct(
        F.get("__m", s).alias("__lead"),
        F.array_join(F.slice("__t", s + 1, F.coalesce(F.get("__s", j + 1), size) - s + (n - 1)), "\n").alias("__run"),
    )
    runs = led.select(F.inline(F.transform("__s", held))).repartition(parts, "__lead")
    told = runs.select("__lead", F.split("__run", "\n").alias("__t"))
    count = F.size("__t") - (n - 1)
    windows = F.arrays_zip(*[F.slice("__t", F.lit(i + 1), count).alias(t) for i, t in enumerate(names(n))])
    # dealt by the leading token already: no exchange follows
    counts = told.select("__lead", F.inline(windows).alias(*names(n))).groupBy("__lead", *names(n)).agg(F.count("*").alias("count"))
    return (counts.where(F.col("count") >= min_freq) if min_freq > 1 else counts).drop("__lead")
