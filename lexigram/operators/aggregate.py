"""Counts of windows, first-seen attributes, dictionaries and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigram.operators.windows import names


def count_windows(windows: DataFrame, n: int, min_freq: int = 0, attrs: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``t1..tn, count`` and the attributes of each n-gram's first occurrence.

    ``order`` names what orders occurrences (document, position).  Counting and the least
    occurrence are combined before the shuffle.
    """
    aggs = [F.count("*").alias("count")]
    if attrs:
        if not order:
            raise ValueError("attributes need an order of occurrences")
        at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
        # one number by another stays in the hash table; others are sorted
        aggs.append(F.min_by(F.col(attrs[0]) if len(attrs) == 1 else F.struct(*attrs), at).alias("__first"))
    out = windows.groupBy(*names(n)).agg(*aggs)
    if min_freq > 1:
        out = out.where(F.col("count") >= min_freq)
    firsts = [F.col("__first").alias(attrs[0])] if attrs and len(attrs) == 1 else [F.col("__first")[a].alias(a) for a in attrs or []]
    return out.select(*names(n), "count", *firsts)


def decoded_attributes(rows: DataFrame, attrs: list[str], combinations: list[tuple]) -> DataFrame:
    """The attributes for the number ``__a`` of their combination."""
    schema = ", ".join(["__a int", *[f"`{a}` string" for a in attrs]])
    known = rows.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(combinations)], schema)
    return rows.join(F.broadcast(known), "__a", "left").drop("__a")


#: Ranges that rows are numbered in, and sampled rows for each bound.
_RANGES, _PER_RANGE = 200, 25
#: Bounds between two that a row is compared with first.
_STEP = 14


def dense_ids(rows: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Numbers distinct rows from 0 in order.

    The rows are dealt by ranges of the order, whose bounds come from a bounded sample (the
    rows of the least hashes), so that no common beginning fills a task; a window never holds
    more than a range, or a row for each range.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    sample = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(_RANGES * _PER_RANGE).orderBy("k").collect()
    step = max(_PER_RANGE, -(-len(sample) // _RANGES))
    bounds = rows.sparkSession.createDataFrame([(r["k"],) for r in sample[step::step]], rows.select(key.alias("k")).schema) if len(sample) > step else None
    if bounds is None:
        dealt = rows.withColumn("__b", F.lit(0))
    else:  # at most _RANGES bounds, as one row
        held = bounds.agg(F.sort_array(F.collect_list("k")).alias("__bounds"))
        # every _STEP-th bound first, then those after the last of them: not each is compared with
        upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
        coarse = F.filter("__bounds", lambda b, i: (i + 1) % _STEP == 0)
        dealt = rows.join(F.broadcast(held.withColumn("__coarse", coarse))).withColumn("__c", upto("__coarse") * _STEP)
        dealt = dealt.withColumn("__b", F.col("__c") + upto(F.slice("__bounds", F.col("__c") + 1, F.lit(_STEP)))).drop("__bounds", "__coarse", "__c")
    sizes = dealt.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    out = here.join(sizes.select("__b", before.alias("__before")), "__b")
    return out.withColumn(name, (F.col("__before") + F.col("__k") - 1).cast("long")).drop("__b", "__k", "__before")


def vocabulary(tokens: DataFrame, column: str = "tok") -> DataFrame:
    """Every different token, also of sequences too short for a window."""
    return tokens.select(F.col(column).alias("word")).where("word is not null").distinct()


def word_dictionary(tokens: DataFrame, column: str = "tok") -> DataFrame:
    """``word, id``: ids are ranks from 0 in byte order."""
    return dense_ids(vocabulary(tokens, column), [F.col("word")])


def attribute_dictionary(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """``value, id``: numbered from 0 by first appearance."""
    first = rows.groupBy(F.col(value).alias("value")).agg(F.min(F.struct(*order)).alias("__at"))
    return dense_ids(first, [F.col("__at"), F.col("value")]).select("value", "id")


def levels(index: DataFrame, n: int) -> DataFrame:
    """One row: how many different prefixes of each length the index has."""
    # from the longest prefix to the shortest, so that each step sees the rows of the one before and none is repeated
    last, sums = index.select(*names(n), F.lit(1).cast("long").alias(f"__l{n}")), [f"__l{n}"]
    for k in range(n - 1, 0, -1):
        last = last.groupBy(*names(k)).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(f"__l{k}", F.lit(1).cast("long"))
        sums.append(f"__l{k}")
    return last.agg(*[F.coalesce(F.sum(f"__l{k}"), F.lit(0)).alias(f"level{k}") for k in range(1, n + 1)])


def decode(rows: DataFrame, dictionary: DataFrame, id_col: str, out_col: str) -> DataFrame:
    """Words for ids, by a join that keeps every row."""
    side = dictionary.select(F.col("id").alias(id_col), F.col("word").alias(out_col))
    return rows.join(side, id_col, "left")


def encode(rows: DataFrame, dictionary: DataFrame, word_col: str, out_col: str) -> DataFrame:
    """Ids for words; -1 where the dictionary has none.

    A left join, whose hot words adaptive execution splits on the side of the rows.
    """
    side = dictionary.select(F.col("word").alias(word_col), F.col("id").alias(out_col))
    return rows.join(side, word_col, "left").withColumn(out_col, F.coalesce(out_col, F.lit(-1)).cast("long"))
