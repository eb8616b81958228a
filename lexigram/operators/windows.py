"""Sliding windows of n tokens.

Two shapes of input.  Rows that hold a whole sequence as an array (documents, chat turns) are
windowed within the row: the array and its shifted copies are zipped and exploded, so nothing
is shuffled before counting.  Token streams (files of one token a line) have a position for
every token; they are cut into blocks of positions that carry the first tokens of the next
block, so that windows never depend on how long a file or a sentence is.

A stop string or a break is a null token: no window holds one.  Ignored strings are removed
first, so windows bridge them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigram.config import check_n
from lexigram.functions.filters import ColumnFilter

#: Positions of a stream that one window partition holds.
BLOCK = 100_000


def names(n: int, prefix: str = "t") -> list[str]:
    return [f"{prefix}{i}" for i in range(1, n + 1)]


def _kept(n: int, stop: list[str]) -> Column:
    """Complete windows without an empty token, a break or a stop string."""
    parts = [F.col(f"t{n}").isNotNull()]
    for t in names(n):
        parts.append(F.col(t) != "")
        if stop:
            parts.append(~F.col(t).isin(*stop))
    return reduce(lambda a, b: a & b, parts)


def array_windows(
    rows: DataFrame,
    n: int,
    tokens: Column,
    keep: list[Column] | None = None,
    stop: list[str] | None = None,
    ignore: list[str] | None = None,
    accept: ColumnFilter | None = None,
    tags: Column | None = None,
    with_pos: bool = False,
) -> DataFrame:
    """``t1..tn`` (and ``pos``) of every window of each row's tokens, beside the kept columns.

    ``tags`` is an array that lies along ``tokens``; ``accept`` sees the words and tags of a
    window.  With ignored strings, tags are removed with their tokens.
    """
    check_n(n)
    keep, stop, ignore = keep or [], stop or [], ignore or []
    base = rows.select(*keep, tokens.alias("__t"), *([tags.alias("__g")] if tags is not None else []))
    if ignore:
        if tags is not None:
            pairs = F.filter(F.arrays_zip("__t", "__g"), lambda p: ~p["__t"].isin(*ignore))
            base = base.withColumn("__p", pairs).withColumns({"__t": F.col("__p.__t"), "__g": F.col("__p.__g")}).drop("__p")
        else:
            base = base.withColumn("__t", F.filter("__t", lambda t: ~t.isin(*ignore)))
    size = F.greatest(F.size("__t") - (n - 1), F.lit(0))  # none where the row is too short
    columns = [F.slice("__t", F.lit(i), size).alias(f"t{i}") for i in range(1, n + 1)]
    if tags is not None:
        columns += [F.slice("__g", F.lit(i), size).alias(f"g{i}") for i in range(1, n + 1)]
    zipped = F.arrays_zip(*columns)
    kept_names = [c for c in base.columns if c not in ("__t", "__g")]
    fields = names(n) + (names(n, "g") if tags is not None else [])
    if with_pos:
        out = base.select(*kept_names, F.posexplode(zipped).alias("pos", "__w")).select(*kept_names, "pos", *[F.col("__w")[f].alias(f) for f in fields])
    else:
        out = base.select(*kept_names, F.inline(zipped).alias(*fields)) if len(fields) > 1 else base.select(*kept_names, F.explode(F.slice("__t", F.lit(1), size)).alias("t1"))
    out = out.where(_kept(n, stop))
    if accept is not None:
        out = out.where(accept([F.col(t) for t in names(n)], [F.col(g) for g in names(n, "g")] if tags is not None else []))
    return out


def numbered(rows: DataFrame, chunk: list[str], order: str, size: Column | None = None) -> DataFrame:
    """Adds ``pos``, a number without gaps over the chunks of each file, of a row or of the first of ``size`` tokens in it.

    ``chunk`` names the columns (file, then place in the file) of pieces that were read
    together, ``order`` one that ascends within a piece.  Only a row for each piece is ever
    summed up in order.
    """
    file, *rest = chunk
    size = F.lit(1) if size is None else size
    counts = rows.groupBy(*chunk).agg(F.sum(size).alias("__n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("__n").over(upto(Window.partitionBy(file).orderBy(*rest)))
    offsets = counts.select(*chunk, F.coalesce(before, F.lit(0)).alias("__before"))
    here = rows.withColumn("__k", F.coalesce(F.sum(size).over(upto(Window.partitionBy(*chunk).orderBy(order))), F.lit(0)))
    return here.join(offsets, chunk).withColumn("pos", F.col("__before") + F.col("__k")).drop("__k", "__before")


def stream_windows(
    tokens: DataFrame,
    n: int,
    sequence: str,
    carry: list[str] | None = None,
    stop: list[str] | None = None,
    accept: ColumnFilter | None = None,
    tag: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``sequence, pos, t1..tn`` of every window of a stream ``(sequence, pos, tok)``.

    ``carry`` columns come from a window's last token.
    """
    check_n(n)
    carry, stop = carry or [], stop or []
    own = F.floor(F.col("pos") / block)
    halo = F.when((F.col("pos") % block < n - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = tokens.withColumn("__b", F.explode(halo))
    w = Window.partitionBy(sequence, "__b").orderBy("pos")
    ahead = [F.lead("tok", i).over(w).alias(f"t{i + 1}") for i in range(n)]
    tags = [F.lead(tag, i).over(w).alias(f"g{i + 1}") for i in range(n)] if tag else []
    last = [F.lead(c, n - 1).over(w).alias(c) for c in carry]
    out = dealt.select(sequence, "pos", "__b", *ahead, *tags, *last).where((F.floor(F.col("pos") / block) == F.col("__b")) & _kept(n, stop)).drop("__b")
    if accept is not None:
        out = out.where(accept([F.col(t) for t in names(n)], [F.col(g) for g in names(n, "g")] if tag else []))
    return out.drop(*names(n, "g")) if tag else out


def packed_windows(
    rows: DataFrame,
    n: int,
    carry: list[str] | None = None,
    stop: list[str] | None = None,
    accept: ColumnFilter | None = None,
    tag: str | None = None,
    kept: str = "",
) -> DataFrame:
    """``t1..tn`` of every window of rows ``(at, tok)`` that repeat the n-1 tokens before them; with ``carry``, also ``pos`` and those columns of the last token."""
    check_n(n)
    carry, size = carry or [], F.greatest(F.size("tok") - (n - 1), F.lit(0))
    columns = [F.slice("tok", F.lit(i), size).alias(t) for i, t in enumerate(names(n), 1)]
    columns += [F.slice(tag, F.lit(i), size).alias(g) for i, g in enumerate(names(n, "g"), 1)] if tag else []
    columns += [F.slice(c, F.lit(n), size).alias(c) for c in carry]
    zipped = F.arrays_zip(*columns)
    fields = [*names(n), *(names(n, "g") if tag else []), *carry]
    if carry:
        out = rows.select("at", F.posexplode(zipped).alias("__k", "__w")).select((F.col("at") + F.col("__k")).alias("pos"), *[F.col("__w")[f].alias(f) for f in fields])
    else:
        out = rows.select(F.inline(zipped).alias(*fields))
    out = out.where(kept or _kept(n, stop or []))
    if accept is not None:
        out = out.where(accept([F.col(t) for t in names(n)], [F.col(g) for g in names(n, "g")] if tag else []))
    return out.drop(*names(n, "g")) if tag else out
