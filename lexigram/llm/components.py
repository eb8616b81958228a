"""Connected components by alternating large-star and small-star steps.

Each step takes the least neighbour of every node (an aggregation that is combined
before the shuffle) and joins it back; nodes with very many neighbours are joined by a
broadcast of bounded size, so no node's neighbours are ever gathered in one place.
Every round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.llm.common import cut, join_hot


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    larger = join_hot(both.where("v > u"), least, "u", "n", 2 * n)
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges hold the larger node in ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(edges, least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of one orderable type to ``(node, root)``: the least node of each component.

    Self-links and repeated edges don't matter; nodes without another are not returned.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        after = cut(_small_star(_large_star(now, mark[0]), mark[0]))
        was, mark, now = mark, _mark(after), after
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
