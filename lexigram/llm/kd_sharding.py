"""Shards as the leaves of a k-d tree over document metadata, near equal in bytes.

Dimensions are the logarithm of a document's size, its language and its source; a
category stands at a hash of its name, so that equal ones lie together.  A node is
split along its widest dimension (spread of its rows against that of the table) at the
weighted median of sizes.  Below a position's value lie bits of a hash of id and text, so a
category that holds a third of all rows splits as evenly as any other, and below those, for
rows that repeat id and text, bits of their place in the input.  The median is exact to one
of these positions: aggregations of 65,536 buckets a node narrow it down, each combined
before the shuffle, and a bucket is found in two steps of 256, so that no task sees more rows
of a node.

DataFrame functions only.  The driver sees a row per node, of which there are fewer than
twice the shards.  Null texts count as empty, null categories and ids as values of their
own; rows that repeat id and text are dealt out like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexigram.llm.common import cut

_DIMS = ("size_at", "lang_at", "source_at")
#: Plans of this many nodes and fewer are broadcast.
_BROADCAST_NODES = 50_000


def _category(name: str) -> Column:
    return F.when(F.col(name).isNull(), 0).otherwise(F.shiftright(F.crc32(F.col(name).cast("string").cast("binary")), 9))


def _positions(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The narrow rows that all further steps read: 47-bit positions in each dimension, and 16 bits of the place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.least(F.floor(F.log2(size) * (2**23 / 48)), F.lit(2**23 - 1)).alias("size_at"),
        _category(lang_col).alias("lang_at"),
        _category(source_col).alias("source_at"),
    )
    low = [F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(i)), F.lit(2**24)) for i in range(3)]
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**16)).alias("place")
    return base.select("doc_id", "size", "text_crc32", place, *[(F.col(d) * (2**24) + low[i]).cast("long").alias(d) for i, d in enumerate(_DIMS)])


def _spread(dim: str) -> Column:
    """Of the values, without the bits of the id below them."""
    return F.max(F.shiftright(dim, 24)) - F.min(F.shiftright(dim, 24))


def _join(rows: DataFrame, plan: list[tuple], schema: str) -> DataFrame:
    if len(plan) == 1:  # all rows are in one node
        names = [c.split(" ") for c in schema.split(", ")][1:]
        return rows.where(F.col("node") == plan[0][0]).withColumns({c: F.lit(v).cast(t) for (c, t), v in zip(names, plan[0][1:], strict=True)})
    side = rows.sparkSession.createDataFrame(plan, schema)
    return rows.join(F.broadcast(side) if len(plan) <= _BROADCAST_NODES else side, "node")


def _crossed(bins: DataFrame, key: str, below: str) -> DataFrame:
    """For each node the first bin at which the weights from ``below`` on reach the goal, or else the last."""
    upto = F.col(below) + F.sum("w").over(Window.partitionBy("node").orderBy(key))  # 256 rows a node at most
    last = F.max(key).over(Window.partitionBy("node"))
    reached = bins.withColumns({"upto": upto, "last": last}).where((F.col("upto") >= F.col("goal")) | (F.col(key) == F.col("last")))
    return reached.groupBy("node").agg(F.min(F.struct(key, "upto", "w", "goal", "rows")).alias("x"))


#: Levels of 16 bits of a row's position; the last only tells rows apart that repeat id and text.
_LEVELS = 4


def _key(level: int) -> Column:
    """The bits of a row's position down to a level."""
    at = F.when(F.col("dim") == 0, F.col(_DIMS[0])).when(F.col("dim") == 1, F.col(_DIMS[1])).otherwise(F.col(_DIMS[2]))
    return F.shiftright(at * (2**16) + F.col("place"), 48 - 16 * level)


def _medians(rows: DataFrame, wanted: dict[int, tuple[str, float]]) -> dict[int, int]:
    """For each node (dimension, bytes to the left) the position below which they lie."""
    at, found = {node: (0, 0.0) for node in wanted}, {}
    sums = (F.sum("w").alias("w"), F.sum("rows").alias("rows"), F.first("goal").alias("goal"))
    for level in range(_LEVELS):
        plan = [(n, _DIMS.index(wanted[n][0]), p, float(wanted[n][1] - below)) for n, (p, below) in at.items()]
        held = _join(rows.withColumns({"w": F.col("size"), "rows": F.lit(1)}), plan, "node long, dim int, prefix long, goal double")
        held = held.withColumn("bin", _key(level)).where(F.shiftright("bin", 16) == F.col("prefix"))
        bins = held.groupBy("node", "bin").agg(*sums)
        blocks = bins.groupBy("node", F.shiftright("bin", 8).alias("block")).agg(*sums)
        block = _crossed(blocks.withColumn("zero", F.lit(0)), "block", "zero")
        block = block.select("node", F.col("x.block").alias("block"), (F.col("x.upto") - F.col("x.w")).alias("before"))
        inside = bins.withColumn("block", F.shiftright("bin", 8)).join(block, ["node", "block"])
        for r in _crossed(inside, "bin", "before").collect():
            x = r["x"]
            below = x["upto"] - x["w"]
            if level == _LEVELS - 1 or x["rows"] == 1:  # left or right of the bin, whichever is nearer
                nearer = x["upto"] - x["goal"] < x["goal"] - below
                found[r["node"]] = (x["bin"] + nearer) << (48 - 16 * level)
                del at[r["node"]]
            else:
                at[r["node"]] = (x["bin"], at[r["node"]][1] + below)
        if not at:
            break
    return found


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``n_shards`` leaves of near equal bytes, or as many as ``target_bytes`` asks for.
    Slots number the rows of a shard from 0 without gaps.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give either n_shards or target_bytes")
    rows = cut(_positions(docs, id_col, text_col, lang_col, source_col)).withColumn("node", F.lit(1).cast("long"))
    whole = rows.agg(F.sum("size").alias("bytes"), *[_spread(d).alias(d) for d in _DIMS]).first()
    total = whole["bytes"] or 0
    leaves = {1: n_shards or max(1, -(-total // target_bytes))}
    spread = {d: max(1, whole[d] or 0) for d in _DIMS}
    while any(k > 1 for k in leaves.values()):
        stats = {
            r["node"]: r
            for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[_spread(d).alias(d) for d in _DIMS]).collect()
        }
        wanted = {}
        for node, k in leaves.items():
            if k > 1 and node in stats:
                widest = max(_DIMS, key=lambda d, s=stats[node]: s[d] / spread[d])
                wanted[node] = (widest, stats[node]["bytes"] * (k // 2) / k)
        medians = _medians(rows, wanted)
        plan, after = [], {}
        for node, k in leaves.items():
            if k > 1:
                after |= {2 * node: k // 2, 2 * node + 1: k - k // 2}
                if node in wanted:
                    plan.append((node, _DIMS.index(wanted[node][0]), medians[node]))
            else:
                after[2 * node] = 1
                plan.append((node, -1, 0))
        moved = _join(rows, plan, "node long, dim int, cut long")
        right = F.when(F.col("dim") >= 0, (_key(_LEVELS - 1) >= F.col("cut")).cast("long")).otherwise(F.lit(0).cast("long"))
        rows = cut(moved.withColumn("node", F.col("node") * 2 + right).drop("dim", "cut"))
        leaves = after
    done = {node: i for i, node in enumerate(sorted(leaves))}
    sharded = _join(rows, list(done.items()), "node long, shard int").select("doc_id", "size", "text_crc32", "place", "shard")
    return _slots(sharded)


def _slots(sharded: DataFrame) -> DataFrame:
    """Numbers the rows of each shard, bucket after bucket of a hash of id, text and place."""
    n = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "place"), F.lit(n)).cast("int"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    dealt = bucketed.withColumn("in_bucket", number)
    filled = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = filled.select("shard", "bucket", before.alias("before"))
    out = dealt.join(filled, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in_bucket") - 1).cast(T.LongType()).alias("slot"))
