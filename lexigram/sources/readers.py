"""Token sources: plain text files, vertical files, tables.

Compression is by the file's extension (``.gz``, ``.bz2``), as everywhere in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigram.config import attr_column
from lexigram.functions.text import check_charset, decoded, keeps_lines, tokens
from lexigram.operators.windows import numbered

_ID = r"^[A-Za-z_][A-Za-z0-9_]*$"
_LINE = r"^</?[A-Za-z_]"
SPREAD_BYTES = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Deals the rows of a small table (under ``SPREAD_BYTES`` a core) out to all cores.

    Pieces of a Parquet file are no measure: all rows may lie in one row group, which one task
    reads.  Larger tables stay as they are and are never shuffled by this.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


def table_tokens(rows: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep..., tok, pos`` of every token of every row; each row is a sequence of its own."""
    keep = keep or ["doc_id"]
    return rows.select(*keep, F.posexplode(tokens(F.col(text_col))).alias("pos", "tok"))


def _told(rows: DataFrame, chunk: list[str], words: Column, ignore: list[str] | None) -> DataFrame:
    """``file, pos, tok`` of the words in rows ``(chunk..., key)``: rows are numbered and then exploded."""
    if ignore:
        words = F.filter(words, lambda t: ~t.isin(*ignore))
    held = rows.select(*chunk, "key", words.alias("__t")).where(F.size("__t") > 0)
    placed = numbered(held, chunk, "key", F.size("__t")).select("file", "pos", F.posexplode("__t").alias("__k", "tok"))
    return placed.select("file", (F.col("pos") + F.col("__k")).alias("pos"), "tok")


def table_stream(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", ignore: list[str] | None = None, rows_a_piece: int = 4096) -> DataFrame:
    """All rows as one stream ``(file, pos, tok)`` in the order of their integer ids: windows run across rows."""
    named = rows.select(F.lit("").alias("file"), F.floor(F.col(id_col) / rows_a_piece).alias("at"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return _told(named, ["file", "at"], tokens(F.col("text")), ignore)


#: Lines that are numbered together, so that a file that can't be split (gzip) isn't one task's work.
PIECE_LINES = 65_536


def _lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """``file, at, sub, line, key`` of every line; ``at`` is the start of the piece of file, ``sub`` a part of it, ``key`` orders within."""
    name = check_charset(charset)
    file, key = F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("key")
    # lines of a partition are numbered from 0 in the low 33 bits of the key
    sub = F.floor(F.col("key").bitwiseAND(F.lit(2**33 - 1)) / PIECE_LINES).alias("sub")
    if keeps_lines(name):
        raw = spark.read.text(path).select(file, F.col("_metadata.file_block_start").alias("at"), key, F.col("value").alias("line"))
        # the text source hands bytes on as they are
        return raw.select("file", "at", sub, "key", (F.col("line") if name == "utf-8" else decoded(F.col("line").cast("binary"), charset)).alias("line"))
    # others are read file by file, since a line feed's bytes needn't be one; the text source decompresses (binaryFile doesn't)
    raw = spark.read.text(path, wholetext=True)
    text = raw.select(file, F.lit(0).cast("long").alias("at"), decoded(F.col("value").cast("binary"), charset).alias("text"))
    return text.select("file", "at", F.posexplode(F.split("text", "\r?\n")).alias("key", "line")).select("file", "at", sub, F.col("key").cast("long").alias("key"), "line")


#: What names a piece of a file that is numbered in one go.
_PIECE = ["file", "at", "sub"]


def plain(spark: SparkSession, path: str, charset: str = "utf-8", ignore: list[str] | None = None) -> DataFrame:
    """A stream ``(file, pos, tok)`` of a file's tokens in order; windows run across lines."""
    return _told(_lines(spark, path, charset), _PIECE, tokens(F.col("line")), ignore)


def _attribute(line: Column, name: str) -> Column:
    """An attribute's value in a structure's opening line; null where it has none."""
    found = F.regexp_extract_all(line, F.lit(rf'\s{re.escape(name)}\s*=\s*"([^"]*)"'), 1)
    return F.get(found, F.lit(0))


def structured(spark: SparkSession, path: str, attrs: list[str], charset: str, ignore_structs: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Lines of a vertical file, told apart, and what each says of the states: those of the attributes, then those of the structures."""
    lines = _lines(spark, path, charset).where("line is not null and line <> ''")
    is_struct = F.col("line").rlike(_LINE)
    name = F.when(is_struct, F.regexp_extract("line", r"^</?([A-Za-z_][A-Za-z0-9_]*)", 1))
    closes, alone = F.col("line").startswith("</"), F.col("line").rlike(r"/>\s*$")
    lines = lines.withColumns({"__struct": is_struct, "__name": name, "__open": is_struct & ~closes & ~alone, "__close": is_struct & closes})
    states: dict[str, Column] = {}
    for attr in attrs:
        struct, _, field = attr.partition(".")
        if not re.match(_ID, struct) or not field:
            raise ValueError(f"an attribute is named structure.attribute, not {attr!r}")
        mine = F.col("__name") == struct
        states[attr_column(attr)] = F.when(mine & F.col("__open"), F.struct(_attribute(F.col("line"), field).alias("v"))).when(mine & F.col("__close"), F.struct(F.lit(None).cast("string").alias("v")))
    for struct in ignore_structs:
        mine = F.col("__name") == struct
        states[f"__in_{struct}"] = F.when(mine & F.col("__open"), F.struct(F.lit("1").alias("v"))).when(mine & F.col("__close"), F.struct(F.lit(None).cast("string").alias("v")))
    return lines, states


def vertical(
    spark: SparkSession,
    path: str,
    attrs: list[str] | None = None,
    charset: str = "utf-8",
    tag_column: int = 0,
    ignore: list[str] | None = None,
    ignore_structs: list[str] | None = None,
    breaks: bool = True,
    strict: bool = False,
) -> DataFrame:
    """A stream ``(file, pos, tok, tag, attribute columns)`` of a vertical file.

    A line is a token with tab-separated columns (``tag_column`` of them is the tag) or opens
    or closes a structure.  ``doc.file`` is the attribute ``file`` of the innermost open
    ``doc`` so far; it is null before the first and after a close.  With ``breaks`` a
    structure line is a null token, which no window crosses.  Tokens inside a structure of
    ``ignore_structs`` are left out.  ``strict`` reads the file
    beforehand and raises where structures don't nest.
    """
    attrs, ignore_structs = attrs or [], ignore_structs or []
    lines, states = structured(spark, path, attrs, charset, ignore_structs)
    if strict:
        _check_nesting(lines)
    lines = _carried(lines, states)
    columns = F.split("line", "\t")
    tok = F.when(~F.col("__struct"), F.lower(columns[0]))
    out = lines.select(*_PIECE, "key", tok.alias("tok"), F.when(~F.col("__struct"), F.get(columns, F.lit(tag_column))).alias("tag"), "__struct", *[F.col(c) for c in states])
    if not breaks:
        out = out.where(~F.col("__struct"))
    if ignore:
        out = out.where(F.col("__struct") | ~F.col("tok").isin(*ignore))
    for struct in ignore_structs:
        out = out.where(F.col("__struct") | F.col(f"__in_{struct}").isNull())
    return numbered(out, _PIECE, "key").select("file", "pos", "tok", "tag", *[attr_column(a) for a in attrs])


def _carried(lines: DataFrame, states: dict[str, Column]) -> DataFrame:
    """Each state's last event up to a line: within a piece of a file, else from the pieces before."""
    if not states:
        return lines
    marked = lines.withColumns({f"__e{i}": s for i, s in enumerate(states.values())})
    run = Window.partitionBy(*_PIECE).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    here = marked.withColumns({f"__r{i}": F.last(f"__e{i}", ignorenulls=True).over(run) for i in range(len(states))})
    # the state at the end of every piece: a row a piece
    events = [F.max(F.when(F.col(f"__e{i}").isNotNull(), F.struct("key", f"__e{i}")))[f"__e{i}"].alias(f"__l{i}") for i in range(len(states))]
    ends = marked.groupBy(*_PIECE).agg(*events)
    back = Window.partitionBy("file").orderBy("at", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*_PIECE, *[F.last(f"__l{i}", ignorenulls=True).over(back).alias(f"__s{i}") for i in range(len(states))])
    joined = here.join(starts, _PIECE)
    return joined.withColumns({c: F.coalesce(f"__r{i}", f"__s{i}")["v"] for i, c in enumerate(states)}).drop(*[f"__{k}{i}" for k in "ers" for i in range(len(states))])


def _check_nesting(lines: DataFrame) -> None:
    """Raises where structures don't nest; reads the file once, before anything is made of it.

    Structures nest where, at every depth, openings and closings alternate, each closing bears
    the name of the opening before it, and no depth is below 0 or left open.  Depths are sums
    over pieces of files; an event's forerunner at its depth is in its piece, or else the last
    of that depth in the pieces before: a row for each piece and depth.
    """
    events = lines.where(F.col("__open") | F.col("__close")).select(*_PIECE, "key", F.col("__name").alias("name"), F.when(F.col("__open"), 1).otherwise(-1).alias("step"))
    before = lambda *by: Window.partitionBy("file", *by).orderBy("at", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy(*_PIECE).agg(F.sum("step").alias("n"))
    offsets = sums.select(*_PIECE, F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("offset"))
    run = Window.partitionBy(*_PIECE).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.withColumn("depth", F.sum("step").over(run)).join(offsets, _PIECE)
    # a closing has the depth of its opening
    placed = placed.select(*_PIECE, "key", F.struct("step", "name").alias("event"), (F.col("depth") + F.col("offset") + F.when(F.col("step") < 0, 1).otherwise(0)).alias("depth"))
    here = placed.withColumn("last", F.lag("event").over(Window.partitionBy(*_PIECE, "depth").orderBy("key")))
    ends = placed.groupBy(*_PIECE, "depth").agg(F.max_by("event", "key").alias("end"))
    carried = ends.select(*_PIECE, "depth", F.last("end").over(before("depth")).alias("carried"))
    linked = here.join(carried, [*_PIECE, "depth"]).withColumn("last", F.coalesce("last", "carried"))
    opens = F.col("event.step") > 0
    follows = F.coalesce((F.col("last.step") > 0) & (F.col("last.name") == F.col("event.name")), F.lit(False))
    bad = linked.where((F.col("depth") < 1) | ~F.when(opens, F.coalesce(F.col("last.step") < 0, F.lit(True))).otherwise(follows))
    first = bad.select("file", F.format_string("</%s> closes nothing or another structure", "event.name").alias("what")).first()
    first = first or sums.groupBy("file").agg(F.sum("n").alias("n")).where("n > 0").select("file", F.format_string("%d structures are left open", F.col("n").cast("long")).alias("what")).first()
    if first:
        raise ValueError(f"{first['file']}: {first['what']}")
