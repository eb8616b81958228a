"""SimHash near-duplicates by tiled exact comparison.

``fingerprints`` makes one 64-bit SimHash a text; ``links`` finds all pairs of different
fingerprints within the radius exactly:

- They are dealt into groups of about ``GROUP`` that agree in the low bits of a band (two
  within the radius agree in a band, by the pigeonhole principle), and within a group into
  cells of ``radius + 1`` neighbouring population counts.  A cell meets itself and the cell
  below; counts further apart differ beyond the radius and never meet.
- Within a cell, numpy exclusive-ors and counts bits tile by tile.  A differing bit changes
  the count of one of the four quarters by one, so pairs of tiles whose quarters' counts
  differ by more than the radius in all are skipped.
- A cell yields a spanning forest of its links, never all pairs, and
  :mod:`lexigram.llm.components` joins the forests.

Null or empty texts and texts without a word have fingerprint zero and link to each
other like any others; a null id is kept as a row of its own; repeated ids keep their
rows; an empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.llm import bytewords as bw
from lexigram.llm.common import cut, fresh, id_and_text, join_hot, slices, text_buffer
from lexigram.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints aimed at for a group, most of a cell that are compared together, and in a tile.
GROUP, CHUNK, BLOCK = 32768, 32768, 256
#: A lane of 16 bits counts this many shingles at least without overflow.
_LANE = 60000
_LOW16 = np.uint64(0x0001000100010001)


def _shingles(buf: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and how many each text has."""
    n_texts = len(at) - 1
    solid = bw.IS_WORD_BYTE[buf]
    start, end = bw.spans(solid, at)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    here = bw.counts(start, at)
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    place = np.cumsum(keep, dtype=np.int64)
    norm = bw.LOWER[buf[keep]]
    norm[~solid[keep]] = 0x20
    start, end = place[start] - 1, place[end - 1]
    first = np.cumsum(here) - here
    shingles = np.where(here > 0, np.maximum(here - words + 1, 1), 0)
    of = np.repeat(np.arange(n_texts), shingles)
    base = np.cumsum(shingles) - shingles
    lead = np.arange(len(of)) - base[of] + first[of]
    last = lead + np.minimum(words, here[of]) - 1
    return bw.xxh64(norm, start[lead], end[last] - start[lead], 42), shingles


def simhash(buf: np.ndarray, at: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text as uint64."""
    n_texts = len(at) - 1
    out = np.zeros(n_texts, np.uint64)
    h, shingles = _shingles(buf, at, words)
    if not len(h):
        return out
    base = np.cumsum(shingles) - shingles
    full = np.flatnonzero(shingles)
    cuts = np.concatenate([np.arange(b, b + k, _LANE) for b, k in zip(base[full].tolist(), shingles[full].tolist(), strict=True)])
    owner = np.searchsorted(base[full], cuts, "right") - 1
    owner_first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    half = shingles[full]
    for k in range(16):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LOW16, cuts)
        for lane in range(4):
            ones = np.add.reduceat(((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), owner_first)
            out[full] |= (2 * ones > half).astype(np.uint64) << np.uint64(k + 16 * lane)
    return out


def simhash_long(buf: np.ndarray, words: int = SHINGLE_WORDS) -> int:
    """The same fingerprint of one long text, in memory bounded by a piece of it."""
    ones, total = np.zeros(64, np.int64), 0
    cuts = bw.pieces(buf)
    for low, high in cuts:
        own = len(bw.spans(bw.IS_WORD_BYTE[buf[low:high]], np.array([0, high - low]))[0])
        more, end = high, len(buf)
        if high < end:  # the words that the last shingles of the piece reach into
            look = 4096
            while True:
                start, stop = bw.spans(bw.IS_WORD_BYTE[buf[high : high + look]], np.array([0, min(look, end - high)]))
                if len(start) > words or high + look >= end:
                    break
                look *= 4
            more = high + int(stop[min(words - 1, len(stop)) - 1]) if len(stop) else end
        h = _hashes(buf[low:more], words)
        if high < end:
            h = h[:own]
        elif low and own < words:
            h = h[:0]  # its shingles were the last piece's, which reached to the end
        total += len(h)
        for k in range(64):
            ones[k] += int(np.count_nonzero((h >> np.uint64(k)) & np.uint64(1)))
    return sum(1 << k for k in range(64) if 2 * int(ones[k]) > total)


def _hashes(buf: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all shingles of one text in order."""
    at = np.array([0, len(buf)])
    start, _ = bw.spans(bw.IS_WORD_BYTE[buf], at)
    return _shingles(buf, at, words)[0] if len(start) else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and its fingerprint ``fp`` (a signed 64-bit integer) for every row."""
    read = id_and_text(docs, id_col, text_col)
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            buf, at = text_buffer(part.column(1))
            fp = simhash(buf, at) if len(buf) <= bw.LONG else np.array([simhash_long(buf)], np.uint64)  # a long text comes alone
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return read.mapInArrow(run, f"doc_id {kind}, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of integers to (node, least node of its component)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return nodes, nodes[label]


def _tiles(fp: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Tiles of neighbouring quarters' bit counts, with the least and greatest counts of each."""
    quarters = np.stack([np.bitwise_count((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)], 1).astype(np.int16)
    halves = quarters[:, ::2] + quarters[:, 1::2]
    order = np.lexsort((quarters[:, 2], quarters[:, 0], halves[:, 1], halves[:, 0]))
    fp, bounds = fp[order], np.c_[quarters, halves][order]
    first = np.arange(0, len(fp), BLOCK)
    return [fp[i : i + BLOCK] for i in first], np.minimum.reduceat(bounds, first, 0), np.maximum.reduceat(bounds, first, 0)


def tile_pairs(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]:
    """Tiles of both sides, the pairs that population counts leave, and how many there are without them."""
    one = _tiles(left)
    two = one if right is None else _tiles(right)
    apart = np.maximum(np.maximum(one[1][:, None] - two[2][None], two[1][None] - one[2][:, None]), 0)
    whole = np.ones(apart.shape[:2], bool) if right is not None else np.triu(np.ones(apart.shape[:2], bool))
    near = whole & (apart[..., :4].sum(2) <= radius) & (apart[..., 4:].sum(2) <= radius)
    return one[0], two[0], np.argwhere(near), int(whole.sum())


def compare(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links between two chunks, or within one if right is None."""
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if not len(left) or right is not None and not len(right):
        return nothing
    one, two, pairs, _ = tile_pairs(left, right, radius)
    found = [nothing]
    for i, j in pairs.tolist():
        x, y = np.nonzero(np.bitwise_count(one[i][:, None] ^ two[j][None, :]) <= radius)
        found.append((one[i][x], two[j][y]))
        if sum(len(f[0]) for f in found) > 1 << 20:
            found = [_forest(*(np.concatenate(f) for f in zip(*found, strict=True)))]
    node, root = _forest(*(np.concatenate(f) for f in zip(*found, strict=True)))
    return node[node != root], root[node != root]


def _bands(radius: int, bits: int) -> list[tuple[int, int]]:
    """Shift and mask of the low ``bits`` bits of each of radius + 1 bands of a fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << min(bits, b - a)) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: Cells over a chunk that are broadcast; of more, the table is joined.
_BROADCAST_CELLS = 50_000


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Different fingerprints ``fp`` to edges ``(u, v)`` that connect all within the radius.

    Two fingerprints within the radius agree in one of radius + 1 bands at least, so they are
    compared exactly where they agree in the low bits of a band: as many bits as make groups
    of about ``group`` fingerprints, one at least and at most the whole band.  A fingerprint
    goes to two cells of radius + 1 groups.  A cell over ``chunk`` is cut into parts, every pair of which
    meets once.
    """
    n = prints.count()
    bits = max(1, round(math.log2(max(n, 1) / group)))
    bands = _bands(radius, bits)
    groups = F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)) + F.lit(i << 20) for i, (s, m) in enumerate(bands)])
    own = F.floor(F.bit_count("fp") / (radius + 1)).cast("long")
    # side 0 lives in the cell, side 1 comes from the one below
    at = F.explode(F.array(F.struct(own.alias("cell"), F.lit(0).alias("side")), F.struct((own + 1).alias("cell"), F.lit(1).alias("side"))))
    keyed = prints.select("fp", at.alias("at"), groups.alias("groups")).select("fp", F.explode("groups").alias("grp"), "at.*")
    keyed = keyed.select((F.col("grp") * 128 + F.col("cell")).alias("cell"), "side", "fp")
    # the few cells over a chunk, whatever the data
    large = cut(keyed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("n_parts")))
    n_large = large.count()
    if n_large:
        keyed = keyed.join(F.broadcast(large) if n_large <= _BROADCAST_CELLS else large, "cell", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
        mine, their = F.col("mine"), F.col("their")
        dealt = (
            keyed.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n_parts")).cast("int"))
            .select("cell", "side", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("their"))
            .select("cell", (F.least(mine, their).cast("long") * F.lit(1 << 31) + F.greatest(mine, their)).alias("parts"), (F.col("side") + 2 * (mine > their).cast("int")).alias("side"), "fp")
        )
    else:
        dealt = keyed.select("cell", F.lit(0).cast("long").alias("parts"), "side", "fp")

    def met(key: tuple, side: np.ndarray, fp: np.ndarray) -> list[tuple]:
        """Forests of a cell, or of two of its parts: side 0 with itself and with side 1, which met below."""
        at = [fp[side == k] for k in range(4)]
        if key[1] >> 31 == key[1] & (2**31 - 1):
            return [compare(at[0], None, radius), compare(at[0], at[1], radius)]
        return [compare(at[0], at[2], radius), compare(at[0], at[3], radius), compare(at[2], at[1], radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple | None, held: list) -> Iterator[pa.RecordBatch]:
            if key is not None:
                for u, v in met(key, *(np.concatenate(x) for x in zip(*held, strict=True))):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        key, held = None, []
        for batch in batches:
            cell, part, side, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(cell):
                continue
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)], strict=True):
                mine = (int(cell[i]), int(part[i]))
                if mine != key:
                    yield from done(key, held)
                    key, held = mine, []
                held.append((side[i:j].copy(), fp[i:j].astype(np.int64).view(np.uint64)))
        yield from done(key, held)

    return dealt.repartition("cell", "parts").sortWithinPartitions("cell", "parts").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least id that links of at most ``radius`` differing bits lead to.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")))
    n_rows = classes.agg(F.sum("rows")).first()[0] or 0
    roots = components(links(classes.select("fp"), radius, chunk))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", "rows", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    named = join_hot(rooted, least, "root", "members", n_rows).select("fp", "rows", "component_id")
    out = join_hot(prints, named, "fp", "rows", n_rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Keys that a broadcast holds at most.
_BROADCAST_KEYS = 200_000


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group, that of the least id, with all its columns.

    Rows without an id stay only where their group has no row with one.  Of rows that repeat
    id and text one stays.  Everything is decided on keys; while those to be left out are few
    enough to be broadcast, texts aren't shuffled.
    """
    no_id = F.col(id_col).isNull()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text by 128 bits, so that rows without an id are told apart
    key = F.struct(no_id.alias("no_id"), F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    name = fresh(docs, "row_key")
    classes = near_duplicates(docs.select(key.alias("id"), F.col(text_col).alias("text")), "id", "text", radius, chunk)
    keys = classes.groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    odd = cut(keys.where(~F.col("stays") | (F.col("n") > 1)).select(name, "stays"))
    n_odd, n_repeated = odd.agg(F.count("*"), F.count_if("stays")).first()
    held = lambda side, n: F.broadcast(side) if n <= _BROADCAST_KEYS else side
    rows = docs.withColumn(name, key)
    out = rows.join(held(odd.select(name), n_odd), name, "left_anti")
    if n_repeated:
        again = odd.where("stays").select(name)
        out = out.unionByName(rows.join(held(again, n_repeated), name, "left_semi").dropDuplicates([name]))
    return out.select(docs.columns)
