"""Counts of windows that shuffle blocks of windows instead of rows.

A task counts the windows of up to ``BLOCK`` tokens at a time as numbers, in numpy: tokens are
told apart once, and a window is a number made of its tokens' numbers.  What it has counted goes
on as one blob of bytes for each task of the next step, by a hash of the window's tokens, so the
shuffle sees a row a blob.  That task sums up the blobs it gets.  Nothing is left out, and the
memory of either task is bounded: the second ones are as many as the input has ``PART_BYTES``.
"""

from __future__ import annotations

import json
import struct
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.config import check_n

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package

#: Bytes of input whose windows one task sums up: of tables (Parquet), of files of tokens.
PART_BYTES, FILE_PART_BYTES = 4 << 20, 16 << 20
#: Windows that a task counts at a time, and rows that it hands on at a time.
BLOCK, ROWS = 1 << 20, 1 << 16
#: Sizes from here on are Spark's guess for what it can't size.
_UNKNOWN = 1 << 50
#: Texts that bounds of ranges come from, characters of each, and tokens of a window that a bound has at most (so that it is a number).
_SAMPLED, _SAMPLED_CHARS, _COMPARED = 2000, 1000, 3
_HEAD = "<qqqqq"
_DELIMITERS = np.isin(np.arange(256), list(b",.\t\n\f\r ;?!:"))
_FACTOR, _LOW = 0x9E3779B97F4A7C15, np.uint64(0xFFFFFFFF)


def _hashes(words: pa.Array) -> np.ndarray:
    """A number for each string, by its bytes alone."""
    if not len(words):
        return np.empty(0, "uint64")
    ends = pc.binary_length(words).to_numpy(zero_copy_only=False).astype("int64")
    starts = np.cumsum(ends) - ends
    first = np.frombuffer(words.buffers()[1], "int32")[words.offset]
    data = np.frombuffer(words.buffers()[2] or b"", "uint8")[first : first + int(ends.sum())]
    place = np.arange(len(data)) - np.repeat(starts, ends)
    powers = np.cumprod(np.full(int(ends.max()) + 1, 0x100000001B3, "uint64"), dtype="uint64")
    # sums of prefixes wrap around, and their differences are right all the same
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum((data.astype("uint64") + np.uint64(1)) * powers[place], dtype="uint64")])
    return _mixed(sums[starts + ends] - sums[starts])


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased plain texts, as ``functions.text.tokens`` cuts them, and how many each text has."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends = np.cumsum(size)
    first = np.frombuffer(texts.buffers()[1], "int32", 1, texts.offset * 4)[0] if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[first : first + int(size.sum())]
    inside = ~_DELIMITERS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = ends[:-1][size[1:] > 0]  # a text begins a token
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    # the bytes of tokens alone, and where among them each token begins
    offsets = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype("int32")
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return tokens, np.diff(np.searchsorted(starts, np.append(0, ends)))


def _labels(parts: int) -> np.ndarray:
    """Integers that Spark's hash partitioning deals to the partitions 0, 1, .. in turn: each blob's task is its own."""
    found, at = np.full(parts, -1, "int64"), 0
    while (found < 0).any():
        ids = np.arange(at, at + 16 * parts, dtype="int64")
        turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & _LOW
        k = turn((ids.astype("uint64") * np.uint64(0xCC9E2D51)) & _LOW, 15) * np.uint64(0x1B873593) & _LOW
        h = (turn(np.uint64(42) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _LOW ^ np.uint64(4)
        h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & _LOW
        h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & _LOW
        to = (h ^ (h >> np.uint64(16))).astype("uint32").view("int32").astype("int64") % parts
        new, first = np.unique(to, return_index=True)
        fresh = found[new] < 0
        found[new[fresh]] = ids[first[fresh]]
        at += 16 * parts
    return found.astype("int32")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTOR)
    return h ^ (h >> np.uint64(29))


def _grouped(codes: list[np.ndarray], size: int, count: np.ndarray | None, order: np.ndarray | None):
    """The different windows, how often each occurs, and where its first occurrence is."""
    if size ** len(codes) < 1 << 63:
        key = codes[0].astype("int64")
        for c in codes[1:]:
            key = key * size + c
        if count is None and order is None:
            key.sort()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, "int64")
            told, rest = [], key[starts]
            for _ in codes:
                rest, last = np.divmod(rest, size)
                told.insert(0, last)
            return told, np.diff(np.append(starts, len(key))), None
        by = np.argsort(key, kind="stable") if order is None else np.lexsort((order, key))
        keys = [key[by]]
    else:
        by = np.lexsort(([] if order is None else [order]) + codes[::-1])
        keys = [c[by] for c in codes]
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    first = by[starts]
    sums = np.diff(np.append(starts, len(by))) if count is None else np.add.reduceat(count[by], starts) if len(by) else count
    return [c[first] for c in codes], sums, first


def _blob(words: pa.Array, codes: np.ndarray, count: np.ndarray, order: np.ndarray | None, attr: np.ndarray | None, values: list[tuple] | None) -> bytes:
    """Windows ``codes`` (a row for each of their tokens) with words of their own."""
    used, codes = np.unique(codes, return_inverse=True)
    mine = words.take(pa.array(used))
    lengths = pc.binary_length(mine).to_numpy(zero_copy_only=False).astype("int32")
    parts = [lengths.tobytes(), (mine.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: int(lengths.sum())], codes.astype("uint16" if len(used) < 1 << 16 else "uint32").tobytes(), count.astype("int64").tobytes()]
    said = b""
    if order is not None:
        if values is not None:
            held, attr = np.unique(attr, return_inverse=True)
            said = json.dumps([values[i] for i in held.tolist()]).encode()
        parts += [order.astype("int64").tobytes(), attr.astype("int32").tobytes(), said]
    return struct.pack(_HEAD, len(count), len(used), len(parts[1]), order is not None, len(said)) + b"".join(parts)


def _unblob(blob: bytes, n: int):
    size, used, text, ordered, said = struct.unpack_from(_HEAD, blob)
    at = struct.calcsize(_HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    offsets = np.concatenate([[0], np.cumsum(take("int32", used))]).astype("int32")
    words = pa.StringArray.from_buffers(used, pa.py_buffer(offsets), pa.py_buffer(take("uint8", text)))
    codes = take("uint16" if used < 1 << 16 else "uint32", n * size).reshape(n, size)
    count, order, attr = take("int64", size), None, None
    if ordered:
        order, attr = take("int64", size), take("int32", size)
    return words, codes, count, order, attr, json.loads(blob[at : at + said]) if said else []


def _parts(rows: DataFrame, files: bool) -> int:
    """Tasks by the size of what is read, whichever columns of it are used; as usual where Spark doesn't know it."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size, least = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // (FILE_PART_BYTES if files else PART_BYTES))) if size < _UNKNOWN else least


def bounds_of(rows: DataFrame, n: int, parts: int) -> list[tuple[bytes, ...]]:
    """First tokens of windows that part all windows into ``parts`` ranges of about a size, from the beginnings of a bounded number of plain texts (those of the least hashes)."""
    texts = rows.select(F.substring("tok", 1, _SAMPLED_CHARS).alias("tok")).orderBy(F.xxhash64("tok"), "tok").limit(_SAMPLED).collect()
    tokens, size = _cut(pa.array([r["tok"] for r in texts], pa.string()))
    found, held = set(), iter(tokens.cast(pa.binary()).to_pylist())
    for k in size.tolist():
        text = [next(held) for _ in range(k)]
        found.update(zip(*[text[i:] for i in range(min(n, _COMPARED))], strict=False))
    ordered = sorted(found)
    return sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []


def _ranges(bounds: list[tuple[bytes, ...]]) -> tuple[list[bytes], np.ndarray]:
    """All words of the bounds in order, and the bounds as numbers (see ``_range``)."""
    known = sorted({w for b in bounds for w in b})
    place = {w: 2 * i + 1 for i, w in enumerate(known)}
    keys = np.zeros(len(bounds), "int64")
    for i in range(len(bounds[0]) if bounds else 0):
        keys = keys * (2 * len(known) + 2) + np.array([place[b[i]] for b in bounds], "int64")
    return known, keys


def _places(words: pa.Array, known: list[bytes]) -> np.ndarray:
    """Odd for a word of the bounds, even between two of them."""
    odd = set(known)
    return np.fromiter((2 * bisect_left(known, w) + (w in odd) for w in words.cast(pa.binary()).to_pylist()), "int64", len(words))


def count_blocks(rows: DataFrame, n: int, min_freq: int = 0, attrs: list[str] | None = None, order: str | None = None, stop: list[str] | None = None, prefixes: list[str] | None = None, along: bool = False, parts: int | None = None, ranges: bool = False) -> DataFrame:
    """``t1..tn, count, attributes`` of the windows in rows with an array ``tok``, or a lower-cased plain text, as ``count_windows`` of ``array_windows`` has them.

    ``order`` names an integer column; attributes are those of the row of least order that a
    window occurs in.  With ``along``, rows are packed ones: ``order`` is the place of the row's
    first token, and an attribute is an array that lies along the tokens, of which the window's
    last token counts.  With ``ranges``, plain texts' windows are dealt by ranges of their tokens
    and not by hash, and come in their order.
    """
    check_n(n)
    attrs, stop, prefixes = attrs or [], stop or [], prefixes or []
    if attrs and not order:
        raise ValueError("attributes need an order of occurrences")
    parts = parts or _parts(rows, along)
    bounds = bounds_of(rows, n, parts) if ranges else []
    parts = len(bounds) + 1 if ranges else parts
    labels, (known, limits) = _labels(parts), _ranges(bounds)
    names = [f"t{i}" for i in range(1, n + 1)]
    cut = dict(rows.dtypes)["tok"] == "string"
    number = len(attrs) == 1 and along and dict(rows.dtypes)[attrs[0]] == "array<int>"

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cut:
            flat, size = _cut(pa.concat_arrays([b.column("tok") for b in held]))
        else:
            flat = pa.concat_arrays([b.column("tok").flatten() for b in held])
            size = np.concatenate([pc.fill_null(pc.list_value_length(b.column("tok")), 0).to_numpy(zero_copy_only=False) for b in held]).astype("int64")
        told = flat.dictionary_encode()
        words, codes = told.dictionary, pc.fill_null(told.indices, -1).to_numpy(zero_copy_only=False)
        wrong = pc.is_in(words, value_set=pa.array(["", *stop], pa.string())).to_numpy(zero_copy_only=False)
        codes = np.where(np.append(wrong, True)[codes], np.int32(-1), codes)
        begins = np.append(np.zeros(len(words), bool) if prefixes else np.ones(len(words), bool), False)
        for p in prefixes:
            begins[:-1] |= pc.starts_with(words, p).to_numpy(zero_copy_only=False)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        at = attr = values = None
        if attrs:
            ats = np.concatenate([b.column(order).cast(pa.int64()).fill_null(np.iinfo("int64").max).to_numpy(zero_copy_only=False) for b in held])
            at = np.repeat(ats, size)
            if along:
                at = at + np.repeat(size, size) - left
            columns = [pa.concat_arrays([b.column(a).flatten() if along else b.column(a) for b in held]) for a in attrs]
            if number:
                attr = columns[0].to_numpy(zero_copy_only=False)
            else:
                seen: dict[tuple, int] = {}
                # a row whose order is null has no say
                lists = [c.to_pylist() for c in columns]
                attr = np.fromiter((seen.setdefault(v, len(seen)) for v in zip(*lists, strict=True)), "int32", len(columns[0]))
                values = list(seen)
                if not along:
                    none = seen.setdefault((None,) * len(attrs), len(seen))
                    values = list(seen)
                    attr = np.repeat(np.where(ats == np.iinfo("int64").max, np.int32(none), attr), size)
        hashes, codes = _places(words, known) if ranges else _hashes(words), np.append(codes, np.full(n, -1, "int32"))
        for lo in range(0, len(flat), BLOCK):
            hi = min(lo + BLOCK, len(flat))
            valid = (left[lo:hi] >= n) & begins[codes[lo:hi]]
            for i in range(n):
                valid &= codes[lo + i : hi + i] >= 0
            idx = np.flatnonzero(valid) + lo
            here, count, first = _grouped([codes[idx + i] for i in range(n)], len(words), None, None if at is None else at[idx])
            if not len(count):
                continue
            if ranges:
                h = np.zeros(len(count), "int64")
                for c in here[:_COMPARED]:
                    h = h * (2 * len(known) + 2) + hashes[c]
                part = np.searchsorted(limits, h, side="right").astype("int32")
            else:
                h = np.zeros(len(count), "uint64")
                for c in here:
                    h = h * np.uint64(_FACTOR) + hashes[c]
                part = ((_mixed(h) >> np.uint64(32)) % np.uint64(parts)).astype("int32")
            by = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts))
            table, count = np.stack(here)[:, by], count[by]
            orders = at[idx[first]][by] if attrs else None
            carried = attr[idx[first] + (n - 1 if along else 0)][by] if attrs else None
            filled = np.flatnonzero(np.diff(np.append(0, ends)))
            for some in range(0, len(filled), 256):
                batch = filled[some : some + 256].tolist()
                blobs = []
                for p in batch:
                    s = slice(int(ends[p - 1]) if p else 0, int(ends[p]))
                    blobs.append(_blob(words, table[:, s], count[s], orders[s] if attrs else None, carried[s] if attrs else None, values))
                yield pa.RecordBatch.from_arrays([pa.array(labels[batch]), pa.array(blobs, pa.binary())], ["__p", "__blob"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("tok").nbytes // 8 if cut else len(b.column("tok").flatten())
            if size >= BLOCK:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unblob(blob, n) for b in batches for blob in b.column("__blob").to_pylist()]
        if not got:
            return
        told = pa.concat_arrays([g[0] for g in got]).dictionary_encode()
        words, global_code = told.dictionary, told.indices.to_numpy(zero_copy_only=False)
        if ranges:  # numbers of words follow their bytes, and so windows come in order
            by = pc.sort_indices(words.cast(pa.binary()))
            place = np.empty(len(words), "int64")
            place[by.to_numpy()] = np.arange(len(words))
            words, global_code = words.take(by), place[global_code]
        bases = np.cumsum([0, *[len(g[0]) for g in got]])
        codes = [np.concatenate([global_code[g[1][i].astype("int64") + base] for g, base in zip(got, bases, strict=False)]) for i in range(n)]
        count = np.concatenate([g[2] for g in got])
        orders = np.concatenate([g[3] for g in got]) if attrs else None
        here, count, first = _grouped(codes, len(words), count, orders)
        values, attr = [], None
        if attrs:
            if number:
                attr = np.concatenate([g[4] for g in got])
            else:
                places: dict[tuple, int] = {}
                maps = [np.array([places.setdefault(tuple(v), len(places)) for v in g[5]], "int32") for g in got]
                attr, values = np.concatenate([m[g[4]] for m, g in zip(maps, got, strict=True)]), list(places)
            attr = attr[first]
        if min_freq > 1:
            kept = count >= min_freq
            here, count, attr = [c[kept] for c in here], count[kept], attr[kept] if attrs else None
        columns = [pa.array([v[i] for v in values], pa.string()) for i in range(len(attrs))] if attrs and not number else []
        for lo in range(0, len(count), ROWS):
            s = slice(lo, lo + ROWS)
            more = [pa.array(attr[s], pa.int32())] if number else [c.take(pa.array(attr[s])) for c in columns]
            yield pa.RecordBatch.from_arrays([*[words.take(pa.array(c[s])) for c in here], pa.array(count[s], pa.int64()), *more], [*names, "count", *attrs])

    needed = rows.select("tok", *([order] if attrs else []), *attrs)
    blobs = needed.mapInArrow(partial, "__p int, __blob binary").repartition(parts, "__p")
    schema = ", ".join([*[f"{t} string" for t in names], "count long", *[f"`{a}` {'int' if number else 'string'}" for a in attrs]])
    return blobs.mapInArrow(final, schema)
