"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of plain words (runs of letters and digits, lower case, other
characters part them; a character of a script without spaces, such as Han, kana or Thai, is a
word of its own).  A document is contaminated by an item of m words if some stretch of
it lies within floor(m / 5) word edits of the item (similarity 0.8).

- Parts: an item is cut into parts of about ``PART`` words (shorter ones stay whole).  Of the
  parts of an item within its limit one at least is within its own, so parts are sought; each
  that is found leads to its item.
- Windows: by the pigeonhole principle a stretch within a part's limit holds three of its
  words in a row (two for parts under ten words), so windows of the part's size start only
  where such words stand, moved by every offset the edits allow.  This loses nothing.
- The CGK random walk (Chakraborty, Goldenberg, Koucky 2016) reads a window while writing
  3m symbols: it writes the current word, then goes on or stays as a random function of step
  and word says.  Few edits give few differing symbols.
- Each of ``tables`` hash tables samples a few symbols of one of the walks.  How many tables
  the parts of a size need is measured: they are edited at random up to the limit, by each
  kind of edit alone and all mixed, and tables added until ``recall`` of every kind are found.
  An item of several parts is found more often, as edits seldom lie evenly.
- Sizes that ``MOST_TABLES`` don't bring there are sought without tables: d edits spoil at
  most d q of a part's rows of q words, and the rest stand in the text moved by offsets that
  differ by d at most.  Where so many are left, the item is verified; this loses nothing.
- Candidates are verified by the exact edit distance of the part to the words around the
  window, many at once, and of those left the item's to any stretch nearby.

Items are searched in blocks of bounded size, each against all documents.  Items under five
words allow no edit and are sought as they are; only those under ``least_words`` words are left
out, by default those without any.  Null or empty texts match nothing; a null id is a row like others; repeated rows match each; an empty
table on either side gives no match.  Other columns pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.llm import bytewords as bw
from lexigram.llm.common import slices, text_buffer

LEAST_WORDS = 1
RECALL = 0.98
#: Symbols that a table samples; walks; most tables.
SAMPLED, WALKS, MOST_TABLES = 3, 8, 96
#: Steps of a walk that are sampled, in sizes of its window; after two it is at the end, on average, and says nothing more.
REACH = 1.75
#: Words of a part at least, where an item has two or more; edits of each kind that measure a size.
PART, TRIALS = 10, 240
EDITS = ("replace", "insert", "delete", "mixed")
#: Words of the items in a block, windows embedded and candidates verified at once.
BLOCK_WORDS, WINDOWS, CANDIDATES = 1 << 20, 1 << 17, 1 << 14
#: Meetings of words in texts and in items that are held at once.
MEETINGS = 1 << 22
_U = np.uint64
_SEED = 0x5DEECE66D


def word_hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of all texts, and where each text's begin (one more than texts)."""
    if len(at) == 2 and len(cuts := bw.pieces_if_long(buf, unspaced=True)) > 1:
        words = np.concatenate([word_hashes(buf[a:b], np.array([0, b - a]))[0] for a, b in cuts])
        return words, np.array([0, len(words)])
    low = bw.folded(buf)
    start, end = bw.plain_spans(buf, at)
    return bw.hashes(low, start, end), np.searchsorted(start, at)


def limit(m: int) -> int:
    return m // 5


def _grams(words: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(words) - q + 1)
    key = np.full(n, q, np.uint64)
    for i in range(q):
        key = bw.mix(key * _U(0x9E3779B97F4A7C15) + words[i : i + n])
    return key


class Lookup:
    """Keys to values, many to many; a bitmap turns most other keys away."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> _U(44)).astype(np.int64)] = True

    def _maybe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.bits[(keys >> _U(44)).astype(np.int64)])
        low, high = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        return maybe, low, high - low

    def meetings(self, keys: np.ndarray) -> int:
        return int(self._maybe(keys)[2].sum())

    def find(self, keys: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index into ``keys`` and value of every meeting, about ``most`` (and a key's) at a time."""
        maybe, low, n = self._maybe(keys)
        upto = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - n[first] + (most or MEETINGS), "right")))
            size = n[first:last]
            at = np.repeat(low[first:last] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield np.repeat(maybe[first:last], size), self.values[at]
            first = last


def embed(words: np.ndarray, start: np.ndarray, stop: np.ndarray, m: int, tables: int) -> np.ndarray:
    """Table keys (windows x tables) of windows of size m; reading past ``stop`` gives padding."""
    rng = np.random.Generator(np.random.PCG64(_SEED + m))
    walks = np.arange(MOST_TABLES) % WALKS
    samples = rng.integers(0, max(1, int(REACH * m)), (MOST_TABLES, SAMPLED))[:tables]
    steps = rng.integers(0, 2**63, (WALKS, 3 * m), dtype=np.uint64)
    used = min(WALKS, tables)
    wanted: dict[int, list[int]] = {}
    for t in range(tables):
        for s in samples[t]:
            wanted.setdefault(int(s), []).append(t)
    keys = np.repeat((np.arange(tables, dtype=np.uint64) + _U(m * 1000))[None, :], len(start), 0)
    pos = np.repeat(start[:, None], used, 1)
    stop = stop[:, None]
    padded = np.r_[words, _U(0)]
    last = max(wanted) if wanted else -1
    for step in range(last + 1):
        over = pos >= stop
        sym = padded[np.where(over, len(words), pos)]
        for t in wanted.get(step, ()):
            keys[:, t] = bw.mix(keys[:, t] * _U(0x9E3779B97F4A7C15) + sym[:, walks[t]])
        move = bw.mix(sym ^ steps[:used, step][None, :]) & _U(1)
        pos = np.where(over, pos, pos + move.astype(np.int64))
    return keys


def distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of the item to a stretch of the text that ends at 0, 1, ... len(text)."""
    n = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - n) + n
    return row


def _near(parts: np.ndarray, words: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the parts (rows of equal sizes) are within their limit of a stretch at ``start``, in texts from low to high; all at once."""
    m = parts.shape[1]
    d = limit(m)
    place = start[:, None] + np.arange(-2 * d, m + 2 * d)
    text = np.where((place >= low[:, None]) & (place < high[:, None]), words[np.clip(place, 0, max(len(words) - 1, 0))], _U(0))
    n = np.arange(text.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(parts), len(n)), np.int16)
    for i in range(m):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (text != parts[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - n, axis=1) + n
    return row.min(1) <= d


def _edited(item: np.ndarray, kind: int, rng: np.random.Generator) -> np.ndarray:
    """The item with as many random edits of a kind as the limit allows."""
    words, n = item.tolist(), limit(len(item))
    kinds = rng.integers(0, 3, n) if EDITS[kind] == "mixed" else np.full(n, kind)
    for k, part, new in zip(kinds.tolist(), rng.random(n).tolist(), rng.integers(0, 2**63, n).tolist(), strict=True):
        at = int(part * len(words))
        words[at : at + (EDITS[k] != "insert")] = [] if EDITS[k] == "delete" else [new]
    return np.array(words, np.uint64)


class Block:
    """A bounded block of items, ready to be sought in texts."""

    def __init__(self, ids: list, words: list[np.ndarray], recall: float = RECALL):
        self.ids, self.items = ids, words
        cut = [np.linspace(0, len(w), max(1, len(w) // PART) + 1).astype(np.int64) for w in words]
        self.item = np.repeat(np.arange(len(words)), [len(c) - 1 for c in cut])
        self.offset = np.concatenate([c[:-1] for c in cut]) if words else np.zeros(0, np.int64)
        self.size = np.concatenate([np.diff(c) for c in cut]) if words else np.zeros(0, np.int64)
        self.parts = [words[i][o : o + n] for i, o, n in zip(self.item.tolist(), self.offset.tolist(), self.size.tolist(), strict=True)]
        self.grams = {}
        for q in (1, 2, 3):
            mine = [i for i, w in enumerate(self.parts) if len(w) and (1 if len(w) == 1 else 2 if len(w) < 10 else 3) == q]
            if mine:
                keys = [_grams(self.parts[i], q) for i in mine]
                values = [(np.full(len(k), i, np.int64) << 32) + np.arange(len(k)) for i, k in zip(mine, keys, strict=True)]
                self.grams[q] = Lookup(np.concatenate(keys), np.concatenate(values))
        #: Tables for each size of parts; 0 where they are sought by counted grams.
        self.tables = {}
        keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for m, mine, flat, start in self._by_size():
            n = self.tables[m] = self._needed(m, mine, recall)
            if n:
                keys.append(embed(flat, start, start + m, m, n).ravel())
                values.append(np.repeat(mine, n))
        self.lookup = Lookup(np.concatenate(keys), np.concatenate(values))
        self.counted = np.array([not self.tables[m] for m in self.size.tolist()], bool)

    def _by_size(self) -> Iterator[tuple]:
        for m in np.unique(self.size).tolist():
            mine = np.flatnonzero(self.size == m)
            yield m, mine, np.concatenate([self.parts[i] for i in mine]), np.arange(len(mine)) * m

    def _needed(self, m: int, mine: np.ndarray, recall: float) -> int:
        """Tables that find ``recall`` of parts of size m edited up to the limit, by each kind of edit; 0 if too many."""
        if not limit(m):
            return 0
        rng = np.random.Generator(np.random.PCG64(7 + m))
        some = rng.permutation(mine)[:40]
        whole = embed(np.concatenate([self.parts[i] for i in some]), np.arange(len(some)) * m, np.arange(1, len(some) + 1) * m, m, MOST_TABLES)
        which = np.resize(np.arange(len(some)), max(TRIALS, len(some)))
        most = 0
        for kind in range(len(EDITS)):
            edited = [_edited(self.parts[some[k]], kind, rng) for k in which]
            size = np.array([len(w) for w in edited])
            start = np.cumsum(size) - size
            hit = embed(np.concatenate(edited), start, start + np.minimum(size, m), m, MOST_TABLES) == whole[which]
            first = np.sort(np.where(hit.any(1), hit.argmax(1), MOST_TABLES))
            most = max(most, int(first[int(np.ceil(recall * len(first))) - 1]) + 1)
        return most if most <= MOST_TABLES else 0

    def _hits(self, words: np.ndarray, at: np.ndarray, some: tuple[int, int]) -> Iterator[tuple]:
        """Text, part and the part's start (by the place in it) of all rows of q words of some parts."""
        text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for q, lookup in self.grams.items():
            found = []
            for where, value in lookup.find(_grams(words, q)):
                inside = text_of[where] == text_of[where + q - 1]
                inside &= (value >> 32 >= some[0]) & (value >> 32 < some[1])
                where, value = where[inside], value[inside]
                found.append((text_of[where], value >> 32, where - (value & 0xFFFFFFFF)))
            if sum(len(f[0]) for f in found):
                yield q, *(np.concatenate(f) for f in zip(*found, strict=True))

    def _rounds(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of parts that are sought one after another, so that the meetings of each are bounded."""
        n = sum(lookup.meetings(_grams(words, q)) for q, lookup in self.grams.items())
        rounds = min(len(self.parts), -(-n // MEETINGS)) or 1
        ends = [len(self.parts) * i // rounds for i in range(rounds + 1)]
        return list(zip(ends[:-1], ends[1:], strict=True))

    def _windows(self, hits: list[tuple], at: np.ndarray) -> Iterator[tuple]:
        """Size of parts and different window starts that the pigeonhole principle leaves."""
        if not hits:
            return
        text, part, first = (np.concatenate(h) for h in list(zip(*hits, strict=True))[1:])
        size = np.where(self.counted[part], 0, self.size[part])
        order = np.argsort(size, kind="stable")
        text, first, size = text[order], first[order], size[order]
        for m in np.unique(size[size > 0]).tolist():
            mine = slice(*np.searchsorted(size, (m, m + 1)))
            low = np.maximum(first[mine] - limit(m), at[text[mine]])
            high = np.maximum(np.minimum(first[mine] + limit(m) + 1, at[text[mine] + 1]), low)
            open_ = np.bincount(low, minlength=at[-1] + 1) - np.bincount(high, minlength=at[-1] + 1)
            starts = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
            of = np.searchsorted(at, starts, "right") - 1
            stop = np.minimum(starts + m, at[of + 1])
            for i in range(0, len(starts), WINDOWS):
                yield m, starts[i : i + WINDOWS], stop[i : i + WINDOWS], of[i : i + WINDOWS]

    def _enough(self, hits: list[tuple]) -> Iterator[tuple]:
        """Text, part and starts where as many of its grams lie close by as the edits must leave."""
        for q, text, part, first in hits:
            mine = self.counted[part]
            text, part, first = text[mine], part[mine], first[mine]
            if not len(first):
                continue
            order = np.lexsort((first, part, text))
            text, part, first = text[order], part[order], first[order]
            m = self.size[part]
            d = m // 5
            group = np.cumsum(np.r_[0, (np.diff(text) != 0) | (np.diff(part) != 0)])
            place = group * (int(first.max() - first.min()) + int(d.max()) + 1) + first - first.min()
            end = np.searchsorted(place, place + d, "right")
            enough = end - np.arange(len(place)) >= m - q + 1 - d * q
            change = np.zeros(len(place) + 1, np.int64)
            np.add.at(change, np.flatnonzero(enough), 1)
            np.add.at(change, end[enough], -1)
            kept = np.cumsum(change[:-1]) > 0
            yield text[kept], part[kept], first[kept]

    def matches(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of the best stretch for each text and item."""
        found: dict[tuple[int, int], list[int]] = {}
        for some in self._rounds(words):
            hits = list(self._hits(words, at, some))
            near = list(self._enough(hits))
            for m, start, stop, text in self._windows(hits, at):
                n = self.tables[m]
                for where, part in self.lookup.find(embed(words, start, stop, m, n).ravel()):
                    window, part = np.unique(np.stack((where // n, part)), axis=1)
                    for i in range(0, len(part), CANDIDATES):
                        w, p = window[i : i + CANDIDATES], part[i : i + CANDIDATES]
                        good = _near(np.stack([self.parts[k] for k in p]), words, start[w], at[text[w]], at[text[w] + 1])
                        near.append((text[w][good], p[good], start[w][good]))
            for text, part, start in near:
                for pair in np.unique(np.stack((text, self.item[part], start - self.offset[part])), axis=1).T.tolist():
                    found.setdefault((pair[0], pair[1]), []).append(pair[2])
        found = {pair: sorted(set(starts)) for pair, starts in found.items()}
        out = []
        for (text, item), starts in found.items():
            words_i, m = self.items[item], len(self.items[item])
            d, low, high = limit(m), int(at[text]), int(at[text + 1])
            best = None
            a, b = None, None
            stretches = []
            for s in starts:
                x, y = max(low, s - 2 * d), min(high, s + m + 2 * d)
                if b is not None and x <= b:
                    b = y
                else:
                    if b is not None:
                        stretches.append((a, b))
                    a, b = x, y
            stretches.append((a, b))
            for a, b in stretches:
                if best is not None and not best[0]:
                    break
                row = distances(words_i, words[a:b])
                k = int(np.argmin(row))
                if row[k] <= d and (best is None or row[k] < best[0]):
                    back = distances(words_i[::-1], words[max(a, a + k - m - d) : a + k][::-1])
                    best = (int(row[k]), a + k - int(np.flatnonzero(back == row[k])[0]) - low, a + k - low)
            if best is not None:
                out.append((text, item, *best))
        return sorted(out)


def blocks(items: DataFrame, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The items in blocks of about ``block_words`` words, read one partition at a time."""
    ids, words, n = [], [], 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        mine = word_hashes(*text_buffer(pa.array([r[1]])))[0]
        if len(mine) < least_words:
            continue
        if n and n + len(mine) > block_words:
            yield Block(ids, words)
            ids, words, n = [], [], 0
        ids.append(r[0])
        words.append(mine)
        n += len(mine)
    if ids:
        yield Block(ids, words)


def _matches(docs: DataFrame, block: Block, item_type: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_words
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.int64() if item_type == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for part in slices(batches, limit=1 << 21):
            got = block.matches(*word_hashes(*text_buffer(part.column(1))))
            if got:
                text, which, dist, first, end = zip(*got, strict=True)
                arrays = [part.column(0).take(pa.array(text)), pa.array([block.ids[i] for i in which], item), *[pa.array(x, pa.int32()) for x in (dist, first, end)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "first_word", "end_word"])

    return docs.mapInArrow(run, f"doc_id {kind}, item_id {item_type}, distance int, first_word int, end_word int")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, first_word, end_word``: the best stretch for each document and item."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    item_type = items.schema[item_id_col].dataType.simpleString()
    out = None
    for block in blocks(items, block_words=block_words, id_col=item_id_col, text_col=item_text_col):
        got = _matches(read, block, item_type)
        out = got if out is None else out.union(got)
    if out is None:
        kind = read.schema["doc_id"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_type}, distance int, first_word int, end_word int")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; no shuffle."""
    names, at = docs.columns, docs.columns.index(text_col)
    for block in blocks(items, block_words=block_words, id_col=item_id_col, text_col=item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for part in slices(batches, text=at, limit=1 << 21):
                bad = {m[0] for m in block.matches(*word_hashes(*text_buffer(part.column(at))))}
                clean = part.take(pa.array([i for i in range(part.num_rows) if i not in bad], pa.int64())) if bad else part
                yield pa.RecordBatch.from_arrays(clean.columns, names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
