"""Sampled segmentations by forward filtering and backward sampling over a piece lattice.

The pieces come from a SentencePiece model file.  A piece's weight is
``-theta * log(rank + 10)`` by its rank in the file's scores (Zipf's law; the file of a BPE
model has ranks, not probabilities), so a larger ``theta`` prefers fewer, commoner pieces.

- Lattice: nodes are byte positions, edges are pieces (a space stands for the file's word
  mark) and, where a character is no piece, its single bytes.  No piece crosses the start of
  a run of spaces or a line feed, so the lattice of a text falls into independent units
  there, and equal units share theirs.  Units over ``UNIT_BYTES`` fall apart further, at all
  characters that no edge crosses; one without such a place stays whole, however long.
- Forward filtering sums the weights of all segmentations up to each node, in logarithms.
- Backward sampling walks from a unit's end, choosing an incoming edge with its posterior
  probability.  The random numbers are hashes of the row's key, the unit's number in the
  text and the step, so a row's segmentation depends on nothing else: not on partitions,
  other rows or retries.

All units of a batch advance together in numpy.  Decoding concatenates the pieces' bytes and
is lossless for every text: spaces are kept as they are, and the word mark itself, where a
text has it, is spelt in bytes.

Null texts count as empty and have no ids; a null id has a key of its own; repeated rows get
equal segmentations; an empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.llm import bytewords as bw
from lexigram.llm.common import id_and_text, slices, text_buffer

THETA = 1.0
UNIT_BYTES = 4096
#: Units whose lattices are built together; their numbers fit 16 bits.
UNITS = 1 << 15
SLICE = 1 << 20
_MARK = "▁"
_U = np.uint64


class Pieces:
    """Pieces of a model file as a trie over classes of bytes."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable, byte_ids = [], {}
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                name = sp.id_to_piece(i)
                raw = name.replace(_MARK, " ").encode()
                if name.strip(_MARK) and (_MARK in name.lstrip(_MARK) or "\n" in name):
                    raise ValueError(f"piece {name!r} crosses a unit")
                usable.append((sp.get_score(i), i, raw))
        if len(byte_ids) != 256:
            raise ValueError("the model has no pieces for single bytes")
        usable.sort(key=lambda p: (-p[0], p[1]))
        self.weight = np.full(n, -np.inf)
        self.bytes_of: list[bytes] = [b""] * n
        for rank, (_, i, raw) in enumerate(usable):
            self.weight[i] = -theta * np.log(rank + 10.0)
            self.bytes_of[i] = raw
        self.byte_id = np.array([byte_ids[b] for b in range(256)], np.int32)
        for b, i in byte_ids.items():
            self.weight[i] = -theta * np.log(n + 10.0)
            self.bytes_of[i] = bytes([b])
        self.size = np.array(list(map(len, self.bytes_of)), np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.cumsum(self.size) - self.size
        self._trie([(i, raw) for _, i, raw in usable])

    def _trie(self, pieces: list[tuple[int, bytes]]) -> None:
        used = sorted({b for _, raw in pieces for b in raw})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for i, raw in pieces:
            at = 1
            for b in raw:
                at = nodes.setdefault((at, b), len(nodes) + 2)
            ends[at] = i
        self.next = np.zeros((len(nodes) + 2, width), np.int32)
        for (at, b), to in nodes.items():
            self.next[at, self.kind[b]] = to
        self.next = self.next.ravel()
        self.width = width
        self.piece = np.full(len(nodes) + 2, -1, np.int32)
        for at, i in ends.items():
            self.piece[at] = i


class Lattices:
    """Lattices of many different units, filtered forward and ready to be sampled."""

    def __init__(self, pieces: Pieces, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.base = np.cumsum(size + 1) - (size + 1)  # a unit of n bytes has n + 1 nodes
        total = int((size + 1).sum())
        unit = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        byte = buf[start[unit] + within]
        lead = (byte & 0xC0) != 0x80

        # edges: walk the trie from the first byte of every character at once
        alive = np.flatnonzero(lead)
        room = (size[unit] - within)[alive]
        state = np.ones(len(alive), np.int64)
        kinds = pieces.kind[byte]
        froms, lens, ids = [], [], []
        single = np.zeros(len(byte), bool)  # characters that are pieces
        chars = np.ones(len(byte), np.int64)
        chars[byte >= 0xC0] = 2
        chars[byte >= 0xE0] = 3
        chars[byte >= 0xF0] = 4
        depth = 0
        while len(alive):
            state = pieces.next[state * pieces.width + kinds[alive + depth]].astype(np.int64)
            go = state > 0
            alive, state, room = alive[go], state[go], room[go]
            depth += 1
            got = pieces.piece[state]
            hit = got >= 0
            at = alive[hit]
            froms.append(at)
            lens.append(np.full(len(at), depth, np.int64))
            ids.append(got[hit])
            single[at[chars[at] == depth]] = True
            go = room > depth
            alive, state, room = alive[go], state[go], room[go]
        owner = np.maximum.accumulate(np.where(lead, np.arange(len(byte)), 0))
        spelt = np.flatnonzero(~single[owner])
        froms.append(spelt)
        lens.append(np.ones(len(spelt), np.int64))
        ids.append(pieces.byte_id[byte[spelt]])
        pos, size_of, piece = np.concatenate(froms), np.concatenate(lens), np.concatenate(ids)
        of = unit[pos]
        to = within[pos] + size_of
        # by end position, then unit: two stable passes over 16-bit keys, wider ones where a unit is longer
        order = np.argsort(of.astype(np.uint16), kind="stable")
        ends = to[order]
        order = order[np.argsort(ends.astype(np.uint16) if len(size) and size.max() < 1 << 16 else ends, kind="stable")]
        of, to, size_of, piece = of[order], to[order], size_of[order], piece[order]
        target = self.base[of] + to
        source = target - size_of

        weight = pieces.weight[piece]
        score = np.full(total, -np.inf)
        score[self.base] = 0.0
        logp = np.empty(len(piece))
        new = np.r_[True, target[1:] != target[:-1]] if len(target) else np.zeros(0, bool)
        group = np.flatnonzero(new)
        step_group = np.searchsorted(to[group], np.arange(1, (int(to[-1]) if len(to) else 0) + 2))
        bounds = np.r_[group, len(piece)]
        for a, b in zip(step_group[:-1].tolist(), step_group[1:].tolist(), strict=True):
            if a == b:
                continue
            low, high = bounds[a], bounds[b]
            x = score[source[low:high]] + weight[low:high]
            local = bounds[a:b] - low
            top = np.maximum.reduceat(x, local)
            top = np.where(np.isfinite(top), top, 0.0)
            count = np.diff(np.r_[local, high - low])
            with np.errstate(divide="ignore"):
                whole = np.log(np.add.reduceat(np.exp(x - np.repeat(top, count)), local)) + top
            score[target[bounds[a:b]]] = whole
            with np.errstate(invalid="ignore"):
                logp[low:high] = np.exp(x - np.repeat(whole, count))
        self.score, self.source, self.piece = score, source, piece
        # cumulative probabilities among the edges into one node
        logp = np.nan_to_num(logp)
        run = np.cumsum(logp)
        before = np.repeat(run[group] - logp[group], np.diff(bounds)) if len(group) else run
        self.upto = run - before
        self.edges = np.zeros(total, np.int64)
        self.last = np.full(total, -1, np.int64)
        self.edges[target[group]] = group
        self.last[target[group]] = bounds[1:] - 1
        self.final = self.base + size

    def sample(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a segmentation for each wanted unit, one after another, and their numbers."""
        node = self.final[unit].copy()
        begin = self.base[unit]
        active = np.flatnonzero(node > begin)
        found_of, found = [], []
        step = 0
        while len(active):
            here = node[active]
            u = (bw.mix(seed[active] + _U((step * 0x9E3779B97F4A7C15) % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53
            edge, last = self.edges[here], self.last[here]
            u *= self.upto[last]
            open_ = np.flatnonzero((u >= self.upto[edge]) & (edge < last))
            while len(open_):
                edge[open_] += 1
                open_ = open_[(u[open_] >= self.upto[edge[open_]]) & (edge[open_] < last[open_])]
            found_of.append(active)
            found.append(self.piece[edge])
            back = self.source[edge]
            node[active] = back
            active = active[back > begin[active]]
            step += 1
        counts = np.zeros(len(unit), np.int64)
        for a in found_of:
            counts[a] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (a, p) in enumerate(zip(found_of, found, strict=True)):
            out[ends[a] - 1 - k] = p
        return out, counts


def _uncrossed(pieces: Pieces, byte: np.ndarray) -> np.ndarray:
    """The characters of a unit, but the first, whose start no edge of its lattice crosses."""
    at = np.flatnonzero((byte & 0xC0) != 0x80)
    reach = np.arange(1, len(byte) + 1)
    reach[at] = np.r_[at[1:], len(byte)]
    alive, state, depth = at, np.ones(len(at), np.int64), 0
    kinds = pieces.kind[byte]
    while len(alive):
        state = pieces.next[state * pieces.width + kinds[alive + depth]].astype(np.int64)
        alive, state = alive[state > 0], state[state > 0]
        depth += 1
        hit = alive[pieces.piece[state] >= 0]
        reach[hit] = np.maximum(reach[hit], hit + depth)
        go = alive + depth < len(byte)
        alive, state = alive[go], state[go]
    return at[1:][np.maximum.accumulate(reach)[at[1:] - 1] <= at[1:]]


def units(pieces: Pieces, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where no piece crosses: before a run of spaces, before and after a line feed, and more places in long units."""
    n = len(buf)
    cut = buf == 0x20
    cut[1:] &= buf[:-1] != 0x20
    line = buf == 0x0A
    cut |= line
    cut[1:] |= line[:-1]
    first = at[:-1]
    cut[first[first < n]] = True
    start = np.flatnonzero(cut)
    end = np.r_[start[1:], n] if len(start) else start
    long = np.flatnonzero(end - start > UNIT_BYTES)
    if len(long):
        start = np.unique(np.concatenate([start] + [s + _uncrossed(pieces, buf[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]))
        end = np.r_[start[1:], n]
    return start, end


def encode_texts(pieces: Pieces, buf: np.ndarray, at: np.ndarray, keys: np.ndarray, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts one after another, and how many each has.

    ``done`` units of the text came before the buffer.
    """
    n_texts = len(at) - 1
    if n_texts == 1 and len(cuts := bw.pieces_if_long(buf)) > 1:  # a piece of a long text begins with a unit
        found = []
        for low, high in cuts:
            ends = np.array([0, high - low])
            found.append(encode_texts(pieces, buf[low:high], ends, keys, done)[0])
            done += len(units(pieces, buf[low:high], ends)[0])
        out = np.concatenate(found)
        return out, np.array([len(out)])
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
    start, end = units(pieces, buf, at)
    _, lead, back = np.unique(bw.hashes(buf, start, end), return_index=True, return_inverse=True)
    size = end - start
    clash = size != size[lead[back]]
    whole = np.flatnonzero(~clash)
    clash[whole] = ~bw.same(buf, start[whole], buf, start[lead[back[whole]]], size[whole])
    if clash.any():  # units of one hash that differ get lattices of their own
        back[clash] = len(lead) + np.arange(int(clash.sum()))
        lead = np.r_[lead, np.flatnonzero(clash)]
    text = np.repeat(np.arange(n_texts), bw.counts(start, at))
    number = np.arange(len(start)) - np.searchsorted(start, at)[text] + done
    seed = bw.mix(bw.mix(keys[text]) + number.astype(np.uint64) * _U(0xD1B54A32D192ED03))
    rows = np.argsort(back // UNITS, kind="stable")
    cuts = np.searchsorted(back[rows] // UNITS, np.arange(-(-len(lead) // UNITS) + 1))
    parts, counts = [], np.zeros(len(start), np.int64)
    for k in range(len(cuts) - 1):
        mine, chosen = rows[cuts[k] : cuts[k + 1]], lead[k * UNITS : (k + 1) * UNITS]
        got, n = Lattices(pieces, buf, start[chosen], end[chosen]).sample(back[mine] - k * UNITS, seed[mine])
        counts[mine] = n
        parts.append((mine, n, got))
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for mine, n, got in parts:
        out[np.repeat(place[mine] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
    return out, np.bincount(text, counts, n_texts).astype(np.int64)


def decode_ids(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    size = pieces.size[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    raw = pieces.flat[np.repeat(pieces.first[ids] - (ends - size), size) + np.arange(total)].tobytes()
    upto = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
    return [raw[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]


_held: dict[tuple, Pieces] = {}


def pieces_of(path: str, theta: float = THETA) -> Pieces:
    """One in each worker process, which Spark uses again for further tasks."""
    if (path, theta) not in _held:
        _held[path, theta] = Pieces(path, theta)
    return _held[path, theta]


def encode(docs: DataFrame, model: str, theta: float = THETA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, lossless``: a sampled segmentation of every whole text, fixed by id and ``seed``.

    ``lossless`` says that the ids, decoded again, are the text byte for byte.
    """
    read = id_and_text(docs, id_col, text_col)
    kind = read.schema["doc_id"].dataType.simpleString()
    read = read.select("doc_id", "text", F.xxhash64("doc_id", F.lit(seed)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, theta)
        for part in slices(batches, limit=SLICE):
            buf, at = text_buffer(part.column(1))
            ids, counts = encode_texts(pieces, buf, at, part.column(2).to_numpy().view(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))
            raw = buf.tobytes()
            same = [t == raw[a:b] for t, a, b in zip(decode_ids(pieces, ids, counts), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "lossless"])

    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model: str, theta: float = THETA) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, ids, text``: the text that the ids spell."""
    read = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, theta)
        for batch in batches:
            lists = batch.column(1)
            counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            texts = decode_ids(pieces, lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "ids", "text"])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
