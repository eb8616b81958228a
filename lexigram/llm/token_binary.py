"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard image is self-contained::

    magic "LXEF" | u16 bytes of an id | u16 version | u64 documents | u64 ids
    ids, little-endian | Elias-Fano of the documents' ends | Elias-Fano of the document ids

An Elias-Fano sequence of n ascending values below u keeps the low floor(log2(u/n)) bits of
each value packed and the rest as a bitmap with a one for each value, about
2 + log2(u/n) bits a value.  Of every 64th one the position is sampled in 32 bits (relative
to the sequence), which makes ``select``, and so an offset, a lookup and a short scan.

Documents are dealt by ranges of their id, an integer, and sorted within (a repeated id by a
hash of its text and its place in the input, so that it may span ranges); each task encodes its range and
yields images of bounded size as rows ``(part, seq, n_docs, n_ids, image)``, which Spark
writes and commits like any other table, so a lost executor's work is done again.

Null texts count as empty (only the end id), null document ids come first, repeated ids come
in the order of a hash of their texts; ids of other types than integers are an error; a text with more ids than an image's limit has an image of its
own; an empty table gives no image.  Other columns are never read.

A text that quotes a special token of the vocabulary, such as ``<|endoftext|>``, is encoded by
its characters; with ``added_tokens`` the quote becomes that token, as the library has it by default.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexigram.llm import bytewords as bw
from lexigram.llm.common import folder_till_exit, id_and_text, shared_dir, slices, text_buffer

END_ID = 2
#: Ids in an image at most, unless a single document has more.
IMAGE_IDS = 1 << 21
_SAMPLE = 64
_HEAD = "<4sHHQQ"
_MAGIC = b"LXEF"


class EliasFano:
    """A sequence of ascending integers from 0; ``pack`` writes and the constructor reads."""

    _FIELDS = "<QQB"

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return struct.pack(cls._FIELDS, 0, 0, 0)
        top = int(v[-1]) + 1
        low_bits = max(0, (top // n).bit_length() - 1)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        samples = at[::_SAMPLE].astype("<u4")
        if at[-1] >= 1 << 32:
            raise ValueError("too many values for one sequence")
        high, low = (np.packbits(x.ravel(), bitorder="little").tobytes() for x in (high, low))
        return struct.pack(cls._FIELDS, n, len(high), low_bits) + samples.tobytes() + high + low

    def __init__(self, image: bytes, at: int = 0):
        self.n, high, self.low_bits = struct.unpack_from(self._FIELDS, image, at)
        at += struct.calcsize(self._FIELDS)
        n_samples = -(-self.n // _SAMPLE)
        self.samples = np.frombuffer(image, "<u4", n_samples, at)
        at += 4 * n_samples
        self.high = np.frombuffer(image, np.uint8, high, at)
        at += high
        size = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(image, np.uint8, size, at)
        self.end = at + size

    def select(self, i: int) -> int:
        """Value number i, by its sample and a scan of the bitmap from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        ones = int(self.high[byte]) & (0xFF << (at & 7))
        while left >= ones.bit_count():
            left -= ones.bit_count()
            byte += 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        high = 8 * byte + (ones & -ones).bit_length() - 1 - i
        start = i * self.low_bits
        chunk = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little")
        return (high << self.low_bits) | ((chunk >> (start & 7)) & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = np.zeros(self.n, np.uint64)
        for k in range(self.low_bits):
            low |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return high | low


def write_image(ids: np.ndarray, counts: np.ndarray, doc_ids: list) -> bytes:
    """``ids`` of all documents in order, how many each has, and the ascending document ids (null: None)."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    head = struct.pack(_HEAD, _MAGIC, wide, 1, len(counts), len(ids)) + struct.pack("<qQ", least, len(doc_ids) - len(known))
    ends = EliasFano.pack(np.cumsum(counts))
    return head + ids.astype(f"<u{wide}").tobytes() + ends + EliasFano.pack(known.view(np.uint64) - np.uint64(least % 2**64))


class Image:
    """A shard image: ``ids``, ``ends`` and ``doc_ids``; ``doc(i)`` gives the ids of document i."""

    def __init__(self, image: bytes):
        magic, wide, version, n_docs, n_ids = struct.unpack_from(_HEAD, image)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a shard image")
        at = struct.calcsize(_HEAD)
        least, self.nulls = struct.unpack_from("<qQ", image, at)
        at += 16
        self.n_docs, self.ids = n_docs, np.frombuffer(image, f"<u{wide}", n_ids, at)
        self.ends = EliasFano(image, at + wide * n_ids)
        self.known = EliasFano(image, self.ends.end)
        self.least = least

    def doc_ids(self) -> list:
        known = (self.known.all() + np.uint64(self.least % 2**64)).view(np.int64)
        return [None] * self.nulls + known.tolist()

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _odd_texts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with two white-space characters side by side, or one that isn't ASCII or is a separator control."""
    n = len(buf)
    bad = np.zeros(n, bool)
    space = bw.IS_SPACE[buf]
    bad[1:] = space[1:] & space[:-1]
    bad |= (buf >= 0x1C) & (buf <= 0x1F)
    # UTF-8 of the other white space of Unicode (fixed values): 0085 00A0 1680 2000-200A 2028 2029 202F 205F 3000
    tail = np.r_[buf, np.zeros(2, np.uint8)]
    for lead, second, thirds in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        i = np.flatnonzero(buf == lead)
        i = i[np.isin(tail[i + 1], second)]
        if thirds:
            i = i[np.isin(tail[i + 2], thirds)]
        bad[i] = True
    first = at[:-1]
    first = first[first < n]
    bad[first] &= ~space[first] | (buf[first] >= 0x1C) & (buf[first] <= 0x1F)
    return bw.per_text(bad, at) > 0


#: How a byte-level vocabulary writes a space, and pieces that are encoded in one text.
_SPACE = "\u0120"
_GLUED = 500


class Encoder:
    """Ids of many texts by a byte-level BPE of the tokenizers library.

    The vocabulary's own splitting rule never joins text across a single space or line feed
    between visible characters, so each such piece is encoded once and its ids are reused,
    found again by a hash of its bytes, which are then compared; a text with a piece whose
    hash another has is encoded whole.  Texts with white space of two or
    more characters, or other than ASCII, and those that quote an added token are encoded
    whole.  Pieces kept from earlier texts are bounded by ``keep``.
    """

    def __init__(self, path: str, keep: int = 1_500_000, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.keep = keep
        #: Added tokens that the library looks for in texts; it always does for those that aren't special.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (added_tokens or not t.special)]
        names = self.tokenizer.get_vocab()
        n = max(names.values()) + 1
        self.begins, self.line = np.zeros(n, bool), np.zeros(n, bool)
        self.begins[[i for w, i in names.items() if w[0] == _SPACE]] = True
        self.line[self._whole(["\n"])[0]] = True
        self.tails = {m: self._whole([m])[0][0] for m in ".,"}
        self._reset()

    def _reset(self) -> None:
        """Known pieces: ascending hashes, where in ``flat`` the ids of each are, and where in ``raw`` its bytes."""
        self.seen, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.raw, self.raw_first, self.raw_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], glue: str, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for pieces that stay apart when glued; ``lead`` marks ids that begin or part them."""
        texts = [glue.join(pieces[i : i + _GLUED]) for i in range(0, len(pieces), _GLUED)]
        found, sizes = [], []
        for row in self._whole(texts):
            ids = np.array(row, np.uint32)
            mark = lead[ids]
            at = np.flatnonzero(mark)
            if glue:
                sizes.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
                ids = ids[~mark]
            else:
                sizes.append(np.diff(np.r_[at, len(ids)]))
            found.append(ids)
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(sizes)

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces; a final point or comma is a piece of its own after a letter."""
        tail = np.fromiter((self.tails[p[-1]] if len(p) > 1 and p[-1] in ".," and p[-2].isalpha() else -1 for p in new), np.int64, len(new))
        stems = [p[:-1] if t >= 0 else p for p, t in zip(new, tail.tolist(), strict=True)]
        spaced, bare, odd = [], [], []
        for s in dict.fromkeys(stems):
            words = s.split()
            if len(words) != 1:
                odd.append(s)
            elif words[0] == s:
                bare.append(s)
            else:
                (spaced if len(s) == len(words[0]) + 1 and s[0] == " " else odd).append(s)
        alone = self._whole(odd)
        parts = [self._joined(spaced, "", self.begins), self._joined(bare, "\n", self.line)]
        parts.append((np.array([i for r in alone for i in r], np.uint32), np.fromiter(map(len, alone), np.int64, len(odd))))
        flat, size = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = {s: i for i, s in enumerate([*spaced, *bare, *odd])}
        if len(size) != len(order):
            raise RuntimeError("the vocabulary joined pieces across white space")
        at = np.fromiter(map(order.__getitem__, stems), np.int64, len(stems))
        first, n = np.cumsum(size) - size, size[at]
        sizes = n + (tail >= 0)
        ends = np.cumsum(sizes)
        rows = np.empty(int(sizes.sum()), np.uint32)
        stem = np.ones(len(rows), bool)
        stem[ends[tail >= 0] - 1] = False
        rows[~stem] = tail[tail >= 0]
        rows[stem] = flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return rows, sizes

    def _learn(self, raw: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Adds pieces with new, ascending keys."""
        if len(self.seen) + len(keys) > self.keep and len(self.seen):
            raise OverflowError
        rows, sizes = self._encode_pieces([raw[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        at = np.searchsorted(self.seen, keys)
        self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes.astype(np.int32))
        self.raw_first = np.insert(self.raw_first, at, len(self.raw) + np.cumsum(end - start) - (end - start))
        self.raw_size = np.insert(self.raw_size, at, end - start)
        self.seen = np.insert(self.seen, at, keys)
        self.flat = np.r_[self.flat, rows]
        self.raw = np.r_[self.raw, bw.gathered(np.frombuffer(raw, np.uint8), start, end - start)]

    _keys = staticmethod(bw.hashes)

    def _quotes(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        """Texts in which the library may find an added token; all where one holds white space, as gluing could make it."""
        out = np.zeros(len(at) - 1, bool)
        for token in self.added:
            if any(c.isspace() for c in token):
                out[:] = True
            sought = token.encode()
            place = raw.find(sought)
            while place >= 0:
                text = int(np.searchsorted(at, place, "right")) - 1
                end = int(at[text + 1])
                inside = place + len(sought) <= end
                out[text] |= inside
                place = raw.find(sought, end if inside else place + 1)
        return out

    def encode(self, buf: np.ndarray, at: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a buffer, each with the end id, and how many each text has."""
        n, n_texts = len(buf), len(at) - 1
        raw = buf.tobytes()
        quotes = self._quotes(raw, at)
        if n_texts == 1 and not quotes[0] and len(cuts := bw.pieces_if_long(buf)) > 1:
            if not any(_odd_texts(buf[a:b], np.array([0, b - a]))[0] for a, b in cuts):
                ids = np.concatenate([self.encode(buf[a:b], np.array([0, b - a]), None)[0] for a, b in cuts] + [np.array([] if end_id is None else [end_id], np.uint32)])
                return ids, np.array([len(ids)])
        odd = np.flatnonzero(_odd_texts(buf, at) | quotes)
        begin = (buf == 0x20) | (buf == 0x0A)
        begin[1:] |= buf[:-1] == 0x0A
        first = at[:-1]
        begin[first[first < n]] = True
        start = np.flatnonzero(begin)
        end = np.r_[start[1:], n]
        inside = np.repeat(np.isin(np.arange(n_texts), odd), np.diff(np.searchsorted(start, at)))
        start, end = start[~inside], end[~inside]
        unique, lead, back = np.unique(self._keys(buf, start, end), return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.searchsorted(self.seen, unique)
            known = np.zeros(len(unique), bool)
            there = place < len(self.seen)
            known[there] = self.seen[place[there]] == unique[there]
            if known.all():
                break
            try:
                self._learn(raw, unique[~known], start[lead[~known]], end[lead[~known]])
            except OverflowError:
                self._reset()
                self._learn(raw, unique, start[lead], end[lead])
        place = np.searchsorted(self.seen, unique)[back]
        # a piece that only shares its hash with a known one: its text is encoded whole
        clash = self.raw_size[place] != end - start
        equal = np.flatnonzero(~clash)
        clash[equal] = ~bw.same(buf, start[equal], self.raw, self.raw_first[place[equal]], (end - start)[equal])
        if clash.any():
            odd = np.union1d(odd, np.searchsorted(at, start[clash], "right") - 1)
        size, from_ = self.size[place].astype(np.int64), self.first[place]
        begins = np.cumsum(size) - size
        total = int(size.sum())
        flat = self.flat[np.repeat(from_ - begins, size) + np.arange(total)]
        upto = np.r_[begins, total][np.searchsorted(start, at[1:])]
        counts = np.diff(upto, prepend=0)
        tail = [] if end_id is None else [end_id]
        if len(odd):
            whole = dict(zip(odd.tolist(), self._whole([raw[at[k] : at[k + 1]].decode() for k in odd.tolist()]), strict=True))
            parts, before = [], 0
            for k, e in enumerate(upto.tolist()):
                parts.append(np.array(whole[k] + tail, np.uint32) if k in whole else np.r_[flat[before:e], np.array(tail, np.uint32)])
                before = e
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        if tail:
            flat = np.insert(flat, upto, np.uint32(end_id))
            counts = counts + 1
        return flat, counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, added_tokens: bool = False) -> Encoder:
    """One in each worker process, which Spark uses again for further tasks."""
    key = path, added_tokens
    if key not in _encoders:
        _encoders[key] = Encoder(path, added_tokens=added_tokens)
    return _encoders[key]


def images(docs: DataFrame, vocabulary: str, end_id: int = END_ID, image_ids: int = IMAGE_IDS, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Shard images in ascending order of ids: ``part, seq, n_docs, n_ids, image``."""
    read = id_and_text(docs, id_col, text_col)
    if not isinstance(read.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("document ids must be integers")
    # equal rows may lie either way, so their order by place needn't be the same again
    order = ["doc_id", "hash", "place"]
    ranged = read.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = _encoder(vocabulary, added_tokens), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, seq
            ids, counts = (np.concatenate([h[i] for h in held]) for i in range(2))
            names = [x for h in held for x in h[2]]
            row = [pa.array([x]) for x in (part, seq, len(counts), len(ids))] + [pa.array([write_image(ids, counts, names)], pa.binary())]
            held, n, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "n_docs", "n_ids", "image"])

        for batch in slices(batches, limit=1 << 20):
            ids, counts = encoder.encode(*text_buffer(batch.column(1)), end_id)
            if held and n + len(ids) > image_ids:
                yield flush()
            held.append((ids, counts, batch.column(0).to_pylist()))
            n += len(ids)
        if held:
            yield flush()

    return ranged.mapInArrow(run, "part long, seq long, n_docs long, n_ids long, image binary")


def write(docs: DataFrame, vocabulary: str, path: str, **more) -> None:
    """Writes the images as a table at ``path``, which Spark commits once all are there."""
    images(docs, vocabulary, **more).write.option("compression", "zstd").mode("overwrite").parquet(path)


def new_path(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    return folder_till_exit(spark, f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the images at ``path``."""
    table = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = Image(image)
                n = held.n_docs
                ends = np.fromiter(map(held.ends.select, range(n)), np.int64, n)
                starts = np.r_[0, ends[:-1]]
                ids = held.ids.astype("<u4")
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array([part] * n), pa.array([seq] * n), pa.array(held.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = table.select("part", "seq", "image").mapInArrow(run, "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = table.select("part", "seq", "n_ids")
    # one row a range partition
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", ahead(Window.orderBy("part")).alias("before_part"))
    before = sizes.select("part", "seq", ahead(Window.partitionBy("part").orderBy("seq")).alias("before")).join(parts, "part")
    out = rows.join(before, ["part", "seq"])
    return out.select("doc_id", (F.col("before_part") + F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
